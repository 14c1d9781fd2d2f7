"""Encoding of many texts through the ids of their distinct chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text encoded at once.
SLICE_BYTES = 6 << 20


def grouped(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches`, regrouped until `column` holds about `size` bytes; a longer text may come alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += batch.column(column).nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def assemble(chunks: pa.ListArray, ids_of: Callable[[list[str]], list[bytes] | tuple[np.ndarray, np.ndarray]], skip_first: bool = False) -> list[bytes]:
    """Ids of each row of `chunks`, joined from the ids of its chunks (32-bit, as bytes).

    `ids_of` gets each distinct chunk once, and gives the ids of each or all ids
    and how many each has. With `skip_first` a row's first chunk is left out.
    """
    values = chunks.flatten()
    bounds = chunks.offsets.to_numpy().astype(np.int64) - chunks.offsets[0].as_py()
    if skip_first:
        kept = np.ones(len(values), bool)
        kept[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
        values = values.filter(pa.array(kept))
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    coded = values.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    own = ids_of(coded.dictionary.to_pylist())
    if isinstance(own, tuple):
        flat, size = own
    else:
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), "<u4")
    begin = np.concatenate([[0], np.cumsum(size)])
    count = size[index]
    ends = np.concatenate([[0], np.cumsum(count)])
    out = flat[np.repeat(begin[:-1][index] - ends[:-1], count) + np.arange(ends[-1])].astype("<u4", copy=False)
    cut = ends[bounds].tolist()
    raw = out.tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:], strict=False)]

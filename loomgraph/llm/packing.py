"""Packing token pieces into sequences by patterns of lengths.

Documents become token ids and are cut into pieces of at most `CAPACITY`
tokens. Only the histogram of piece lengths (at most `CAPACITY` rows, whatever
the table's size) reaches the driver. There, patterns of few documents that fill
a sequence exactly are enumerated; non-negative least squares fits how often
each is used to the histogram; the counts are rounded down, and what is left is
packed longest first, each sequence being filled up with the longest lengths
that still fit. The plan is a list of runs ("`n` sequences of this pattern"), so
its size depends on the number of lengths, not of documents. Each piece then
finds its own place from its rank among the pieces of its length; ranks come
from counts over hashed buckets, so a length that many pieces share is spread.

Defined results: a null or empty text is one piece that holds the end id alone;
repeated rows are packed each for itself; an empty table gives an empty table;
extra columns are left out except those named in `keep`.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from loomgraph import scratch
from loomgraph.llm.chunks import assemble, grouped
from loomgraph.ship import ship

CAPACITY, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Chunks remembered by a task, and the longest chunk that is remembered.
MEMORY, LONGEST = 500_000, 64
#: Patterns offered to the fit, and triples for each longest member.
PATTERNS, TRIPLES = 12_000, 3
BUCKET_ROWS, BUCKETS = 50_000, 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str) -> tuple[Callable[[pa.Array], list[bytes]], Callable[[], None]]:
    """A function from texts to ids as little-endian unsigned 32-bit integers, and one that forgets what it remembers.

    The vocabulary's splitter never joins characters across white space, so a
    text is encoded chunk by chunk; each new chunk goes through the tokenizer
    once and is then remembered. Python counts the separators x1c-x1f as white
    space and the vocabulary does not, so texts with one go through it whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tokenize = tok.model.tokenize
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    memory: dict[str, bytes] = {}
    cores: dict[str, bytes] = {}
    # Latin letters then closing marks: the splitter cuts between them, and composed letters of one case map stay as they are
    plain = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]*)").fullmatch

    def packed(e) -> bytes:
        return array("I", e.ids).tobytes()

    def through(texts: list[str]) -> list[bytes]:
        return list(map(packed, tok.encode_batch_fast(texts, add_special_tokens=False)))

    def core(word: str) -> bytes:
        """Ids of lower-case Latin letters or of closing marks: the model alone, on byte-level characters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in tokenize(word)]).tobytes()

    # a vocabulary that treats letters otherwise goes the general way
    trusted = all(core(w.lower()) + core(e) == packed(tok.encode(w + e, add_special_tokens=False)) for w, e in (("Strasse", "."), ("\u00c9t\u00e9", ",!"), ("\u00f1and\u00fa", ""), ("x", "?..")))

    def learn(new: list[str]) -> None:
        cut = [(c, m[1].lower(), m[2]) for c in new if (m := plain(c))] if trusted else []
        parts = {p for _, *own in cut for p in own}.difference(cores)
        if len(cores) + len(parts) > MEMORY:
            cores.clear()
            parts = {p for _, *own in cut for p in own}
        for p in parts:
            cores[p] = core(p)
        for c, a, b in cut:
            memory[c] = cores[a] + cores[b] if b else cores[a]
        whole = [c for c in new if c not in memory]
        memory.update(zip(whole, through(whole), strict=True))

    def ids_of(chunks: list[str]) -> list[bytes]:
        new = [c for c in chunks if c not in memory]
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = chunks
        learn(new)
        out = list(map(memory.__getitem__, chunks))
        for c in new:
            if len(c) > LONGEST:
                del memory[c]
        return out

    def encode(texts: pa.Array) -> list[bytes]:
        strange = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        plain_texts = pc.if_else(pa.array(strange, pa.bool_()), "", texts) if strange.any() else texts
        out = assemble(pc.utf8_split_whitespace(plain_texts), ids_of)
        for i in np.flatnonzero(strange).tolist():
            out[i] = packed(tok.encode(texts[i].as_py(), add_special_tokens=False))
        return out

    def forget() -> None:
        memory.clear()
        cores.clear()

    return encode, forget


_ENCODERS: dict[str, tuple[Callable[[pa.Array], list[bytes]], Callable[[], None]]] = {}


def _encoder(path: str) -> tuple[Callable[[pa.Array], list[bytes]], Callable[[], None]]:
    if path not in _ENCODERS:
        _ENCODERS[path] = encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: the `keep` columns, ``piece``, ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    fields = [docs.schema[c] for c in keep]
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields] + [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("_ids", BinaryType())])
    tail, step = np.array([end], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, forget = _encoder(path)
        for part in grouped(batches, len(fields)):
            row, piece, start, length, ids = [], [], [], [], []
            for i, b in enumerate(encode(pc.fill_null(part.column(len(fields)), ""))):
                b += tail
                for k, at in enumerate(range(0, len(b), step)):
                    x = b[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(x) // 4)
                    ids.append(x)
            own = [part.column(c).take(pa.array(row, pa.int32())) for c in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[*keep, "piece", "start", "length", "_ids"])
        forget()

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(cut, schema).withColumnRenamed("_ids", "ids")


def enumerate_patterns(hist: np.ndarray, capacity: int, most: int = PATTERNS, triples: int = TRIPLES) -> list[dict[int, int]]:
    """Patterns of few lengths that are there and fill `capacity` exactly: one length, pairs, triples, and one length repeated with a rest."""
    there = np.flatnonzero(hist)
    got: dict[tuple, dict[int, int]] = {}

    def add(*lengths: int) -> None:
        p: dict[int, int] = {}
        for x in lengths:
            p[x] = p.get(x, 0) + 1
        got.setdefault(tuple(sorted(p.items())), p)

    if hist[capacity]:
        add(capacity)
    for a in there[there >= capacity // 2].tolist():
        if capacity - a > 0 and hist[capacity - a]:
            add(a, capacity - a)
    for a in there[::-1].tolist():
        k = capacity // a
        rest = capacity - k * a
        if 2 <= k <= 16 and (rest == 0 or hist[rest]):
            add(*[a] * k, *([rest] if rest else []))
    for a in there[(there >= capacity // 3)][::-1].tolist():
        b = there[(there <= a) & (there < capacity - a)]
        c = capacity - a - b
        ok = (c >= 1) & (c <= b)
        b, c = b[ok], c[ok]
        ok = hist[c] > 0
        b, c = b[ok], c[ok]
        for i in np.argsort(-np.minimum(hist[b], hist[c]), kind="stable")[:triples].tolist():
            add(a, int(b[i]), int(c[i]))
    return list(got.values())[:most]


def fit_counts(patterns: list[dict[int, int]], hist: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares of ``sum(x_p * pattern_p) ~ hist`` by coordinate descent."""
    x = [0.0] * len(patterns)
    left = hist.astype(float).tolist()
    cols = [(tuple(p.items()), sum(m * m for m in p.values())) for p in patterns]
    for _ in range(sweeps):
        moved = 0.0
        for k, (col, norm) in enumerate(cols):
            step = 0.0
            for length, m in col:
                step += m * left[length]
            step = max(-x[k], step / norm)
            if step:
                x[k] += step
                for length, m in col:
                    left[length] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return np.array(x)


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs ``(n, [(length, times), ...])`` that use every piece of `hist` (indexed by length) once."""
    left = hist.astype(np.int64).copy()
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    patterns = enumerate_patterns(left, capacity)
    x = fit_counts(patterns, left)
    for k in np.argsort(-x, kind="stable").tolist():
        n = min([int(x[k] + 1e-6), *(int(left[a]) // m for a, m in patterns[k].items())])
        if n > 0:
            for a, m in patterns[k].items():
                left[a] -= n * m
            runs.append((n, sorted(patterns[k].items(), reverse=True)))
    there = np.flatnonzero(left)
    while len(there):
        room, pattern, top = capacity, [], len(there)
        while room > 0 and (top := min(top, int(np.searchsorted(there, room, "right")))) > 0:
            a = int(there[top - 1])
            m = min(int(left[a]), room // a)
            pattern.append((a, m))
            room -= a * m
            top -= 1
        n = min(int(left[a]) // m for a, m in pattern)
        for a, m in pattern:
            left[a] -= n * m
        runs.append((n, pattern))
        if any(not left[a] for a, _ in pattern):
            there = np.flatnonzero(left)
    return runs


def slots(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The runs by length: from which rank on a run of places begins, its first sequence, places in a sequence and offset."""
    rows, used, base = [], {}, 0
    for n, pattern in runs:
        offset = 0
        for length, m in pattern:
            rows.append((length, used.get(length, 0), base, m, offset))
            used[length] = used.get(length, 0) + n * m
            offset += length * m
        base += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: a[:, i].copy() for i, k in enumerate(("length", "rank", "base", "times", "offset"))}


def place(table: DataFrame, order: Sequence[str] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """`table` (with ``length`` from 1 to `capacity`) with ``sequence_id`` and ``offset``.

    `order` should tell rows apart; rows equal in all of it and in length may
    change places among themselves. `table` is read more than once: pass a
    written one.
    """
    ship(table.sparkSession)
    counts = table.groupBy("length").count().collect()
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counts:
        hist[length] = n
    where = slots(plan(hist, capacity))
    keys = where["length"] * (1 << 44) + where["rank"]
    n = int(hist.sum())
    buckets = max(BUCKETS, n // BUCKET_ROWS)
    rows = table.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = rows.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    own = Window.partitionBy("_bucket", "length").orderBy(*order)
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1).join(before, ["_bucket", "length"]).withColumn("_rank", F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")
    schema = StructType([*ranked.drop("_rank").schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            k, m = rank - where["rank"][at], where["times"][at]
            cols = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(where["base"][at] + k // m), pa.array(where["offset"][at] + k % m * length)], names=schema.names)

    return ranked.mapInArrow(seat, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from placed pieces with ``ids``; a sequence's pieces are bounded by its capacity."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of `docs` with their ids and places."""
    held = scratch.write(pieces(docs, text_col, (id_col,)), "pieces")
    return place(held.withColumn("_crc", F.crc32("ids")), (id_col, "piece", "_crc")).drop("_crc")


def manifest(docs: DataFrame) -> DataFrame:
    """The places with a checksum in place of the ids, which are not written."""
    held = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(scratch.write(held, "pieces"), ("doc_id", "piece", "ids_crc32")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return manifest(docs)

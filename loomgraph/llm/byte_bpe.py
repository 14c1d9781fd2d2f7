"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that
is a whole vocabulary entry; hashes of a slice's distinct pre-tokens are looked
up at once, and each hit is confirmed against the entry's bytes. Tier two: a
miss is merged from its bytes, kept as linked spans, by a heap ordered by rank
and then position. The heaps of many words of up to 128 bytes lie side by side
in an array and give their roots together (`Heaps`); longer words, and those of
a vocabulary that lacks some byte, have a heap of their own (`merge`).

A space before a non-space always begins a new pre-token (a pattern without this
is refused where it shows), so a text is cut there into chunks, and each distinct
chunk and pre-token of a slice of rows is encoded once. Nothing is remembered
between slices. Whole texts are encoded, whatever their length.

Defined results: a null text counts as empty and has no ids; repeated rows get
equal ids; an empty table gives an empty table. `encode` and `decode` pass other
columns through; a column that has the name of an output is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from loomgraph.llm.chunks import assemble, grouped
from loomgraph.ship import ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Unicode's White_Space, as members of a character class.
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = [b""] * (1 + max(int(r) for _, r in pairs))
    for word, rank in pairs:
        entries[int(rank)] = base64.b64decode(word)
    return entries


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (d * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash: every key has its own of `n` slots, found from its hash and its bucket's displacement. Keys must differ."""

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) < len(keys):
            raise ValueError("keys of a perfect hash must differ")
        self.n, self.m = len(keys), max(1, len(keys) // 4)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        bucket = (h >> np.uint64(32)).astype(np.int64) % self.m
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
        self.shift = np.zeros(self.m, np.int64)
        taken = np.zeros(self.n, bool)
        self.entry = np.zeros(self.n, np.int64)
        groups.sort(key=len, reverse=True)
        alone = next((i for i, g in enumerate(groups) if len(g) == 1), len(groups))
        for g in groups[:alone]:
            base, size = 1, 32
            while True:
                at = _slot(h[g][:, None], np.arange(base, base + size, dtype=np.uint64)[None, :], self.n)
                ok = ~taken[at].any(0)
                s = np.sort(at, axis=0)
                ok &= (s[1:] != s[:-1]).all(0)
                if ok.any():
                    k = int(ok.argmax())
                    break
                base, size = base + size, min(4096, 2 * size)
            self.shift[bucket[g[0]]] = base + k
            taken[at[:, k]] = True
            self.entry[at[:, k]] = g
        # keys alone in their bucket take the free slots; their slot is written down itself, as a negative number
        single = np.array([g[0] for g in groups[alone:]], np.int64)
        free = np.flatnonzero(~taken)[: len(single)]
        self.shift[bucket[single]] = -1 - free
        self.entry[free] = single

    def find(self, keys: list[bytes]) -> list[int]:
        """The one entry that each key could be; the caller confirms it."""
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        d = self.shift[(h >> np.uint64(32)).astype(np.int64) % self.m]
        return self.entry[np.where(d < 0, -1 - d, _slot(h, np.abs(d).astype(np.uint64), self.n))].tolist()


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ranks of `word` after all merges: lowest rank first, leftmost among equals."""
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    get = rank.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        mid = end[i]
        if mid < 0 or mid >= n or end[mid] != e:
            continue
        end[i], end[mid] = e, -1
        if e < n:
            prev[e] = i
            if (r := get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        p = prev[i]
        if p >= 0 and (r := get(word[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : end[i]]])
        i = end[i]
    return out


def _spread(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs `index` of `flat`, whose runs have `size` items, one after another; and where each ends, from 0."""
    count = size[index]
    ends = np.concatenate([[0], np.cumsum(count)])
    begin = np.cumsum(size) - size
    return flat[np.repeat(begin[index] - ends[:-1], count) + np.arange(ends[-1])], ends


class Pairs:
    """Rank of what two neighbouring tokens merge to: open addressing, a quarter full at most."""

    def __init__(self, rank: dict[bytes, int], top: int):
        self.top = top + 1
        found = [(a, b, r) for w, r in rank.items() for k in range(1, len(w)) if (a := rank.get(w[:k])) is not None and (b := rank.get(w[k:])) is not None]
        left, right, merged = np.array(found, np.int64).reshape(-1, 3).T
        self.bits = max(4, (4 * len(found)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, -1, np.int32)
        key, at = (left + 1) * self.top + right + 1, None
        while len(key):
            at = self._slot(key) if at is None else (at + 1) & (len(self.key) - 1)
            free = np.flatnonzero(self.key[at] < 0)
            self.key[at[free]] = key[free]
            own = self.key[at] == key
            self.rank[at[own]] = merged[own]
            key, merged, at = key[~own], merged[~own], at[~own]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs, -1 where there is none; a token of -1 merges with none."""
        key = (left.astype(np.int64) + 1) * self.top + right + 1
        at = self._slot(key)
        met = self.key[at]
        out = np.where(met == key, self.rank[at], np.int32(-1))
        open_ = np.flatnonzero((met != key) & (met >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.key) - 1)
            met = self.key[at[open_]]
            same = met == key[open_]
            out[open_[same]] = self.rank[at[open_[same]]]
            open_ = open_[~same & (met >= 0)]
        return out


class Heaps:
    """`merge` for many words at once.

    Each word is a column of spans linked to their neighbours, with a heap of its
    pairs: a tree whose leaves are the pairs in order and whose nodes hold the
    least rank and position below them. In every step each heap gives its root,
    the pair is merged, and the heaps are put in order again from the leaves.
    """

    #: Leaves of a heap: words of at most so many bytes; longer words are for `merge`.
    WIDTHS = (8, 16, 32, 64, 128)
    #: Spans merged side by side, few enough for a processor's cache.
    SPANS = 1 << 17
    #: Bits of a position below a rank.
    BITS = 7
    NONE = np.int32(2**31 - 1)

    def __init__(self, rank: dict[bytes, int], top: int):
        self.pairs = Pairs(rank, top)
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.first = self.pairs.find(np.repeat(self.byte, 256), np.tile(self.byte, 256))

    @classmethod
    def can(cls, rank: dict[bytes, int], top: int) -> bool:
        """Whether a vocabulary has every byte, and its ranks leave room for positions."""
        return top < 1 << 31 - cls.BITS and all(bytes([b]) in rank for b in range(256))

    def merge(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of `length` bytes (2 to 128) from `begin` in `data`, and how many ids each has."""
        size = np.zeros(len(begin), np.int64)
        order, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        least = 0
        for width in self.WIDTHS:
            mine = np.flatnonzero((length > least) & (length <= width))
            side = self.SPANS // width
            for k in range(0, len(mine), side):
                for words, n, flat in self._merge(data, begin, length, mine[k : k + side], width):
                    size[words] = n
                    order.append(words)
                    ids.append(flat)
            least = width
        done = np.concatenate(order)
        place = np.empty(len(done), np.int64)
        place[done] = np.arange(len(done))
        return _spread(np.concatenate(ids), size[done], place)[0], size

    def _merge(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, words: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, m = length[words], len(words)
        row = np.arange(width)[:, None]
        raw = data[np.minimum(begin[words] + row, len(data) - 1)].astype(np.int32)
        # row `width` stands for what lies before the first and after the last span
        token = np.full((width + 1, m), -1, np.int32)
        token[:-1] = np.where(row < n, self.byte[raw], -1)
        end = np.repeat(np.arange(1, width + 2, dtype=np.int32)[:, None], m, 1)
        prev = np.repeat(np.arange(-1, width, dtype=np.int32)[:, None], m, 1)
        prev[0] = width
        heap = np.full((2 * width + 1, m), self.NONE, np.int32)
        rank = self.first[raw[:-1] << 8 | raw[1:]]
        heap[width : 2 * width - 1] = np.where((rank >= 0) & (row[:-1] < n - 1), rank << self.BITS | row[:-1].astype(np.int32), self.NONE)
        while True:
            w = width // 2
            while w:
                np.minimum(heap[2 * w : 4 * w : 2], heap[2 * w + 1 : 4 * w : 2], out=heap[w : 2 * w])
                w //= 2
            live = heap[1] != self.NONE
            at = np.flatnonzero(live)
            if 4 * len(at) <= 3 * m:
                over = token[:, ~live].T
                yield words[~live], (over >= 0).sum(1), over[over >= 0].astype(np.uint32)
                if not len(at):
                    return
                # `take` keeps the arrays in rows, so that the flat views below write to them
                words, token, end, prev, heap = words[at], token.take(at, 1), end.take(at, 1), prev.take(at, 1), heap.take(at, 1)
                m, at = len(at), np.arange(len(at))
            tokens, ends, prevs, keys = (x.reshape(-1, copy=False) for x in (token, end, prev, heap[width:]))
            k = heap[1][at]
            i, r = k & (1 << self.BITS) - 1, k >> self.BITS
            here = i * np.int64(m) + at
            mid = ends[here] * np.int64(m) + at
            e = ends[mid]
            after = e * np.int64(m) + at
            before = prevs[here] * np.int64(m) + at
            tokens[here], tokens[mid], ends[here], prevs[after], keys[mid] = r, -1, e, i, self.NONE
            with_next, with_prev = self.pairs.find(r, tokens[after]), self.pairs.find(tokens[before], r)
            keys[here] = np.where(with_next >= 0, with_next << self.BITS | i, self.NONE)
            keys[before] = np.where(with_prev >= 0, with_prev << self.BITS | prevs[here], self.NONE)


class Codec:
    def __init__(self, path: str, pattern: str):
        self.entries = read_ranks(path)
        self.rank = {w: r for r, w in enumerate(self.entries) if w}
        self.bytes_of = pa.array(self.entries, pa.large_binary())
        # a rank that is not used gets a key that no text has
        self.table = PerfectHash([w or b"\xff\xff" + str(r).encode() for r, w in enumerate(self.entries)])
        self.heaps = Heaps(self.rank, len(self.entries)) if Heaps.can(self.rank, len(self.entries)) else None
        # the pattern's white space is Unicode's White_Space, spelled out here
        spelled = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(spelled).findall
        self.cuts = regex.compile(r" (?=\P{White_Space})").finditer

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, and how many each has."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = words.cast(pa.binary()).to_pylist()
        entries, found = self.entries, self.table.find(raw)
        missed = np.fromiter((entries[e] != b for e, b in zip(found, raw, strict=True)), bool, len(raw))
        bounds = np.frombuffer(words.buffers()[1], np.int32, len(raw) + 1, 4 * words.offset).astype(np.int64)
        length = np.diff(bounds)
        side = missed & (length >= 2) & (length <= Heaps.WIDTHS[-1]) if self.heaps else np.zeros(len(raw), bool)
        alone = np.flatnonzero(missed & ~side)
        whole, side = np.flatnonzero(~missed), np.flatnonzero(side)
        merged = [merge(raw[i], self.rank) for i in alone.tolist()]
        ids = [np.array(found, np.uint32)[whole], *(np.array(x, np.uint32) for x in merged)]
        size = np.ones(len(raw), np.int64)
        size[alone] = [len(x) for x in merged]
        if len(side):
            flat, size[side] = self.heaps.merge(np.frombuffer(words.buffers()[2], np.uint8), bounds[side], length[side])
            ids.append(flat)
        order = np.concatenate([whole, alone, side])
        place = np.empty(len(raw), np.int64)
        place[order] = np.arange(len(raw))
        return _spread(np.concatenate(ids), size[order], place)[0], size

    def _ids(self, tokens: list[str], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of pre-tokens, and how many each run has."""
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        flat, ends = _spread(*self._word_ids(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        return flat, np.diff(ends[bounds])

    def _chunk_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, given without the space they begin with, and how many each has. They are cut side by side, since each begins a pre-token."""
        tokens = self.pieces(" " + " ".join(parts)) if parts else []
        begin, cut = np.cumsum([0, *map(len, tokens)]), np.cumsum([0, *(1 + len(p) for p in parts)])
        bounds = np.searchsorted(begin, cut)
        if (begin[np.minimum(bounds, len(tokens))] != cut).any():
            raise ValueError("the pattern must begin a pre-token at a space before a non-space")
        return self._ids(tokens, bounds)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts without nulls, as little-endian unsigned 32-bit integers."""
        uneven = pc.match_substring_regex(texts, " (?:[" + WHITE + "]|\\z)").to_numpy(zero_copy_only=False)
        even = pc.if_else(pa.array(uneven, pa.bool_()), "", texts) if uneven.any() else texts
        split = pc.split_pattern(even, " ")
        heads = pc.list_element(split, 0).to_pylist()
        rest = assemble(split, self._chunk_ids, skip_first=True)
        odd = {}
        for i in np.flatnonzero(uneven).tolist():
            t = texts[i].as_py()
            at = [m.start() for m in self.cuts(t)]
            heads[i] = t[: at[0]] if at else t
            odd[i] = [t[a + 1 : b] for a, b in zip(at, [*at[1:], len(t)], strict=True)] if at else []
        if odd:
            runs = pa.array(list(odd.values()), pa.list_(pa.string()))
            for i, ids in zip(odd, assemble(runs, self._chunk_ids), strict=True):
                rest[i] = ids
        distinct = list(set(heads))
        tokens = [self.pieces(h) for h in distinct]
        flat, size = self._ids([w for t in tokens for w in t], np.cumsum([0, *map(len, tokens)]))
        raw, cut = flat.astype("<u4", copy=False).tobytes(), np.cumsum([0, *(4 * size).tolist()]).tolist()
        first = {h: raw[a:b] for h, a, b in zip(distinct, cut, cut[1:], strict=False)}
        return [first[a] + b for a, b in zip(heads, rest, strict=True)]

    def decode(self, ids: list[bytes]) -> pa.Array:
        """The bytes that rows of ids stand for."""
        cut = np.cumsum([0, *map(len, ids)])
        if (cut % 4).any():
            raise ValueError("ids are 32-bit integers")
        if not cut[-1]:
            return pa.array([b""] * len(ids), pa.binary())
        made = self.bytes_of.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        ends = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1)[cut // 4]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), made.buffers()[2]]).cast(pa.binary())


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _added(df: DataFrame, source: str, names: list[str], make: Callable[[], Callable[[pa.Array], list[list | pa.Array]]]) -> DataFrame:
    """`df` with binary columns `names` made from column `source`, a slice of rows at a time."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in names]
    schema = StructType([*[df.schema[c] for c in kept], *[StructField(n, BinaryType()) for n in names]])
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("__source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in grouped(batches, len(kept)):
            made = [x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for x in f(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *names])

    return src.mapInArrow(run, schema)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with the ids of `text_col` as little-endian unsigned 32-bit integers, and in `bytes_col`, if given, what they decode to."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def make() -> Callable[[pa.Array], list[list | pa.Array]]:
        own = codec(path, pattern)

        def run(texts: pa.Array) -> list[list | pa.Array]:
            ids = own.encode(pc.fill_null(texts, ""))
            return [ids, own.decode(ids)] if bytes_col else [ids]

        return run

    return _added(docs, text_col, [ids_col, bytes_col] if bytes_col else [ids_col], make)


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`df` with the bytes that `ids_col` stands for (null ids: null)."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(rows: pa.Array) -> list[pa.Array]:
        made = codec(path, pattern).decode([x or b"" for x in rows.to_pylist()])
        return [pc.if_else(rows.is_valid(), made, None)]

    return _added(df, ids_col, [bytes_col], lambda: run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode(docs, bytes_col="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

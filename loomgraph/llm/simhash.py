"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, four-word shingles
with repeats, each hashed by XXH64 (seed 42); a bit is set if it is set in over
half of the hashes. Two fingerprints link at `RADIUS` or fewer differing bits.

Candidates: equal fingerprints are one node from the start. The 64 bits are cut
into `b` blocks; fingerprints that differ in four bits agree on at least b-4
whole blocks, so rows are keyed by every choice of b-4 blocks and no link is
lost for any b; b follows the number of nodes so that a key stays selective.
A key with many nodes is split into square tiles of bounded size, spread over
tasks. Within a tile bit planes are stored vertically (one machine word holds
one bit of 64 nodes), distances to many nodes at once are counted by carry-save
adders, and a word is abandoned once all its 64 nodes exceed the radius. A tile
gives a spanning forest of its links, not all pairs; components are unchanged.

Defined results: a null text counts as empty; no words give fingerprint zero,
which links like any other; a text of any length is read whole; repeated rows share
their fingerprint; a null id is kept as a row but names a component only if nothing
else is in it; ties of a bit (set in exactly half) leave it unset; an empty table
gives an empty table. `stage` keeps one row of each component: the smallest id (null
last), of one id's texts that of the smallest hash, and one of rows equal in both;
every column stays as it is, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomgraph import scratch
from loomgraph.operators.components import connected_components
from loomgraph.ship import ship

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Nodes of one side of a tile, and how many nodes a key should hold on average at most.
TILE, FILL = 2048, 1024
PART = 65_536


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    if len(words) <= SHINGLE:
        return h(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[SHINGLE - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        got = np.array([h(joined[a:b], SEED) for a, b in zip(first[at : at + PART], last[at : at + PART], strict=True)], np.uint64)
        count += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series(np.array([fingerprint(t) for t in part], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with ``fp``, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    return docs.withColumn("fp", pandas_udf(_fingerprints, "long")(F.col(text_col)))


def _word(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of `fps`: row k holds bit k of all, 64 to a word; filled up with ones for lanes that are not there."""
    m = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    wide = np.zeros((64, -(-m // 64) * 64), np.uint8)
    wide[:, :m] = bits.T
    return _word(np.packbits(wide, axis=1, bitorder="little"))


def linked(fps: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 18) -> np.ndarray:
    """Adjacency of `fps` as bit rows: bit j of row i is set if i and j are at most `radius` apart, j != i.

    Carry-save counters (ones, twos, fours, ...) add one plane's differences for
    all lanes; after some planes the words whose lanes have all gone over the
    radius are dropped from the work.
    """
    m = len(fps)
    p = planes(fps)
    w = p.shape[1]
    out = np.zeros((m, w), np.uint64)
    lanes = np.full(w, ~np.uint64(0))
    if m % 64:
        lanes[-1] = np.uint64((1 << (m % 64)) - 1)
    for lo in range(0, m, max(1, chunk // w)):
        q = fps[lo : lo + max(1, chunk // w)]
        row = np.repeat(np.arange(len(q)), w)
        col = np.tile(np.arange(w), len(q))
        own = q[row]
        levels = radius.bit_length()
        count = [np.zeros(len(row), np.uint64) for _ in range(levels)]
        over = ~lanes[col]
        for k in range(64):
            x = p[k][col] ^ (np.uint64(0) - ((own >> np.uint64(k)) & np.uint64(1)))
            for i in range(levels):
                carry = count[i] & x
                count[i] ^= x
                x = carry
            over |= x
            if k in (11, 15, 19, 23, 31, 39, 47):
                live = np.flatnonzero(~(over | _above(count, radius)))
                if len(live) < 0.7 * len(row):
                    row, col, own, over = row[live], col[live], own[live], over[live]
                    count = [c[live] for c in count]
                    if not len(row):
                        break
        if len(row):
            out[lo + row, col] = ~(over | _above(count, radius))
    i = np.arange(m)
    out[i, i // 64] &= ~(np.uint64(1) << (i % 64).astype(np.uint64))
    return out


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over `radius`, by comparing from the highest bit."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], ~np.uint64(0))
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            equal = equal & count[i]
        else:
            above |= equal & count[i]
            equal = equal & ~count[i]
    return above


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a breadth-first spanning forest of a graph given as bit rows; each node is visited once."""
    m, w = adjacent.shape
    left = np.full(w, ~np.uint64(0))
    edges = []
    for start in np.flatnonzero(adjacent.any(1)).tolist():
        if not int(left[start // 64]) >> (start % 64) & 1:
            continue
        left[start // 64] &= ~(np.uint64(1) << np.uint64(start % 64))
        queue = [start]
        for u in queue:
            new = adjacent[u] & left
            if new.any():
                left &= ~new
                got = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little")).tolist()
                edges += [(u, v) for v in got]
                queue += got
    return edges


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by key. Small neighbouring keys are compared in one go: a link found across keys is a true link too."""
    held: list[np.ndarray] = []
    size = 0

    def links(fps: np.ndarray) -> pa.RecordBatch | None:
        fps = np.unique(fps)
        got = np.array(forest(linked(fps)), np.int64).reshape(-1, 2)
        ends = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[got[:, 0]]), pa.array(ends[got[:, 1]])], names=["u", "v"]) if len(got) else None

    key = None
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        ids = batch.column("part").to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1, len(ids)] if len(ids) else np.array([0])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if key is not None and ids[a] != key and size >= 512:
                if (out := links(np.concatenate(held))) is not None:
                    yield out
                held, size = [], 0
            key = ids[a]
            held.append(fps[a:b])
            size += b - a
    if size and (out := links(np.concatenate(held))) is not None:
        yield out


def blocks_for(n: int, radius: int = RADIUS, fill: int = FILL) -> int:
    """The fewest blocks whose keys hold `fill` of `n` even nodes or fewer on average, 16 at most."""
    b = radius + 1
    while b < 4 * radius and n >> (64 * (b - radius) // b) > fill:
        b += 1
    return b


def masks(b: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, as signed longs, of every choice of ``b - radius`` of `b` blocks."""
    cuts = [64 * i // b for i in range(b + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    got = [sum(block[i] for i in c) for c in combinations(range(b), b - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in got]


def links(nodes: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(u, v)``: edges of spanning forests of the links between the distinct ``fp`` of `nodes`."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(blocks_for(n, radius), radius))])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("fp", F.xxhash64("k.t", "k.key").alias("part"))
    hot = rows.groupBy("part").count().where(F.col("count") > tile).select("part", F.ceil(F.col("count") / tile).cast("int").alias("g"))
    # every hot key stands for over `tile` rows; beyond the bound Spark joins by a shuffle
    few = n * len(masks(blocks_for(n, radius), radius)) // tile <= 100_000
    dealt = rows.join(F.broadcast(hot) if few else hot, "part", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    tiles = F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.xxhash64(F.least(o, mine), F.greatest(o, mine))))
    dealt = dealt.select("fp", F.explode(F.when(F.col("g").isNull(), F.array(F.col("part"))).otherwise(F.transform(tiles, lambda x: F.xxhash64(F.col("part"), x)))).alias("part"))
    return dealt.repartition("part").sortWithinPartitions("part").select("part", "fp").mapInArrow(_compare, "u long, v long")


def named_nodes(own: DataFrame, order: Column) -> DataFrame:
    """``(fp, least, component)`` of each distinct ``fp`` of `own`, a written table: the least `order` of its rows, and the smallest fingerprint it reaches."""
    nodes = scratch.write(own.groupBy("fp").agg(F.min(order).alias("least")), "nodes")
    roots = connected_components(links(nodes, nodes.count()))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return scratch.write(named, "named")


def components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: the id, ``fp`` and ``component_id``, the smallest id reachable over links."""
    own = scratch.write(fingerprints(docs.select(id_col, text_col), text_col).select(id_col, "fp"), "simhash")
    return joined(own, id_col)


def joined(own: DataFrame, id_col: str) -> DataFrame:
    """`own`, a written table with ``fp``, and ``component_id``."""
    named = named_nodes(own, F.col(id_col))
    # written apart, so that the join's shuffles serve the join alone and a large component can be split
    least = scratch.write(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    return own.join(named.join(least, "component").select("fp", "component_id"), "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, with its own columns as they are, whatever their names."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    narrow = docs.select(F.col("doc_id").alias("__id"), key.alias("__key"), F.col("text").alias("__text"))
    own = scratch.write(fingerprints(narrow, "__text").select("__id", "__key", "fp"), "simhash")
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("i"), F.col("__key").alias("k"))
    # one column that is never null tells rows apart, so that the join and the last step share one shuffle
    row = lambda i, k: F.concat(F.coalesce(F.concat(F.lit("i"), i.cast("string")), F.lit("n")), F.lit(":"), k.cast("string")).alias("__row")
    first = named_nodes(own, order).groupBy("component").agg(F.min("least").alias("x")).select(row(F.col("x.i"), F.col("x.k")))
    rows = docs.select(row(F.col("doc_id"), key), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__whole"))
    return rows.join(first, "__row", "left_semi").dropDuplicates(["__row"]).select("__whole.*")

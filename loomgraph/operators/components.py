"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima (combined on the map side) and two equi-joins.
The minima are written first, so that both sides of a join are shuffled for the
join alone and the adaptive skew join can split a node of any degree. The number
of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from loomgraph import scratch
from loomgraph.ship import ship


#: Tables of more rows are never broadcast: files of repeated values are far smaller than their rows in memory.
FEW = 100_000


def _large_star(edges: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = scratch.write(low.select("u", F.least("u", "m").alias("m")), "low")
    return both.join(hint(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = scratch.write(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = down.join(hint(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges ``(a, b)`` that connect what was apart in `root`, a forest of flat trees, which is brought up to date.

    A root is the smallest node of its tree. In each turn every root with an edge
    to a smaller one takes one of them, so no circle closes, and of the trees that
    have edges left at most half stay roots.
    """
    kept, at = [], np.arange(len(a))
    while True:
        x, y = root[a[at]], root[b[at]]
        apart = x != y
        if not apart.any():
            return np.concatenate(kept) if kept else at[:0]
        at, x, y = at[apart], x[apart], y[apart]
        pick = np.full(len(root), -1)
        low = np.minimum(x, y)
        pick[np.maximum(x, y)] = np.arange(len(at))
        high = np.flatnonzero(pick >= 0)
        root[high] = low[pick[high]]
        kept.append(at[pick[high]])
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _joined(edges: DataFrame, whole: bool) -> DataFrame:
    """Of the edges ``(u, v)`` of each task: those of a forest or, of the `whole` table in one task, ``(node, component)``."""
    kind, names = edges.schema[0].dataType, ("node", "component") if whole else ("u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        coded = pa.concat_arrays([x.column(k) for k in (0, 1) for x in held]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        node, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b = np.split(rank[coded.indices.to_numpy()], 2)
        root = np.arange(len(order))
        kept = join_roots(root, a, b)
        out = [node, node.take(pa.array(root))] if whole else [node.take(pa.array(x[kept])) for x in (a, b)]
        yield from pa.Table.from_arrays(out, names=list(names)).to_batches(1 << 16)

    return (edges.repartition(1) if whole else edges).mapInArrow(run, StructType([StructField(x, kind) for x in names]))


def connected_components(edges: DataFrame, max_rounds: int = 60, one: int = 0) -> DataFrame:
    """Return ``(node, component)`` for every node that has an edge.

    `edges` has two columns of one orderable type; direction, loops, repeats and
    null ends are ignored. `component` is the smallest node of the component.
    Of integers or strings, up to `one` edges are connected by a single task; of
    more, tasks of so many each leave a forest, while that halves them, and only
    then are there rounds.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    kind = edges.schema[a].dataType
    if one and kind == edges.schema[b].dataType and (isinstance(kind, IntegralType) or kind == StringType()):
        ship(spark)
        left = scratch.write(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null"), "links")
        n, before = left.count(), None
        while n > one and (before is None or 2 * n <= before):
            # loops stay for the sake of lone nodes
            forest = scratch.write(_joined(left.where("u != v").repartition(-(-n // one)), False).unionByName(left.where("u = v").distinct()), "links")
            scratch.drop(spark, left)
            left, n, before = forest, forest.count(), n
        if n <= one:
            own = scratch.write(_joined(left, True), "cc")
            return own.hint("merge") if own.count() > FEW else own
        edges, a, b = left, "u", "v"
    # written once: the edges may be costly to find
    own = scratch.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null").distinct(), "cc")
    loops = own.where("u = v").select("u")
    now, first = own.where("u != v"), True
    key = F.xxhash64("u", "v").cast("decimal(38,0)")
    seen = None
    # edges never grow by rounds; the rows of a written table are counted from its footers
    hint = (lambda x: x.hint("merge")) if own.count() > FEW else (lambda x: x)
    for _ in range(max_rounds):
        new = scratch.write(_small_star(_large_star(now, hint), hint).distinct(), "cc")
        mark = tuple(new.agg(F.count("*"), F.sum(key)).first())
        if not first:
            scratch.drop(spark, now)
        now, first = new, False
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    lone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return stars.unionByName(roots).unionByName(lone).groupBy("node").agg(F.min("component").alias("component"))

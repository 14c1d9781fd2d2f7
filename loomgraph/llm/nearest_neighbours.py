"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner product becomes distance by one more coordinate: with M the largest norm,
x is taken as (x, sqrt(M^2 - |x|^2)) and a query as (q, 0), so the nearest are
those of largest inner product. Centroids are fitted on a bounded sample by
k-means; clusters over the wanted size are split. A graph over the centroids,
held in memory, is searched best-first for each vector and each query. Boundary
vectors are written to every list whose centroid is nearly as near as the
nearest, up to `COPIES`; how near is `BOUNDARY` at most, and fitted: of several
shares of boundary vectors that which lets the sample's queries compare the fewest rows. A query visits all lists whose distance is
within a ratio of its nearest list's. The ratio is fitted: the least with which
`TARGET` of the nearest pairs within the sample would be met. No number caps the
lists: the beam of the graph search doubles until it holds every list within the
ratio. A query that finds fewer than were asked for visits all lists.

Every row is indexed. A list of more than `CHUNK` vectors is dealt to several
tasks by a hash of id and vector, and the queries that visit it go to each of
them. A chunk's vectors are held, its queries stream past. Scores are block
products in double precision; those that could be among the best are computed
again in one fixed order, so equal vectors score equally and ties go to the
smaller id.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part; a repeated id counts once,
with its best score; with fewer candidates than asked for, all are returned; an
empty table gives an empty table; columns other than id and vector are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.ship import ship

SAMPLE, LIST_SIZE, MOST_CENTROIDS = 20_000, 500, 4096
#: Most copies of a vector, the farthest that a boundary vector's further lists are, and the shares of boundary vectors that are tried.
COPIES, BOUNDARY, SHARES = 4, 1.08, (0.05, 0.1, 0.2, 0.4)
#: Share of the sample's nearest pairs that the fitted ratio must meet, and the queries that fit it.
TARGET, TRIALS = 0.95, 1000
#: A chunk's vectors, a centroid's links, a query's beam at first, a vector's beam.
CHUNK, DEGREE, BEAM, NARROW = 4096, 12, 32, 16
#: Rows of results that a task combines at once.
HELD = 1 << 20
#: Pairs of queries and lists written at once.
PAIRS = 1 << 16


def usable(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """``(id, v, asks)`` with `v` in double precision, each row once, without vectors that take no part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), fine.alias("fine"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce("fine", F.lit(False))).drop("fine")
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (most[0] if most else 0)).dropDuplicates(["id", "v", "asks"])


@dataclass(frozen=True)
class Lists:
    """Centroids of lifted vectors, their graph, the norm that lifts, how much farther a boundary vector's other lists are at most, and a query's."""

    centroids: np.ndarray
    graph: np.ndarray
    top: float
    boundary: float = BOUNDARY
    ratio: float = 1.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.top**2 - (x * x).sum(1)))]

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each copy of the lifted vectors `x`."""
        return self.copies(*self.search(x, NARROW))

    def copies(self, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each copy, from what `search` found."""
        d = np.sqrt(d)
        rank = np.arange(ids.shape[1])[None, :]
        take = ((d <= self.boundary * d[:, :1] + 1e-12) & (rank < COPIES)) | (rank == 0)
        r, c = np.nonzero(take & (ids >= 0))
        return r, ids[r, c]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each visit of the lifted queries `x`: every list within the ratio."""
        rows, lists = [], []
        todo, beam = np.arange(len(x)), BEAM
        while len(todo):
            ids, d = self.search(x[todo], beam)
            near = (ids >= 0) & (d <= self.ratio**2 * d[:, :1] + 1e-12)
            more = near.all(1) if beam < len(self.centroids) else np.zeros(len(todo), bool)
            r, c = np.nonzero(near & ~more[:, None])
            rows.append(todo[r])
            lists.append(ids[r, c])
            todo, beam = todo[more], 2 * beam
        return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *lists])

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nearest `beam` centroids of each row of `x` and their squared distances, nearest first.

        Best-first search over the graph, all rows in step, entered at the best
        of 4 sqrt(k) centroids; with no more centroids than that all are known at once.
        """
        c, g = self.centroids, self.graph
        k, n = len(c), len(x)
        beam = min(beam, k)
        norms, own = (c * c).sum(1), (x * x).sum(1)
        starts = np.unique(np.linspace(0, k - 1, min(k, max(beam, int(4 * k**0.5)))).astype(int))
        dist = own[:, None] + norms[starts] - 2 * x @ c[starts].T
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist = starts[order], np.take_along_axis(dist, order, 1)
        if len(starts) == k:
            return ids, np.maximum(dist, 0)
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids = np.c_[ids, np.full((n, pad), -1)]
            dist = np.c_[dist, np.full((n, pad), np.inf)]
        seen = np.zeros((n, k), bool)
        seen[:, starts] = True
        done = np.zeros((n, k), bool)
        live = np.arange(n)
        while len(live):
            i, d = ids[live], dist[live]
            fresh = ~done[live[:, None], i] & (i >= 0)
            any_ = fresh.any(1)
            live, i, d, fresh = live[any_], i[any_], d[any_], fresh[any_]
            if not len(live):
                break
            at = i[np.arange(len(live)), fresh.argmax(1)]
            done[live, at] = True
            near = g[at]
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            nd = np.where(new, own[live][:, None] + norms[near] - 2 * np.matmul(c[near], x[live][:, :, None])[..., 0], np.inf)
            # a short list of links is padded by the node itself, which is seen
            i, d = np.c_[i, near], np.c_[d, nd]
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids[live], dist[live] = np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)
        return np.where(np.isfinite(dist), ids, -1), np.maximum(dist, 0)


def _kmeans(x: np.ndarray, k: int, rnd: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rnd.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], c)
    return c


def fit(sample: np.ndarray, top: float, lists: int, seed: int = 5, pairs: int = 20) -> Lists:
    """Centroids of about equal shares of `sample`: clusters of over twice the share are split while their vectors differ."""
    rnd = np.random.default_rng(seed)
    made = Lists(np.zeros((0, sample.shape[1] + 1)), np.zeros((0, 0), int), top)
    x = np.unique(made.lift(sample), axis=0)
    k = max(1, min(lists, len(x)))
    todo, out = [(x, k)], []
    while todo:
        part, k = todo.pop()
        if k <= 1 or len(part) <= 2:
            out.append(part.mean(0))
            continue
        c = _kmeans(part, min(k, len(part)), rnd)
        own = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
        share = len(part) / k
        for j in range(len(c)):
            some = part[own == j]
            if len(some) > 2 * share and len(some) < len(part):
                todo.append((some, max(2, round(len(some) / share))))
            elif len(some):
                out.append(some.mean(0))
    c = np.array(out)
    near = np.argsort((c * c).sum(1) - 2 * c @ c.T, axis=1)[:, : min(len(c), DEGREE + 1)]
    links = [set(near[i].tolist()) - {i} for i in range(len(c))]
    for i in range(len(c)):
        for j in near[i].tolist():
            if j != i:
                links[j].add(i)
    # links that others have to a hub are kept on their side; the hub itself keeps its nearest
    links = [sorted(s, key=lambda j, i=i: ((c[i] - c[j]) ** 2).sum())[: 2 * DEGREE] for i, s in enumerate(links)]
    wide = max(1, max(map(len, links), default=1))
    graph = np.array([s + [i] * (wide - len(s)) for i, s in enumerate(links)], int).reshape(len(c), wide)
    return calibrated(Lists(c, graph, top), x, pairs)


def calibrated(lists: Lists, x: np.ndarray, pairs: int) -> Lists:
    """`lists` with the boundary and the ratio that the lifted sample `x` asks for.

    For each share of boundary vectors the ratio is the least that meets
    `TARGET` of the trials' `pairs` nearest; the share that compares the fewest rows is taken.
    """
    k = len(lists.centroids)
    if k < 2 or len(x) < 3:
        return lists
    found = lists.search(x, NARROW)
    d = np.sqrt(found[1][:, :2])
    apart = d[:, 1] / np.maximum(d[:, 0], 1e-300)
    trial = np.arange(0, len(x), max(1, -(-len(x) // TRIALS)))
    q = np.c_[x[trial, :-1], np.zeros(len(trial))]
    c = lists.centroids
    to = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * q @ c.T))
    to /= np.maximum(to.min(1), 1e-300)[:, None]
    n = min(pairs, len(x) - 1)
    near = np.empty((len(trial), n), int)
    for a in range(0, len(trial), 100):
        score = q[a : a + 100] @ x.T
        score[np.arange(len(score)), trial[a : a + 100]] = -np.inf
        near[a : a + 100] = np.argpartition(-score, n - 1, axis=1)[:, :n]
    best = None
    for share in SHARES:
        tried = replace(lists, boundary=float(min(BOUNDARY, np.quantile(apart, share))))
        r, at = tried.copies(*found)
        size = np.bincount(at, minlength=k)
        copies = np.full((len(x), COPIES), -1)
        copies[r, np.arange(len(r)) - np.searchsorted(r, r)] = at
        home = copies[near]
        need = np.where(home >= 0, to[np.arange(len(trial))[:, None, None], home], np.inf).min(2)
        ratio = float(np.quantile(need, TARGET)) * (1 + 1e-9)
        cost = float(((to <= ratio) @ size).mean())
        if best is None or cost < best[0]:
            best = cost, replace(tried, ratio=ratio)
    return best[1]


def _matrix(col: pa.Array) -> np.ndarray:
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _assigned(rows: DataFrame, lists: Lists, query: bool, every: bool = False) -> DataFrame:
    """``(list, id, v)``: the lists that hold each vector, or that each query visits (all of them, if `every`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(lists.centroids)
        for batch in batches:
            step = max(1, PAIRS // k) if query else 2048
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = _matrix(part.column(1))
                if every:
                    r, c = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
                else:
                    r, c = lists.visits(np.c_[x, np.zeros(len(x))]) if query else lists.homes(lists.lift(x))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r))], names=["list", "id", "v"])

    return rows.select("id", "v").mapInArrow(run, "list int, id long, v array<double>")


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and exact scores of its `k` best rows of `x`, its own id left out."""
    for lo in range(0, len(q), 256):
        scores = q[lo : lo + 256] @ x.T
        for i, s in enumerate(scores):
            s = np.where(x_ids == q_ids[lo + i], -np.inf, s)
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                at = np.flatnonzero(s >= least - 1e-9 * (1 + abs(least))) if np.isfinite(least) else np.flatnonzero(np.isfinite(s))
            else:
                at = np.flatnonzero(np.isfinite(s))
            exact = (x[at] * q[lo + i]).sum(1)
            order = np.lexsort((x_ids[at], -exact))[:k]
            yield int(q_ids[lo + i]), x_ids[at][order], exact[order]


def _least(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` best of each query; an id counts once, with its best score."""
    order = np.lexsort((-scores, ids, q))
    q, ids, scores = q[order], ids[order], scores[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]
    q, ids, scores = q[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = rank < k
    return q[keep], ids[keep], scores[keep]


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Best of each query over the (list, chunk)s of a partition sorted by them: a chunk's vectors first, which are held, then its queries, which stream past.

    Results of several lists are combined before they leave the task; those of
    more queries than fit in `HELD` rows leave earlier.
    """
    key, held, ids, x, spare = None, [], None, None, 0
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def combined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _least(*(np.concatenate([r[i] for r in rows]) for i in range(3)), k)

    def out(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["query_id", "vec_id", "score"])

    for batch in batches:
        part, side = batch.column("part").to_numpy(), batch.column("side").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(part) | np.diff(side)) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            some = batch.slice(a, b - a)
            if part[a] != key:
                key, held, x = part[a], [], None
            if side[a] == 0:
                held.append(some)
                continue
            if not held:
                continue
            if x is None:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                ids, x = t.column("id").to_numpy(), _matrix(t.column("v"))
                # an id with several vectors may fill several places
                spare = len(x) - len(np.unique(ids))
            for q, found, scores in best(_matrix(some.column("v")), some.column("id").to_numpy(), x, ids, k + spare):
                rows.append((np.full(len(found), q), found, scores))
                size += len(found)
            if size > HELD:
                got = combined()
                rows, size = [got], len(got[0])
                if size > HELD // 2:
                    yield out(got)
                    rows, size = [], 0
    if rows:
        yield out(combined())


def index(rows: DataFrame, n: int, top: float, k: int = 20, sample: int = SAMPLE, list_size: int | None = None) -> Lists:
    """Lists fitted on about `sample` of the `n` rows, those with the smallest hash: a threshold keeps the rest from leaving their tasks."""
    key = F.xxhash64("id", "v")
    some = rows
    if n > sample:
        share = 1.2 * sample / n
        some = rows.where(key < F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1))
    got = some.select("v", key.alias("h")).toArrow().combine_chunks()
    x = _matrix(got.column("v").combine_chunks())
    x = x[np.argsort(got.column("h").to_numpy(), kind="stable")[:sample]]
    return fit(x, top, min(MOST_CENTROIDS, max(1, n // (list_size or LIST_SIZE))), pairs=max(1, -(-k * len(x) // n)))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that satisfies `is_query`, its `k` nearest other rows found; with `exact` every list is visited."""
    spark = vectors.sparkSession
    ship(spark)
    rows = scratch.write(usable(vectors, id_col, vec_col, is_query), "vectors")
    n, top = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = index(rows, n, float(top), k)
    held = scratch.write(_assigned(rows, lists, False), "postings")
    # one row for each list, `MOST_CENTROIDS` at most
    parts = [(r[0], -(-r[1] // CHUNK)) for r in held.groupBy("list").count().collect()]
    parts = spark.createDataFrame(parts, "list int, parts int")
    queries = rows.where("asks").select("id", "v")
    found = _nearest(held, _assigned(queries, lists, True, exact), parts, k)
    if exact:
        return found
    found = scratch.write(found, "found")
    # the visited lists of some held too few: those queries visit every list
    short = queries.select("id").distinct().join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    short = scratch.write(queries.join(short, "id", "left_semi"), "short")
    if not short.limit(1).count():
        return found
    rest = _nearest(held, _assigned(short, lists, True, True), parts, k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)


def _nearest(held: DataFrame, asked: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """The `k` best of each query over the lists that it visits."""
    parts = F.broadcast(parts)
    mine = held.join(parts, "list").select("list", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("chunk"), "id", "v", F.lit(0).alias("side"))
    asked = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "id", "v", F.lit(1).alias("side"))
    both = asked.unionByName(mine).withColumn("part", F.xxhash64("list", "chunk"))
    dealt = both.repartition("part").sortWithinPartitions("part", "side", "id").select("part", "side", "id", "v")
    found = dealt.mapInArrow(lambda it: _searched(it, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

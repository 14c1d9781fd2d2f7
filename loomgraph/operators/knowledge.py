"""Domain knowledge graphs: keyword concepts, importance, density merging, domain relations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from loomgraph import scratch
from loomgraph.functions.text import cosine, let, words
from loomgraph.operators.components import connected_components, join_roots
from loomgraph.ship import ship

# Keywords of concepts, weights of types, words of verb contexts.
CONCEPTS = (
    ("profession", (("planner", "Urban Planning"), ("urban planner", "Urban Planning"), ("city council", "Government Work"), ("neighborhoods", "Urban Planning"), ("parks", "Urban Planning"), ("bike paths", "Urban Planning"))),
    ("hobby", (("woodworking", "Woodworking"), ("guitar", "Music"), ("acoustic", "Music"), ("jam", "Music"), ("birdwatching", "Nature Activities"), ("community garden", "Gardening"), ("grow veggies", "Gardening"))),
    ("location", (("house", "Residence"), ("shed", "Workshop"), ("workshop", "Workshop"), ("local park", "Park"), ("community garden", "Community Space"))),
)
TYPE_WEIGHTS = (("profession", 0.9), ("hobby", 0.8), ("location", 0.7), ("person", 1.0), ("concept", 0.5))
VERB_CONTEXTS = (("works_in", "work job profession"), ("practices", "love enjoy hobby practice"), ("lives_in", "live house home"), ("volunteers_at", "help volunteer"), ("creates", "build make create"))


def concepts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, name, entity_type)`` of the concepts whose keywords a text has, each once."""
    low = F.lower(text_col)
    all_ = F.array(*[F.when(F.contains(low, F.lit(k)), F.struct(F.lit(v).alias("name"), F.lit(t).alias("entity_type"))) for t, pairs in CONCEPTS for k, v in pairs])
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.array_compact(all_))).alias("c")).select("id", "c.*")


def importance(confidence: Column, name: Column, kind: Column, text: Column) -> Column:
    """.3 of the confidence, .2 for each mention (.4 at most), the type's weight, .2 for several words; 1 at most."""
    low = F.lower(text)
    count = (F.length(low) - F.length(F.replace(low, F.lower(name), F.lit("")))) / F.length(name)
    weight = None
    for k, w in TYPE_WEIGHTS:
        weight = (F if weight is None else weight).when(kind == k, F.lit(w))
    return F.least(F.lit(1.0), confidence * 0.3 + F.least(count * 0.2, F.lit(0.4)) + weight.otherwise(F.lit(0.3)) + F.when(F.size(words(name)) > 1, 0.2).otherwise(0.0))


def verb_context(text: Column) -> Column:
    out = None
    for kind, ws in VERB_CONTEXTS:
        hit = reduce(Column.__or__, [F.contains(F.lower(text), F.lit(w)) for w in ws.split()])
        out = (F if out is None else out).when(hit, F.lit(kind))
    return out


def domain_relations(entities: DataFrame) -> DataFrame:
    """The first person of each text (by name) with its professions, hobbies and places."""
    person = entities.where("entity_type = 'person'").groupBy("id").agg(F.min("name").alias("source"))
    name = F.lower("name")
    kind = (
        F.when(F.col("entity_type") == "profession", "works_in")
        .when(F.col("entity_type") == "hobby", "practices")
        .when((F.col("entity_type") == "location") & (F.contains(name, F.lit("house")) | F.contains(name, F.lit("residence"))), "lives_in")
        .when((F.col("entity_type") == "location") & F.contains(name, F.lit("garden")), "volunteers_at")
    )
    out = entities.withColumn("relationship_type", kind).where("relationship_type is not null").join(person, "id")
    return out.select("id", "source", F.col("name").alias("target"), "relationship_type", F.when(F.col("relationship_type") == "volunteers_at", 0.8).otherwise(0.9).alias("confidence"))


#: Numbers and rows of a block at most, and rows multiplied with a block at once: what a worker holds is two blocks and a strip of products.
NUMBERS, BLOCK, STRIP = 1 << 21, 1 << 15, 256
#: Links that one task connects.
LINKS = 1 << 21


def _usable(v: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    return F.coalesce(F.forall(v, lambda x: F.abs(x) < float("inf")) & F.exists(v, lambda x: x != 0), F.lit(False))


def _meetings(vectors: DataFrame, least: float, id_col: str, vec_col: str, cells: int) -> DataFrame:
    """Rows ``(id, v, cell, own, sent, side)``: any two within the angle meet under a key (cell, own, sent), one on each side.

    Vectors go to cells by their nearest anchor (a fixed set of rows). By the
    triangle inequality on angles, a pair within angle t shares the cell of one
    of them if the other is sent to every anchor within its own nearest angle
    + 2t. Where 2t is so wide that next to nothing would be left out, there is
    one cell (-1), in which a pair of blocks meets once. Cells are dealt to
    blocks by hash, each of which meets each block sent to the cell.
    """
    t = math.acos(max(-1.0, min(1.0, least)))
    single = vectors.schema[vec_col].dataType.elementType == FloatType()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v")).where(_usable(F.col("v")))
    if 2 * t > math.pi / 2:
        own = sent = rows.withColumn("cell", F.lit(-1))
    else:
        # by their largest component first, lest squares leave the range of doubles
        unit = let(F.array_max(F.transform("v", F.abs)), lambda most: F.transform("v", lambda x: x.cast("double") / most))
        anchors = [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(cells).select(unit).collect()]
        angle = F.array(*[F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("_u"), F.array(*[F.lit(float(x)) for x in a]))))) for a in anchors] or [F.lit(0.0)])
        keyed = scratch.write(rows.withColumn("_u", unit).withColumn("_a", angle).drop("_u").withColumn("_near", F.array_min("_a")), "angles")
        own = keyed.select("id", "v", (F.array_position("_a", F.col("_near")) - 1).cast("int").alias("cell"))
        sent = keyed.select("id", "v", F.explode(F.filter(F.transform("_a", lambda x, i: F.when(x <= F.col("_near") + 2 * t + 1e-9, i)), lambda i: i.isNotNull())).alias("cell"))
    # counts of the cells, a fixed number of rows; small tables are cut finer, for more tasks
    seen = [side.groupBy("cell").agg(F.count("*"), F.max(F.size("v"))).collect() for side in ((own,) if own is sent else (own, sent))]
    counts, longest = [{r[0]: r[1] for r in side} for side in seen], max((r[2] for r in seen[0]), default=1)
    size = max(256, min(BLOCK, NUMBERS // longest, sum(counts[0].values()) // 8))
    n_own, n_sent = ({c: -(-n // size) for c, n in x.items()} for x in (counts[0], counts[-1]))
    if not n_own:
        return own.withColumns({x: F.lit(0) for x in ("own", "sent", "side")}).where("false")
    blocks = lambda n: F.element_at(F.create_map(*[F.lit(x) for kv in n.items() for x in kv]), F.col("cell"))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), blocks(n)).cast("int")
    # in the one cell a block meets those from its own number on, as the other side those up to it
    first = F.when(F.col("cell") < 0, F.col("own")).otherwise(F.lit(0))
    last = F.when(F.col("cell") < 0, F.col("sent")).otherwise(blocks(n_own) - 1)
    left = own.where(F.col("cell").isin(list(n_sent))).withColumn("own", deal(n_own)).withColumn("sent", F.explode(F.sequence(first, blocks(n_sent) - 1))).withColumn("side", F.lit(0))
    right = sent.where(F.col("cell").isin(list(n_own))).withColumn("sent", deal(n_sent)).withColumn("own", F.explode(F.sequence(F.lit(0), last))).withColumn("side", F.lit(1))
    return left.unionByName(right)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in the components' order like `cosine`."""
    dot, a, b = (np.zeros(len(x)) for _ in range(3))
    for k in range(x.shape[1]):
        dot += x[:, k] * y[:, k]
        a += x[:, k] * x[:, k]
        b += y[:, k] * y[:, k]
    return dot / (np.sqrt(a) * np.sqrt(b))


def _near_rows(batches: Iterator[pa.RecordBatch], least: float, root: list[np.ndarray] | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Strips of one key's group: ids of its rows, places of near pairs among them, and cosines.

    With `root`, to which a forest of the group's rows is added (see `join_roots`),
    pairs that it connects already are left out, and cosines are exact only near the bound.
    """
    table = pa.Table.from_batches(list(batches))
    ids, side = table["id"].combine_chunks(), table["side"].to_numpy()
    v = table["v"].combine_chunks()
    length, flat = pc.list_value_length(v).to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).astype(float)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
    if root is not None:
        root.append(np.arange(len(ids)))
    for d in np.unique(length):
        mine, their = (np.flatnonzero((length == d) & (side == s)) for s in (0, 1))
        # powers of two change no digit, and keep squares within range
        x, y = ((lambda m: np.ldexp(m, -np.frexp(np.abs(m).max(1, initial=0))[1][:, None]))(flat[start[at][:, None] + np.arange(d)]) for at in (mine, their))
        # single precision finds what may be near: more than it can be wrong by is left to the exact sums
        ux, uy = ((m / np.sqrt((m * m).sum(1))[:, None]).astype(np.float32) for m in (x, y))
        wrong = 2.4e-7 * (d + 8)
        for s in range(0, len(mine), STRIP):
            rows, every = np.arange(s, min(s + STRIP, len(mine))), np.arange(len(their))
            parts = [(rows, every)]
            if root is not None and len(their):
                # those of the commonest tree need not meet each other
                now = root[0][their]
                tree = np.bincount(now).argmax()
                known = root[0][mine[rows]] == tree
                parts = [(rows[~known], every), (rows[known], np.flatnonzero(now != tree))]
            for p, q in parts:
                if not len(p) or not len(q):
                    continue
                product = (ux[p] @ (uy if len(q) == len(uy) else uy[q]).T).ravel()
                hit = np.flatnonzero(product > np.float32(least - wrong))
                for k in range(0, len(hit), 1 << 18):
                    at = hit[k : k + (1 << 18)]
                    a, b = np.divmod(at, len(q))
                    a, b = p[a], q[b]
                    c = product[at].astype(float)
                    unsure = np.arange(len(a))
                    if root is not None:
                        apart = root[0][mine[a]] != root[0][their[b]]
                        a, b, c = a[apart], b[apart], c[apart]
                        unsure = np.flatnonzero(c <= least + wrong)
                    c[unsure] = _exact(x[a[unsure]], y[b[unsure]])
                    yield ids, mine[a][c > least], their[b][c > least], c[c > least]


def near_vectors(vectors: DataFrame, least: float = 0.8, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = 16, margin: float | None = None) -> DataFrame:
    """Pairs (a < b) of vectors with cosine over `least`, exactly.

    Blocks of vectors that may hold such pairs (`_meetings`) are multiplied as
    matrices; what is near the bound is settled by sums in the order of `cosine`.
    Vectors that are null, zero or not finite, or of another length, are near none.
    """
    ship(vectors.sparkSession)
    rows = _meetings(vectors, least, id_col, vec_col, cells)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, a, b, c in _near_rows(batches, least):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(c)], names=["id", "id2", "cosine"])

    both = rows.groupBy("cell", "own", "sent").applyInArrow(run, StructType([StructField("id", kind), StructField("id2", kind), StructField("cosine", DoubleType())])).where("id != id2")
    return both.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "cosine").dropDuplicates(["a", "b"])


def near_links(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = 16) -> DataFrame:
    """Some of the pairs of `near_vectors`, by which the same vectors are connected: of two blocks, at most one link for each of their rows."""
    ship(vectors.sparkSession)
    rows = _meetings(vectors, least, id_col, vec_col, cells)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: list[np.ndarray] = []
        for ids, a, b, _ in _near_rows(batches, least, root):
            kept = join_roots(root[0], a, b)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[kept])) for x in (a, b)], names=["a", "b"])

    return rows.groupBy("cell", "own", "sent").applyInArrow(run, StructType([StructField("a", kind), StructField("b", kind)])).where("a != b")


def density_clusters(vectors: DataFrame, eps: float = 0.3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Density clusters with two members at least: connected vectors within cosine distance `eps`."""
    return connected_components(near_links(vectors, 1 - eps, id_col, vec_col), one=LINKS)


def merge_clusters(entities: DataFrame, found: DataFrame) -> DataFrame:
    """`entities` (with ``id`` and ``importance``) in which the most important member (ties to the smallest id) stands for its cluster of `found`.

    ``cluster_id`` and ``n_members`` are added; entities in no cluster stay as they are, with null and 1.
    The other members' names are the rows of `found` with that ``component``.
    """
    own = entities.join(found.select(F.col("node").alias("id"), F.col("component").alias("cluster_id")), "id", "left")
    best = own.where("cluster_id is not null").groupBy("cluster_id").agg(F.min(F.struct((-F.col("importance")).alias("i"), "id")).alias("b"), F.count("*").alias("n_members"))
    base = best.select(F.col("b.id").alias("id"), "n_members")
    return own.join(base, "id", "left").where("cluster_id is null or n_members is not null").withColumn("n_members", F.coalesce("n_members", F.lit(1).cast("long")))


def graph(entities: DataFrame, relations: DataFrame, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Entities and relations over `least` confidence, relations with both ends among the entities."""
    e = entities.where(F.col("confidence") > least)
    ends = e.select("id", "text").distinct()
    r = relations.where(F.col("confidence") > least)
    for end in ("source", "target"):
        r = r.join(ends.withColumnRenamed("text", end), ["id", end], "left_semi")
    return e, r

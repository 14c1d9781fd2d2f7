"""Resolution of duplicate entities: candidate pairs, a cascade of similarities, clusters.

Candidates are ``(id, name, entity_type)`` with optional ``embedding`` and
``confidence``. Entities of one type (or of type "unknown" with any) are a match
if they share an alias, if their names are near, or if their embeddings are.
Each of the three has a join of its own that loses no pair over the threshold:
equality of aliases, common segments of names (`near_names`) and anchors of
vectors (`near_vectors`); no word needs to be shared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomgraph import scratch
from loomgraph.functions.text import aliases, cosine, fuzzy_similarity, normalised_name
from loomgraph.operators.components import connected_components
from loomgraph.operators.knowledge import near_vectors
from loomgraph.ship import ship

SIMILAR, FUZZY, SEMANTIC = 0.8, 0.85, 0.7


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching characters of two short texts, in Arrow batches (no built-in has it)."""

    @pandas_udf("double")
    def ratio(x: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, q in x:
            yield pd.Series([SequenceMatcher(None, (i or "").lower(), (j or "").lower()).ratio() for i, j in zip(p, q, strict=True)], dtype="float64")

    return ratio(a, b)


def keyed(entities: DataFrame) -> DataFrame:
    """Entities with their type, normalised name and aliases, and the text that their fuzzy similarity compares."""
    kind = F.lower(F.coalesce("entity_type", F.lit("unknown")))
    return entities.withColumns({"_kind": kind, "_norm": normalised_name(F.col("name")), "_alias": aliases(F.col("name"), F.col("entity_type")), "_text": F.lower("name")})


def near_names(left: DataFrame, right: DataFrame | None = None, least: float = FUZZY, fuzzy: str = "ratio") -> DataFrame:
    """Distinct pairs ``(x, y)`` of the texts in column ``_text`` that may reach `least`; every pair that does is among them.

    With one table, pairs of its unlike texts, each once; with two, x is of `left`
    and y of `right`, equal ones included. A similarity of `least` leaves room for
    so many edits of the longer text; cut into one more segments than that, one of
    them stands unchanged in the shorter text, not far from its place. So texts meet
    on segments (and a band of lengths), and are kept if place, length and edit
    distance agree. Repeated texts are compared once. Empty texts meet nothing.
    """
    slack = 1 - least
    if not 0 <= slack < (1 if fuzzy == "distance" else 0.5):
        raise ValueError(f"least must be over {0 if fuzzy == 'distance' else 0.5} and at most 1")
    edits = lambda l, s: F.floor((l if fuzzy == "distance" else l + s) * F.lit(slack) + F.lit(1e-9)).cast("int")
    # the longest text that one of length 1 may meet is so much longer
    reach = 1 / least if fuzzy == "distance" else (1 + slack) / least
    band = lambda n: F.floor(F.log(n) / F.lit(max(math.log(reach), 0.01))).cast("int")
    texts = lambda df: df.where(F.length("_text") > 0).select(F.col("_text").alias("t"), F.length("_text").alias("n")).distinct()

    def cut(df: DataFrame) -> DataFrame:
        n, parts = F.col("n"), F.least(edits(F.col("n"), F.col("n")) + 1, F.col("n"))
        start = lambda k: F.floor(k * n / parts).cast("int")
        segment = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(start(k).alias("at"), F.substring(F.col("t"), start(k) + 1, start(k + 1) - start(k)).alias("segment")))
        return texts(df).withColumn("s", F.explode(segment)).select(F.col("t").alias("long"), F.col("n").alias("ln"), band(n).alias("band"), "s.segment", F.col("s.at").alias("la"))

    def windows(df: DataFrame) -> DataFrame:
        n = F.col("n")
        parts = lambda l: F.least(edits(l, l) + 1, l)
        longest = F.floor(n * F.lit(reach) + F.lit(1e-9)).cast("int")
        sizes = F.array_distinct(F.flatten(F.transform(F.sequence(n, longest), lambda l: F.array(F.floor(l / parts(l)), F.ceil(l / parts(l))).cast("array<int>"))))
        own = texts(df).withColumns({"b": F.sequence(band(n), band(longest)), "w": F.explode(sizes)}).where("w <= n")
        own = own.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("w"))))
        return own.select(F.col("t").alias("short"), F.col("n").alias("sn"), F.explode("b").alias("band"), F.expr("substring(t, at + 1, w)").alias("segment"), F.col("at").alias("sa"))

    def meet(longer: DataFrame, shorter: DataFrame, ordered: str) -> DataFrame:
        room = edits(F.col("ln"), F.col("sn"))
        shift, gap = F.col("la") - F.col("sa"), F.col("ln") - F.col("sn")
        both = cut(longer).join(windows(shorter), ["band", "segment"]).where(ordered).where(F.abs(shift) + F.abs(gap - shift) <= room)
        both = both.select("long", "short", room.alias("room")).distinct()
        return both.where(F.levenshtein("long", "short") <= F.col("room"))

    if right is None:
        return meet(left, left, "ln > sn or (ln = sn and long < short)").select(F.col("long").alias("x"), F.col("short").alias("y"))
    one = meet(left, right, "ln >= sn").select(F.col("long").alias("x"), F.col("short").alias("y"))
    return one.unionByName(meet(right, left, "ln > sn").select(F.col("short").alias("x"), F.col("long").alias("y")))


def _side(own: DataFrame, s: str) -> DataFrame:
    return own.select(*[F.col(c).alias(f"{c.strip('_')}_{s}") for c in ("id", "name", "_kind", "_norm", "_alias", "_text", "embedding") if c in own.columns])


def _by_alias(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("_k", F.explode("alias_a")).join(b.withColumn("_k", F.explode("alias_b")), "_k").drop("_k")


TYPES_MEET = "(kind_a = kind_b or kind_a = 'unknown' or kind_b = 'unknown')"


def pairs(entities: DataFrame, fuzzy: str = "ratio") -> DataFrame:
    """Pairs with id_a < id_b whose types meet and that may be a match, each once: all that share an alias, or have near names or embeddings."""
    own = scratch.write(keyed(entities), "keyed")
    a, b = _side(own, "a"), _side(own, "b")
    near = near_names(own.withColumn("_text", F.trim("_text")) if fuzzy == "distance" else own, None, FUZZY, fuzzy)
    both_ways = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    near = scratch.write(near.select(F.explode(both_ways).alias("p")).select("p.x", "p.y"), "near-names")
    text = (lambda c: F.trim(c)) if fuzzy == "distance" else F.col
    out = _by_alias(a, b).unionByName(a.join(near, text("text_a") == F.col("x")).join(b, text("text_b") == F.col("y")).drop("x", "y"))
    if "embedding" in entities.columns:
        like = near_vectors(own.select("id", "embedding"), SEMANTIC - 1e-9, "id", "embedding").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
        out = out.unionByName(a.join(like, "id_a").join(b, "id_b"))
    return out.where(f"id_a < id_b and {TYPES_MEET}").dropDuplicates(["id_a", "id_b"])


def similarity(both: DataFrame, fuzzy: str = "ratio") -> DataFrame:
    """`both` with ``score`` and ``match_type``: exact 1, normalised .95, alias .9, else the larger of fuzzy and semantic.

    `fuzzy` is "ratio" (matching characters, in Python) or "distance" (edit distance, in the JVM).
    """
    ship(both.sparkSession)
    same = F.lower("name_a") == F.lower("name_b")
    norm = F.col("norm_a") == F.col("norm_b")
    alias = F.arrays_overlap("alias_a", "alias_b")
    f = sequence_ratio(F.col("name_a"), F.col("name_b")) if fuzzy == "ratio" else fuzzy_similarity(F.col("name_a"), F.col("name_b"))
    out = both.withColumn("_f", f)
    s = cosine(F.col("embedding_a"), F.col("embedding_b")) if {"embedding_a", "embedding_b"} <= set(both.columns) else F.lit(0.0)
    out = out.withColumn("_s", s)
    return out.withColumns({
        "score": F.when(same, 1.0).when(norm, 0.95).when(alias, 0.9).otherwise(F.greatest("_f", "_s")),
        "match_type": F.when(same, "exact").when(norm, "normalized").when(alias, "alias").when(F.col("_f") > F.col("_s"), "fuzzy").otherwise("semantic"),
    }).drop("_f", "_s")


def matches(entities: DataFrame, fuzzy: str = "ratio") -> DataFrame:
    """Pairs whose score reaches the threshold of their kind of match."""
    out = similarity(pairs(entities, fuzzy), fuzzy)
    least = F.when(F.col("match_type") == "fuzzy", FUZZY).when(F.col("match_type") == "semantic", SEMANTIC).otherwise(SIMILAR)
    return out.where(F.col("score") >= least).select("id_a", "id_b", "score", "match_type")


def clusters(entities: DataFrame, found: DataFrame) -> DataFrame:
    """``(cluster, canonical, size, confidence)`` of connected matches; the most confident member, ties to the longest name, is canonical."""
    own = connected_components(found.select("id_a", "id_b")).withColumnRenamed("node", "id")
    conf = F.coalesce("confidence", F.lit(1.0)) if "confidence" in entities.columns else F.lit(1.0)
    member = entities.join(own, "id").withColumn("_c", conf)
    score = found.select(F.col("id_a").alias("id"), "score").join(own, "id").groupBy("component").agg(F.avg("score").alias("confidence"))
    out = member.groupBy("component").agg(F.max_by("id", F.struct("_c", F.length("name"), "id")).alias("canonical"), F.count("*").alias("size"))
    return out.join(score, "component").select(F.col("component").alias("cluster"), "canonical", "size", "confidence")


def representatives(entities: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One entity for each cluster, and the clusters' aliases.

    The first table has ``(id, name, entity_type, cluster_size, resolution_confidence)`` with the canonical
    member's name and type and the id "resolved_" and the cluster's. The second has ``(id, alias)``, the
    members' other names, each once; a row for each, since a cluster may have any number.
    """
    own = scratch.write(clusters(entities, found), "clusters")
    name = F.concat(F.lit("resolved_"), F.col("cluster").cast("string"))
    first = own.join(entities.select(F.col("id").alias("canonical"), "name", "entity_type"), "canonical")
    out = first.select(name.alias("id"), "name", "entity_type", F.col("size").alias("cluster_size"), F.col("confidence").alias("resolution_confidence"))
    member = connected_components(found.select("id_a", "id_b")).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    names = entities.join(member, "id").select(name.alias("id"), F.col("name").alias("alias")).distinct()
    return out, names.join(out.select("id", F.col("name").alias("alias")), ["id", "alias"], "left_anti")


def merge(canonical: Column, duplicate: Column) -> Column:
    """Two records (structs of aliases, mentions, properties, confidence): lists joined, the canonical's properties win, confidence weighted by mentions."""
    a, b = canonical, duplicate
    n, m = F.size(a["mentions"]), F.size(b["mentions"])
    total = F.greatest(n + m, F.lit(1))
    return F.struct(
        F.array_union(a["aliases"], b["aliases"]).alias("aliases"),
        F.concat(a["mentions"], b["mentions"]).alias("mentions"),
        F.map_concat(F.map_filter(b["properties"], lambda k, v: ~F.map_contains_key(a["properties"], k)), a["properties"]).alias("properties"),
        ((a["confidence"] * n + b["confidence"] * m) / total).alias("confidence"),
    )


def resolve(new: DataFrame, registry: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``(id, match, score)``: the registered entity that each new one is most like (ties to the smaller id), null below `least`."""
    own, known = (scratch.write(keyed(df).withColumn("_text", F.trim("_text")), "keyed") for df in (new, registry))
    a, b = _side(own, "a"), _side(known, "b")
    near = scratch.write(near_names(own, known, least, "distance"), "near-names")
    both = _by_alias(a, b).unionByName(a.join(near, F.col("text_a") == F.col("x")).join(b, F.col("text_b") == F.col("y")).drop("x", "y"))
    if "embedding_a" in a.columns and "embedding_b" in b.columns:
        ends = [df.select(F.struct(F.lit(k).alias("k"), F.col("id").cast("string").alias("id")).alias("e"), "embedding") for k, df in enumerate((own, known))]
        like = near_vectors(ends[0].unionByName(ends[1]), least - 1e-9, "e", "embedding").where("a.k = 0 and b.k = 1").select(F.col("a.id").alias("ia"), F.col("b.id").alias("ib"))
        both = both.unionByName(a.join(like, F.col("id_a").cast("string") == F.col("ia")).join(b, F.col("id_b").cast("string") == F.col("ib")).drop("ia", "ib"))
    both = both.where(TYPES_MEET).dropDuplicates(["id_a", "id_b"])
    scored = similarity(both, "distance").where(F.col("score") >= least)
    best = scored.groupBy("id_a").agg(F.min(F.struct((-F.col("score")).alias("score"), "id_b")).alias("x"))
    return new.select("id").join(best, F.col("id") == F.col("id_a"), "left").select("id", F.col("x.id_b").alias("match"), (-F.col("x.score")).alias("score"))


def similar_existing(new: DataFrame, existing: DataFrame, least: float = 0.85) -> DataFrame:
    """``(id, match)``: the entity of the same id, else the first by id whose name is `least` similar."""
    same = new.join(existing.select(F.col("id").alias("match")), F.col("id") == F.col("match")).select(F.col("id").alias("new_id"), "match", F.lit(0).alias("r"))
    a, b = (df.withColumn("_text", F.trim(F.lower("name"))) for df in (new, existing))
    alike = near_names(a, b, least, "distance").where(fuzzy_similarity(F.col("x"), F.col("y")) >= least)
    first = alike.join(b.select(F.col("id").alias("match"), F.col("_text").alias("y")), "y").groupBy("x").agg(F.min("match").alias("match"))
    near = a.select(F.col("id").alias("new_id"), F.col("_text").alias("x")).join(first, "x").select("new_id", "match", F.lit(1).alias("r"))
    w = Window.partitionBy("new_id").orderBy("r", "match")
    return same.unionByName(near).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("new_id").alias("id"), "match")


def statistics(found: DataFrame) -> DataFrame:
    return found.groupBy("match_type").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


def add_embeddings(entities: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: Column | None = None) -> DataFrame:
    """`entities` with ``embedding`` of a text (default: the name), by any model; `make` loads it once for each task."""
    ship(entities.sparkSession)

    @pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            yield pd.Series(model([x or "" for x in part]))

    return entities.withColumn("embedding", embed(F.col("name") if text is None else text))

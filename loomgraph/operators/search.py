"""Relevance-ranked search over entities, relationships and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import matches, relevance


def top(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Best first, ties by `key`; no limit if it is 0 or None."""
    out = df.where("relevance_score > 0").orderBy(F.desc("relevance_score"), key)
    return out.limit(limit) if limit else out


def weighted(df: DataFrame, query: str, fields: dict[str, tuple[Column, float]], regex_score: float = 0.0, **options) -> DataFrame:
    """`df` with ``relevance_score``, the best of the fields' weighted scores, and ``matched_fields``.

    A field counts if it matches under `options` (case, pattern, fuzzy). A match
    by pattern alone scores `regex_score`; by default that is 0 and drops it.
    """
    fuzzy = {k: v for k, v in options.items() if k in ("fuzzy", "threshold")}
    score = {n: F.when(matches(query, c, **options), F.greatest(relevance(query, c, **fuzzy), F.lit(regex_score)) * w).otherwise(F.lit(0.0)) for n, (c, w) in fields.items()}
    out = df.withColumns({f"_s_{n}": s for n, s in score.items()})
    names = [F.when(F.col(f"_s_{n}") > 0, F.lit(n)) for n in fields]
    best = F.greatest(*[F.col(f"_s_{n}") for n in fields], F.lit(0.0))
    return out.withColumn("relevance_score", best).withColumn("matched_fields", F.array_compact(F.array(*names))).drop(*[f"_s_{n}" for n in fields])


def search_entities(entities: DataFrame, query: str, entity_type: str | None = None, limit: int | None = 50, observations: str | None = None, **options) -> DataFrame:
    """By name (1), type (.8) and each observation (.6)."""
    rows = entities.where(F.col("entity_type") == entity_type) if entity_type else entities
    fields = {"name": (F.col("name"), 1.0), "entity_type": (F.col("entity_type"), 0.8)}
    out = weighted(rows, query, fields, **options)
    if observations:
        fuzzy = {k: v for k, v in options.items() if k in ("fuzzy", "threshold")}
        own = F.coalesce(F.array_max(F.transform(observations, lambda o: F.when(matches(query, o, **{k: v for k, v in options.items() if k != "regex_score"}), relevance(query, o, **fuzzy)).otherwise(F.lit(0.0)))), F.lit(0.0)) * 0.6
        out = out.withColumn("_o", own)
        out = out.withColumns({"relevance_score": F.greatest("relevance_score", "_o"), "matched_fields": F.when(F.col("_o") > 0, F.array_append("matched_fields", F.lit("observations"))).otherwise(F.col("matched_fields"))}).drop("_o")
    return top(out, "id", limit)


def search_relationships(relationships: DataFrame, query: str, relationship_type: str | None = None, limit: int | None = 50, **options) -> DataFrame:
    """By type (1), context (.8), source (.6) and target (.6)."""
    rows = relationships.where(F.col("relationship_type") == relationship_type) if relationship_type else relationships
    fields = {"relationship_type": (F.col("relationship_type"), 1.0), "context": (F.col("context"), 0.8), "source": (F.col("source_entity_id"), 0.6), "target": (F.col("target_entity_id"), 0.6)}
    return top(weighted(rows, query, fields, **options), "id", limit)


def search_observations(observations: DataFrame, query: str, entity_id: str | None = None, limit: int | None = 50, **options) -> DataFrame:
    """By content (1) and owner (.7)."""
    rows = observations.where(F.col("entity_id") == entity_id) if entity_id else observations
    return top(weighted(rows, query, {"content": (F.col("content"), 1.0), "entity_id": (F.col("entity_id"), 0.7)}, **options), "id", limit)


def search_blob(df: DataFrame, query: str, blob: Column, limit: int | None = 50, fuzzy: bool = False, threshold: float = 0.8, key: str = "id") -> DataFrame:
    """By one text made of several fields."""
    return top(df.withColumn("relevance_score", relevance(query, blob, fuzzy=fuzzy, threshold=threshold)), key, limit)


def entity_blob(observations: Column | None = None) -> Column:
    joined = F.lit("") if observations is None else F.array_join(observations, " ")
    return F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("entity_type", F.lit("")), F.lit(" "), joined)


def relationship_blob(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """`relationships` with the names of both ends (unknown: empty) and ``blob``."""
    name = lambda side: entities.select(F.col("id").alias(f"{side}_entity_id"), F.col("name").alias(f"{side}_name"))
    out = relationships.join(name("source"), "source_entity_id", "left").join(name("target"), "target_entity_id", "left")
    out = out.withColumns({f"{s}_name": F.coalesce(f"{s}_name", F.lit("")) for s in ("source", "target")})
    return out.withColumn("blob", F.concat_ws(" ", F.coalesce("relationship_type", F.lit("")), F.coalesce("context", F.lit("")), "source_name", "target_name"))


def search_all(entities: DataFrame, relationships: DataFrame, observations: DataFrame, query: str, limit: int | None = 50, **options) -> DataFrame:
    """Everything, tagged with its kind, best first."""
    parts = [
        search_entities(entities, query, limit=None, **options).select(F.lit("entity").alias("kind"), "id", "relevance_score"),
        search_relationships(relationships, query, limit=None, **options).select(F.lit("relationship").alias("kind"), "id", "relevance_score"),
        search_observations(observations, query, limit=None, **options).select(F.lit("observation").alias("kind"), "id", "relevance_score"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.desc("relevance_score"), "kind", "id")
    return out.limit(limit) if limit else out

"""Banks of entities and relationships: queries, and mutations as DataFrames in, DataFrames out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import scratch

DEFAULT_BANK = "default"


def bank_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each table by bank; the default bank is always there."""
    out = None
    for name, df in tables.items():
        own = df.groupBy("bank").agg(F.count("*").alias("n")).select("bank", F.lit(name).alias("kind"), "n")
        out = own if out is None else out.unionByName(own)
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_count") for k in tables]
    some = next(iter(tables.values())).sparkSession.range(1).select(F.lit(DEFAULT_BANK).alias("bank"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("n"))
    return out.unionByName(some).groupBy("bank").agg(*sums)


def drop_bank(df: DataFrame, bank: str) -> DataFrame:
    if bank == DEFAULT_BANK:
        raise ValueError("the default bank can't be deleted")
    return df.where(~F.col("bank").eqNullSafe(F.lit(bank)))


def clear_bank(df: DataFrame, bank: str) -> DataFrame:
    return df.where(~F.col("bank").eqNullSafe(F.lit(bank)))


def query_entities(entities: DataFrame, entity_type: str | None = None, properties: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    out = entities.where(F.col("entity_type") == entity_type) if entity_type else entities
    for k, v in (properties or {}).items():
        out = out.where((F.col(k) if k in entities.columns else F.col("properties")[k]) == v)
    return out.orderBy("id").limit(limit) if limit else out


def query_relationships(relationships: DataFrame, relationship_type: str | None = None, source: str | None = None, target: str | None = None, properties: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    out = relationships
    for c, v in (("relationship_type", relationship_type), ("source_entity_id", source), ("target_entity_id", target), *(properties or {}).items()):
        if v is not None:
            out = out.where((F.col(c) if c in relationships.columns else F.col("properties")[c]) == v)
    return out.orderBy("id").limit(limit) if limit else out


def open_nodes(entities: DataFrame, ids: list[str]) -> DataFrame:
    """The named entities in the order they are asked for."""
    order = F.array_position(F.lit(list(ids)), F.col("id"))
    return entities.where(F.col("id").isin(ids)).withColumn("position", order - 1).orderBy("position")


def first_of(df: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def create_entities(entities: DataFrame, new: DataFrame, order: Iterable[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """All entities after the creation, and those that were created: ids already there are refused, the first of a repeated id wins."""
    made = first_of(new, "id", order).join(entities.select("id"), "id", "left_anti")
    return entities.unionByName(made, allowMissingColumns=True), made


def create_relationships(relationships: DataFrame, new: DataFrame, entities: DataFrame, order: Iterable[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """As `create_entities`; both ends must exist."""
    ids = entities.select("id")
    made = first_of(new, "id", order).join(relationships.select("id"), "id", "left_anti")
    for end in ("source_entity_id", "target_entity_id"):
        made = made.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return relationships.unionByName(made, allowMissingColumns=True), made


def upsert(df: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key."""
    return df.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update(df: DataFrame, ident: str, changes: dict[str, Column], key: str = "id") -> DataFrame:
    """Top-level fields of one row replaced."""
    return df.withColumns({c: F.when(F.col(key) == ident, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_entities(entities: DataFrame, relationships: DataFrame, ids: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities without `ids`; those with relationships stay unless the deletion cascades to them."""
    ends = relationships.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id"))
    gone = ids.select("id") if cascade else ids.select("id").join(ends, "id", "left_anti")
    kept = relationships
    if cascade:
        for end in ("source_entity_id", "target_entity_id"):
            kept = kept.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return entities.join(gone, "id", "left_anti"), kept


def delete_relationships(relationships: DataFrame, triples: DataFrame) -> DataFrame:
    return relationships.join(triples, ["source_entity_id", "target_entity_id", "relationship_type"], "left_anti")


def add_edges(relationships: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with ids ``source-target-n``, n going on from the number of edges there are, in the order of source, target and type."""
    made = row_index(new, ["source_entity_id", "target_entity_id", "relationship_type"], "_k")
    made = made.withColumn("id", F.concat_ws("-", "source_entity_id", "target_entity_id", (F.lit(relationships.count()) + F.col("_k")).cast("string"))).drop("_k")
    return relationships.unionByName(made, allowMissingColumns=True)


def row_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """`df` with the rank of each row in `order`, from 0: ranks within range partitions, moved on by the partitions before."""
    held = scratch.write(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "index")
    before, start = {}, 0
    for part, n in sorted(held.groupBy("_part").count().collect()):
        before[part] = start
        start += n
    moved = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.withColumn(name, (own + moved).cast("long")).drop("_part")


def add_observations(observations: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Observations whose owner exists are appended."""
    return observations.unionByName(new.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), allowMissingColumns=True)


def explode_observations(entities: DataFrame, column: str = "observations") -> DataFrame:
    """One row for each observation held by an entity."""
    return entities.select(F.col("id").alias("entity_id"), F.posexplode(column).alias("position", "content"))


def export_nodes(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """Nodes for drawing: size is one more than the number of observations."""
    n = observations.groupBy("entity_id").agg(F.count("*").alias("n"))
    out = entities.join(n, entities["id"] == n["entity_id"], "left")
    return out.select("id", F.coalesce("name", "id").alias("label"), F.coalesce("entity_type", F.lit("unknown")).alias("type"), (1 + F.coalesce("n", F.lit(0))).alias("size"))


def export_edges(relationships: DataFrame) -> DataFrame:
    kind = F.coalesce("relationship_type", F.lit("related_to"))
    return relationships.select(F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"), kind.alias("type"), kind.alias("label"))


def duplicate_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that break a unique index."""
    from loomgraph.functions.text import index_key

    return df.groupBy(index_key(*columns).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def new_edges(extracted: DataFrame, relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Extracted ``(source, target, relationship_type, confidence)`` that a bank lacks and whose ends it has, each once, with its highest confidence.

    An edge is the same if source, target and type are; rows with a null among these are left out.
    """
    key = ["source", "target", "relationship_type"]
    known = relationships.select(F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"), "relationship_type")
    # one row an edge before anything is joined, so repeated edges are combined where they are read
    out = extracted.groupBy(*key).agg(F.max("confidence").alias("confidence")).join(known, key, "left_anti")
    for end in ("source", "target"):
        out = out.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    return out.select(*key, "confidence")


#: Megabytes that an entity and a relationship are taken to need.
ENTITY_MB, RELATIONSHIP_MB = 0.001, 0.0005


def statistics(entities: DataFrame, relationships: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: counts, the estimated size, and the rows handled a second if `seconds` is given (a millisecond at least)."""
    n = entities.agg(F.count("*").alias("entity_count")).crossJoin(relationships.agg(F.count("*").alias("relationship_count")))
    out = n.withColumn("memory_mb", F.col("entity_count") * ENTITY_MB + F.col("relationship_count") * RELATIONSHIP_MB)
    if seconds is None:
        return out
    rate = lambda c: F.col(c) / F.lit(max(0.001, seconds))
    return out.withColumns({"entities_per_second": rate("entity_count"), "relationships_per_second": rate("relationship_count")})

"""Banks in files: legacy JSON, migration to the canonical tables, a registry of stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

_S = StringType()


def _struct(*names: str) -> StructType:
    return StructType([StructField(n, MapType(_S, _S) if n == "data" else _S) for n in names])


BANK = StructType([
    StructField("nodes", MapType(_S, _struct("id", "type", "data"))),
    StructField("edges", ArrayType(_struct("id", "source", "target", "type", "data"))),
    StructField("observations", ArrayType(_struct("id", "entity_id", "content", "timestamp"))),
    StructField("reasoning_steps", ArrayType(_struct("id", "description", "status", "timestamp"))),
])
LEGACY = StructType([StructField("memory_banks", MapType(_S, BANK)), StructField("current_bank", _S)])


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """``(bank, b)``: one row for each bank of each JSON file; files that don't parse give none."""
    return spark.read.schema(LEGACY).option("multiLine", True).json(path).where("memory_banks is not null").select(F.explode("memory_banks").alias("bank", "b"))


def migrate(banks: DataFrame) -> dict[str, DataFrame]:
    """Canonical tables of legacy banks: entities, relationships, observations, reasoning_steps."""
    node = banks.select("bank", F.explode("b.nodes").alias("key", "n"))
    edge = banks.select("bank", F.explode("b.edges").alias("e"))
    obs = banks.select("bank", F.explode("b.observations").alias("o"))
    step = banks.select("bank", F.posexplode("b.reasoning_steps").alias("k", "s"))
    ident = F.coalesce("n.id", "key")
    return {
        "entities": node.select("bank", ident.alias("id"), F.coalesce(F.col("n.data")["name"], ident).alias("name"), F.coalesce("n.type", F.lit("node")).alias("entity_type"), F.col("n.data").alias("properties")),
        "relationships": edge.select("bank", F.coalesce("e.id", F.concat_ws("-", "e.source", "e.target")).alias("id"), F.col("e.source").alias("source_entity_id"), F.col("e.target").alias("target_entity_id"), F.coalesce("e.type", F.lit("relation")).alias("relationship_type"), F.col("e.data").alias("properties")),
        "observations": obs.select("bank", "o.id", "o.entity_id", "o.content", F.col("o.timestamp").alias("timestamp")),
        "reasoning_steps": step.select("bank", "s.id", (F.col("k") + 1).alias("step_number"), F.col("s.description").alias("reasoning"), "s.status", F.col("s.timestamp").alias("timestamp")),
    }


def write_legacy(tables: dict[str, DataFrame], path: str) -> None:
    """Canonical tables back to one JSON line for each row of each kind (banks of any size)."""
    for kind, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{kind}")


_STORES: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def register_store(kind: str, make: Callable[..., dict[str, DataFrame]]) -> None:
    _STORES[kind] = make


def create_store(kind: str, *args, **options) -> dict[str, DataFrame]:
    """The tables of a store; unknown kinds are refused."""
    if kind not in _STORES:
        raise ValueError(f"unknown store {kind!r}; known: {', '.join(sorted(_STORES))}")
    return _STORES[kind](*args, **options)


register_store("memory", lambda **tables: dict(tables))
register_store("parquet", lambda spark, path, kinds=("entities", "relationships", "observations", "reasoning_steps"): {k: spark.read.parquet(f"{path}/{k}") for k in kinds})
register_store("legacy_json", lambda spark, path: migrate(read_legacy(spark, path)))

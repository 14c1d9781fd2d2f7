"""Canonical graph tables over a folder of Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ident(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _entity(df: DataFrame, bank: str, letter: str, key: str, name: str, kind: str, **properties: str) -> DataFrame:
    props = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), F.col(v).cast("string"))]) if properties else F.create_map().cast("map<string,string>")
    return df.select(F.lit(bank).alias("bank"), _ident(letter, key).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"), props.alias("properties"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (person), suppliers (organization), parts (concept), nations and regions (location)."""
    t = lambda n: table(spark, sf_dir, n)
    return reduce(
        DataFrame.unionByName,
        [
            _entity(t("customer"), "sales", "c", "c_custkey", "c_name", "person", segment="c_mktsegment", balance="c_acctbal"),
            _entity(t("supplier"), "sales", "s", "s_suppkey", "s_name", "organization", balance="s_acctbal"),
            _entity(t("part"), "catalogue", "p", "p_partkey", "p_name", "concept", category="p_type", brand="p_brand", size="p_size"),
            _entity(t("nation"), "geo", "n", "n_nationkey", "n_name", "location"),
            _entity(t("region"), "geo", "r", "r_regionkey", "r_name", "location"),
        ],
    )


def _edge(df: DataFrame, bank: str, kind: str, source: tuple[str, str], target: tuple[str, str], confidence: Column | None = None) -> DataFrame:
    s, t = _ident(*source), _ident(*target)
    c = F.lit(1.0) if confidence is None else confidence
    return df.select(F.lit(bank).alias("bank"), F.concat_ws("-", s, F.lit(kind), t).alias("id"), s.alias("source_entity_id"), t.alias("target_entity_id"), F.lit(kind).alias("relationship_type"), c.alias("confidence"), F.lit(1.0).alias("weight"), F.concat_ws(" ", s, F.lit(kind), t).alias("context"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers located in nations, nations part of regions."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        _edge(t("customer"), "sales", "located_in", ("c", "c_custkey"), ("n", "c_nationkey"), F.when(F.col("c_acctbal") < 0, 0.5).otherwise(0.9))
        .unionByName(_edge(t("supplier"), "sales", "located_in", ("s", "s_suppkey"), ("n", "s_nationkey"), F.lit(0.7)))
        .unionByName(_edge(t("nation"), "geo", "part_of", ("n", "n_nationkey"), ("r", "n_regionkey")))
    )


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of parts, once for each pair, with confidence from the mean discount."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.avg("l_discount").alias("d"))
    return _edge(own, "sales", "supplies", ("s", "l_suppkey"), ("p", "l_partkey"), F.round(1 - F.col("d"), 4))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).unionByName(supplies(spark, sf_dir))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers to nations of customers, where the volume is over the mean of all pairs; weight is the mean volume over the pair's."""
    t = lambda n: table(spark, sf_dir, n)
    own = (
        t("lineitem").select("l_orderkey", "l_suppkey")
        .join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey")
        .join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst")), "o_custkey")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    # at most as many rows as pairs of nations
    mean = own.agg((F.sum("n") / F.count("*")).alias("mean")).first()["mean"] or 0.0
    keep = own.where((F.col("n") > mean) & (F.col("src") != F.col("dst")))
    return keep.select("src", "dst", F.round(F.lit(mean) / F.col("n"), 6).alias("weight"), F.round(1 - F.lit(mean) / (2 * F.col("n")), 6).alias("confidence"), F.lit("ships_to").alias("edge_type"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("sales").alias("bank"), F.col("event_id").cast("string").alias("id"), _ident("c", "user_id").alias("entity_id"), F.concat_ws(" ", "event_type", "props").alias("content"), F.col("ts").alias("timestamp"))


def reasoning_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit("talk").alias("bank"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("turn").cast("int").alias("step_number"), F.col("text").alias("reasoning"), F.col("role").alias("thought"))


#: The same tables as DuckDB common table expressions.
SQL = """
entities AS (
  SELECT 'sales' AS bank, 'c' || c_custkey AS id, c_name AS name, 'person' AS entity_type, map {'segment': c_mktsegment} AS properties FROM customer
  UNION ALL SELECT 'sales', 's' || s_suppkey, s_name, 'organization', map {} FROM supplier
  UNION ALL SELECT 'catalogue', 'p' || p_partkey, p_name, 'concept', map {'category': p_type, 'brand': p_brand} FROM part
  UNION ALL SELECT 'geo', 'n' || n_nationkey, n_name, 'location', map {} FROM nation
  UNION ALL SELECT 'geo', 'r' || r_regionkey, r_name, 'location', map {} FROM region
), places AS (
  SELECT 'sales' AS bank, 'c' || c_custkey || '-located_in-n' || c_nationkey AS id, 'c' || c_custkey AS source_entity_id, 'n' || c_nationkey AS target_entity_id, 'located_in' AS relationship_type, CASE WHEN c_acctbal < 0 THEN 0.5 ELSE 0.9 END AS confidence FROM customer
  UNION ALL SELECT 'sales', 's' || s_suppkey || '-located_in-n' || s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, 'located_in', 0.7 FROM supplier
  UNION ALL SELECT 'geo', 'n' || n_nationkey || '-part_of-r' || n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 1.0 FROM nation
), supplies AS (
  SELECT DISTINCT 'sales' AS bank, 's' || l_suppkey || '-supplies-p' || l_partkey AS id, 's' || l_suppkey AS source_entity_id, 'p' || l_partkey AS target_entity_id, 'supplies' AS relationship_type FROM lineitem
), relationships AS (
  SELECT bank, id, source_entity_id, target_entity_id, relationship_type FROM places UNION ALL SELECT * FROM supplies
), observations AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 'c' || user_id AS entity_id, concat_ws(' ', event_type, props) AS content FROM events
), volume AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL
), trade AS (
  SELECT src, dst, round((SELECT sum(n) / count(*) FROM volume) / n, 6) AS weight FROM volume WHERE src <> dst AND n > (SELECT sum(n) / count(*) FROM volume)
)"""

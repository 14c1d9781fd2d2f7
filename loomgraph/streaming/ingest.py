"""Streams: texts into a growing graph, and events into windows of co-occurring types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import extraction, relations


def ingest_texts(docs: DataFrame, folder: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Entities and relations of streamed texts, appended to Parquet under `folder` by batch; a batch that is run again replaces its own part."""

    def each(batch: DataFrame, n: int) -> None:
        found = extraction.extract_entities(batch)
        found.write.mode("overwrite").parquet(f"{folder}/entities/batch={n}")
        relations.sentence_relations(batch, spark_read(batch.sparkSession, f"{folder}/entities/batch={n}", found)).write.mode("overwrite").parquet(f"{folder}/relations/batch={n}")
        if write:
            write(batch, n)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spark_read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and users by window and type; rows later than `late` are left to the watermark."""
    own = events.withWatermark("ts", late)
    return own.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "event_type", "n", "users")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    own = events.withWatermark("ts", late)
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

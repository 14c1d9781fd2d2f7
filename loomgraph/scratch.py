"""Tables written to the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs one re-read, never a recomputation from the source.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; where it names none, one below the warehouse, or a temporary one in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("at")
    if not at:
        if re.match(r"local(\[|$)", spark.sparkContext.master):
            at = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        else:
            at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomgraph-scratch"
        _OWN["at"] = at
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(at)
    return at


def write(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return the table read back."""
    spark, at = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._loomgraph_at = at
    return back


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by `write` once nothing reads it any more."""
    _delete(spark, df._loomgraph_at)


def clean(spark: SparkSession) -> int:
    """Delete every table this process has written; results that still read one of them must have been written elsewhere. Returns how many."""
    n = len(_MADE)
    while _MADE:
        _delete(spark, _MADE.pop())
    return n

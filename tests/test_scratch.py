from __future__ import annotations

import os

from loomgraph import scratch


def test_tables_are_written_and_deleted(spark):
    df = scratch.write(spark.range(5), "five")
    at = df._loomgraph_at.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(at)
    scratch.drop(spark, df)
    assert not os.path.isdir(at)
    other = scratch.write(spark.range(3), "three")._loomgraph_at.removeprefix("file://")
    assert os.path.isdir(other) and scratch.clean(spark) >= 1
    assert not os.path.isdir(other)


def test_folder_is_the_session_s(spark):
    assert scratch.folder(spark) == scratch.folder(spark)

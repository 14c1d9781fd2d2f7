from __future__ import annotations

from loomgraph.streaming import ingest


def test_texts_stream_into_tables(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "Alice works with Bob on the Project."), (2, None)], "doc_id int, text string").write.json(src)
    docs = spark.readStream.schema("doc_id int, text string").json(src)
    ingest.ingest_texts(docs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/entities"))
    assert {r.text for r in got.collect()} == {"Alice", "Bob", "Project"}
    assert spark.read.parquet(str(tmp_path / "out/relations")).count() == 3


def test_event_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 1L as user_id, 'click' as event_type union all select timestamp'2024-01-01 00:50:00', 2L, 'click' union all select timestamp'2024-01-01 03:00:00', 2L, 'view'").write.parquet(src)
    events = spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(src)
    q = ingest.event_windows(events).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.n) for r in spark.table("windows").collect()} == {("click", 2), ("view", 1)}

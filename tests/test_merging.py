"""Ingest of edges, figures of a store, merged clusters: small tables with nulls, ties and repeated rows."""

from __future__ import annotations

from loomgraph.operators import knowledge as K
from loomgraph.operators import resolution as N
from loomgraph.operators import store as S

EDGE = "source string, target string, relationship_type string, confidence double"


def test_new_edges(spark):
    entities = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    known = spark.createDataFrame([("a", "b", "knows")], "source_entity_id string, target_entity_id string, relationship_type string")
    seen = [("a", "b", "knows", 0.9), ("b", "a", "knows", 0.2), ("b", "a", "knows", 0.5), ("b", "a", "knows", None), ("a", "x", "knows", 1.0), (None, "b", "knows", 1.0)]
    assert [tuple(r) for r in S.new_edges(spark.createDataFrame(seen, EDGE), known, entities).collect()] == [("b", "a", "knows", 0.5)]
    assert S.new_edges(spark.createDataFrame([], EDGE), known, entities).count() == 0


def test_statistics_of_empty_and_small_stores(spark):
    rows = spark.range(3)
    assert S.statistics(rows, rows.limit(0)).first().asDict() == {"entity_count": 3, "relationship_count": 0, "memory_mb": 0.003}
    assert S.statistics(rows, rows, 0.0).first().entities_per_second == 3000


def test_representatives(spark):
    df = spark.createDataFrame([("1", "Jonathan", "person"), ("2", "Jonathann", "person"), ("3", "Zed", "person"), ("4", None, None)], "id string, name string, entity_type string")
    first, other = N.representatives(df, N.matches(df))
    assert [(r.id, r.name, r.cluster_size) for r in first.collect()] == [("resolved_1", "Jonathann", 2)]
    assert {r.alias for r in other.collect()} == {"Jonathan"}


def test_merge_clusters(spark):
    own = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.1)], "id long, importance double")
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long")
    assert sorted(((r.id, r.cluster_id, r.n_members) for r in K.merge_clusters(own, found).collect()), key=lambda r: r[0]) == [(2, 1, 3), (4, None, 1)]

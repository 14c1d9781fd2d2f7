from __future__ import annotations

import pytest

from loomgraph.operators import graph as G

NODES = ["alice", "bob", "company", "project"]
EDGES = [("alice", "company", "works_for", 0.9, 1.0), ("bob", "company", "works_for", 0.8, 1.0), ("alice", "bob", "knows", 0.7, 0.5), ("alice", "project", "manages", 0.95, 2.0), ("bob", "project", "contributes_to", 0.85, 1.5)]


@pytest.fixture(scope="module")
def work(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, edge_type string, confidence double, weight double"), spark.createDataFrame([(n,) for n in NODES], "id string")


def test_density_and_degree(work):
    r = G.density(*work).first()
    assert (r.density, r.average_degree) == (pytest.approx(5 / 12), 2.5)
    got = {x.id: x for x in G.degrees(*work).collect()}
    assert got["alice"].degree_centrality == 1
    assert got["company"].half_centrality == pytest.approx(1 / 3)
    assert sum(x.score for x in G.degree_share(*work).collect()) == pytest.approx(2)


def test_paths(work):
    e, _ = work
    p = G.shortest_path(e, "alice", "bob").collect()
    assert [(r.path, r.length, r.total_weight, r.edge_types, r.confidence) for r in p] == [(["alice", "bob"], 1, 0.5, ["knows"], 0.7)]
    assert G.shortest_path(e, "bob", "alice").count() == 0
    assert [(r.length, r.total_weight, r.confidence) for r in G.simple_paths(e, "alice", "project", 3).collect()] == [(1, 2.0, 0.95), (2, 2.0, 0.7)]
    assert [r.path for r in G.simple_paths(e, "alice", "alice").collect()] == [["alice"]]


def test_neighbourhood_and_subgraph(spark, work):
    e, n = work
    assert {r.id for r in G.neighbourhood(e, "alice").collect()} == set(NODES)
    assert G.neighbourhood(e, "nobody").count() == 0
    some = spark.createDataFrame([("alice",), ("bob",), ("company",)], "id string")
    nodes, edges = G.subgraph(e, some)
    assert (nodes.count(), edges.count()) == (4, 5)
    assert G.subgraph(e, some, both_ends=True)[1].count() == 3


def test_centralities(work):
    got = {r.id: r.betweenness for r in G.betweenness(*work).collect()}
    assert got["bob"] == pytest.approx(0.5 / 6) and got["alice"] == 0
    close = {r.id: r.closeness for r in G.closeness(*work).collect()}
    assert close["alice"] == 0 and close["bob"] == pytest.approx(2 / 3 * 1) or close["bob"] == pytest.approx(2 / 3)
    assert close["project"] == pytest.approx((2 / 3.5) * (2 / 3))
    rank = {r.id: r["rank"] for r in G.pagerank(*work).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-6) and rank["project"] > rank["alice"]


def test_components_clustering_diameter(work):
    r = G.communities(*work, min_size=2).collect()
    assert len(r) == 1 and r[0]["size"] == 4 and r[0].density == pytest.approx(5 / 12)
    c = [x.coefficient for x in G.clustering(*work).collect()]
    assert sum(c) / 4 == pytest.approx((2 / 3 + 2 / 3 + 2) / 4)
    assert G.diameter(*work) == 2
    assert G.hubs(*work).count() == 0


def test_cycles(spark, work):
    assert G.cycles(work[0]).count() == 0
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert [r.path for r in G.cycles(e).collect()] == [["a", "b", "c"]]


def test_cycles_of_any_length(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    e = spark.createDataFrame([*ring, ("a", "b"), ("b", "a"), ("a", "n0"), ("n5", "x")], "src string, dst string")
    assert sorted((r.path, r.length) for r in G.cycles(e).collect()) == [(["a", "b"], 2), ([f"n{i}" for i in range(9)], 9)]


def test_empty_graph(spark, work):
    e, n = work[0].where("false"), work[1]
    assert {r.component for r in G.components(e, n).collect()} == set(NODES)
    assert G.density(e, n).first().density == 0
    assert all(r.betweenness == 0 for r in G.betweenness(e, n).collect())


def test_long_chain_components(spark):
    e = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    got = G.components(e, spark.range(301).selectExpr("id"))
    assert {r.component for r in got.collect()} == {0}

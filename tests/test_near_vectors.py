"""Near vectors against comparing all pairs: odd vectors, copies, unlike lengths, any angle."""

from __future__ import annotations

import math
import random

import pytest

from loomgraph.operators import knowledge as K

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0] * 8, [NAN] * 8, [INF] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e-200] * 8, [1e200] * 8]


def vectors():
    rnd = random.Random(11)
    some = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(120)]
    near = [[x + rnd.gauss(0, 0.05) for x in v] for v in some[:40]]
    return list(enumerate(some + near + some[:30] + ODD))


def cosine(x, y):
    if x is None or y is None or len(x) != len(y) or not all(c is not None and math.isfinite(c) for c in x + y) or not any(x) or not any(y):
        return -2.0
    size = lambda v: [c / max(map(abs, v)) for c in v]
    x, y = size(x), size(y)
    return math.sumprod(x, y) / math.sqrt(math.sumprod(x, x) * math.sumprod(y, y))


@pytest.mark.parametrize("least", [-0.2, 0.3, 0.8, 0.97])
def test_near_vectors_lose_no_pair(spark, least):
    rows = vectors()
    got = {(r.a, r.b): r.cosine for r in K.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least).collect()}
    want = {(i, j): c for i, x in rows for j, y in rows[i + 1 :] if (c := cosine(x, y)) > least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_links_connect_like_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    root = {i: i for i, _ in rows}
    linked = set()
    for i, x in rows:
        for j, y in rows[:i]:
            if cosine(x, y) > 0.8:
                linked |= {i, j}
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert {(r.node, r.component) for r in K.density_clusters(df, 1 - 0.8).collect()} == {(i, root[i]) for i in linked}


def test_links_of_copies_are_few(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(1500)], "vec_id long, embedding array<double>")
    n = K.near_links(df, 0.35).count()
    assert n < 1500 * 12
    assert {tuple(r) for r in K.density_clusters(df, 0.65).collect()} == {(i, 0) for i in range(1500)}


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert K.near_vectors(df, 0.3).count() == K.near_vectors(df, 0.9).count() == K.density_clusters(df).count() == 0


def test_merged_clusters_of_copies(spark, tmp_path):
    from loomgraph.queries import QUERIES

    spark.range(1200).selectExpr("id as vec_id", "array(1f, 2f, 3f) as embedding", "0 as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    best = max(range(1200), key=lambda i: (i * 7919 % 1009, -i))
    assert [tuple(r)[:3] for r in QUERIES["n8_merged_clusters"](spark, str(tmp_path)).collect()] == [(best, 0, 1200)]


def test_links_are_connected_by_tasks(spark):
    """No rounds of joins where the links fit a task; where they don't, tasks leave forests first."""
    from loomgraph import scratch
    from loomgraph.operators.components import connected_components

    rnd = random.Random(5)
    for kind, form in (("bigint", lambda x: x), ("string", str)):
        rows = [(form(rnd.randrange(300)), form(rnd.randrange(300))) for _ in range(170)] + [(form(1), None)] + 700 * [(form(7), form(8))]
        root = {x: x for r in rows for x in r if None not in r}
        for u, v in rows:
            if v is not None and (a := root[u]) != (b := root[v]):
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
        edges = spark.createDataFrame(rows, f"u {kind}, v {kind}")
        made = len(scratch._MADE)
        assert {tuple(r) for r in connected_components(edges, one=1000).collect()} == set(root.items())
        assert len(scratch._MADE) - made == 2
        assert {tuple(r) for r in connected_components(edges, one=300).collect()} == set(root.items())
        assert {tuple(r) for r in connected_components(edges, one=20).collect()} == set(root.items())

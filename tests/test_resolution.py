"""Resolution against comparing all pairs: no match may be lost to the joins that find candidates."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resolution as N


def misspelt(rnd, name, edits):
    for _ in range(edits):
        i = rnd.randrange(len(name) + 1)
        name = rnd.choice([name[:i] + rnd.choice("abc ") + name[i:], name[:i] + name[i + 1 :], name[:i] + rnd.choice("abc ") + name[i + 1 :]])
    return name


def names():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 13, 20, 34]))) for _ in range(25)]
    return sorted({misspelt(rnd, x, k) for x in base for k in (0, 1, 2, 3, 5)} | {"", "é", "ééé b", "ééa b"})


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b, fuzzy):
    return 1 - distance(a, b) / max(len(a), len(b)) if fuzzy == "distance" else max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())


@pytest.mark.parametrize(("fuzzy", "least"), [("ratio", 0.85), ("ratio", 0.7), ("distance", 0.6), ("distance", 1.0)])
def test_near_names_lose_no_pair(spark, fuzzy, least):
    all_ = names()
    df = spark.createDataFrame([(x,) for x in all_], "_text string")
    found = {frozenset((r.x, r.y)) for r in N.near_names(df, None, least, fuzzy).collect()}
    assert all(len(p) == 2 for p in found)
    meant = {frozenset((x, y)) for i, x in enumerate(all_) for y in all_[:i] if x and y and alike(x, y, fuzzy) >= least}
    assert meant <= found and (meant or least == 1)
    left, right = all_[::2], all_[1::2] + all_[::10]
    two = {(r.x, r.y) for r in N.near_names(df.where(F.col("_text").isin(left)), df.where(F.col("_text").isin(right)), least, fuzzy).collect()}
    assert {(x, y) for x in left for y in right if x and y and alike(x, y, fuzzy) >= least} <= two


def test_matches_need_no_common_word(spark):
    rows = [
        ("a", "Microsoft", "company", [1.0, 0.0]),
        ("b", "Microsft", "company", [0.0, 1.0]),
        ("c", "Big Blue", "company", [1.0, 0.1]),
        ("d", "Microsoft", "person", [0.0, -1.0]),
        ("e", "Mikrosoft", None, None),
        ("f", None, "company", None),
        ("g", "", "company", None),
    ]
    df = spark.createDataFrame(rows, "id string, name string, entity_type string, embedding array<double>")
    got = {(r.id_a, r.id_b): r.match_type for r in N.matches(df).collect()}
    assert got == {("a", "b"): "fuzzy", ("a", "c"): "semantic", ("a", "e"): "fuzzy", ("d", "e"): "fuzzy"}
    new = spark.createDataFrame([("n", "Microsovt", "company", None), ("m", "Other", "company", [2.0, 0.0]), ("z", "zzz", "company", [0.0, 0.0])], df.schema)
    assert {r.id: r.match for r in N.resolve(new, df).collect()} == {"n": "a", "m": "a", "z": None}


def test_similar_existing_takes_the_first(spark):
    known = spark.createDataFrame([("k2", "Jonathon"), ("k1", "Jonathan"), ("k0", None), ("k3", "")], "id string, name string")
    new = spark.createDataFrame([("x", " jonathan "), ("k2", "other"), ("y", ""), ("w", None)], "id string, name string")
    assert {r.id: r.match for r in N.similar_existing(new, known).collect()} == {"x": "k1", "k2": "k2"}

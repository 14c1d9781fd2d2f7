"""Best links of proper nouns: a name that recurs meets its nearest occurrence, not all of them."""

from __future__ import annotations

import random

from loomgraph.operators import coreference as C

NAMES = ["IBM", "DE", "DER", "THE", "OF", "John Smith", "Smith John", "John Smithson", "Joan Company", "Joan Corp", "New City", "Rome, IT"]
WORDS = ["he", "it", "the company", "The CEO", "went", "x,", "Mr"]


def texts():
    rnd = random.Random(3)
    return [(i, ". ".join(" ".join(rnd.choice(NAMES + WORDS) for _ in range(rnd.randrange(6))) for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 40, 90])]


def test_nearest_links_hold_every_best_link(spark):
    m = C.mentions(spark.createDataFrame(texts(), "doc_id long, text string")).cache()
    every, near = (C.best_links(C.candidates(m, nearest=x)) for x in (False, True))
    want = sorted(map(tuple, every.collect()))
    assert want == sorted(map(tuple, near.collect())) and {x[-1] for x in want} == {"pronoun", "nominal", "proper"}


def test_a_recurring_name_is_not_paired_with_all_its_copies(spark):
    m = C.mentions(spark.createDataFrame([(1, "IBM sold. " * 3000)], "doc_id long, text string"))
    links = C.candidates(m, nearest=True)
    assert links.count() == 2999
    assert {(r.mention, r.antecedent) for r in C.best_links(links).collect()} == {(f"{i}:0", f"{i - 1}:0") for i in range(1, 3000)}


def test_sides_are_not_broadcast_by_the_size_of_their_files(spark):
    m = C.mentions(spark.createDataFrame([(1, "IBM sold. It grew. IBM did.")], "doc_id long, text string"))
    assert "BroadcastHashJoin" not in C.best_links(C.candidates(m, nearest=True))._jdf.queryExecution().executedPlan().toString()


def test_clusters_of_a_recurring_name(spark):
    m = C.mentions(spark.createDataFrame([(1, "IBM sold. " * 300), (2, "IBM and ACME. ACME did")], "doc_id long, text string"))
    links = C.candidates(m, nearest=True)
    assert links.count() == 299 + 1
    out = C.clusters(m, links)
    assert {(r.id, r.canonical, r.size) for r in out.collect()} == {(1, "IBM", 300), (2, "ACME", 2)}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()

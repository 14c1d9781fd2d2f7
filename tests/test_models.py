from __future__ import annotations

from loomgraph.operators import coreference, extraction, relations, resolution


def test_any_recogniser_can_be_plugged_in(spark):
    docs = spark.createDataFrame([(1, "Ann met Bo"), (2, None), (3, "")], "doc_id int, text string")

    def make():
        return lambda texts: [[(w, "name", 0.9, t.index(w), t.index(w) + len(w)) for w in t.split() if w.istitle()] for t in texts]

    assert sorted((r.id, r.text, r.start) for r in extraction.by_model(docs, make).collect()) == [(1, "Ann", 0), (1, "Bo", 8)]


def test_any_embedding_can_be_plugged_in(spark):
    df = spark.createDataFrame([("a", "alpha y", "t"), ("b", "alpha zebra", "t")], "id string, name string, entity_type string")
    own = resolution.add_embeddings(df, lambda: lambda names: [[1.0, float("y" in n)] for n in names])
    assert sorted(r.embedding for r in own.collect()) == [[1.0, 0.0], [1.0, 1.0]]
    assert [r.match_type for r in resolution.matches(own).collect()] == ["semantic"]


def test_empty_inputs_give_empty_results(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    found = extraction.extract_entities(docs)
    assert found.count() == 0
    assert relations.sentence_relations(docs, found).count() == 0
    assert relations.quick_relations(docs, found).count() == 0
    m = coreference.mentions(docs)
    assert coreference.clusters(m, coreference.candidates(m)).count() == 0
    people = spark.createDataFrame([], "id string, name string, entity_type string")
    assert resolution.clusters(people, resolution.matches(people)).count() == 0

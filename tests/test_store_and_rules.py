from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import consistency, extraction, knowledge, quality, relations, schema
from loomgraph.plans import api
from loomgraph.sources import banks

ENTITY = "id string, name string, entity_type string, properties map<string,string>"
RELATION = "id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double"


@pytest.mark.parametrize(
    ("query", "text", "plain", "fuzzy"),
    [("Goldman", "Goldmann", 0.7, 0.7), ("Goldmann", "Goldman", 0, 0.525), ("Goldmann", "Goldman Sachs", 0, 0.4375), ("Marcus", "Markus", 0, 0.5), ("Marcus", "Marcus", 1, 1), ("Marcus", "Marcus Goldman", 1.3, 1.3), ("Marcus", "marcus_goldman", 0.7, 0.7), ("", "anything", 0, 0), ("x", "", 0, 0), ("x", None, 0, 0)],
)
def test_relevance(spark, query, text, plain, fuzzy):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(X.relevance(query, F.col("t")).alias("a"), X.relevance(query, F.col("t"), fuzzy=True).alias("b")).first()
    assert (r.a, r.b) == (pytest.approx(plain), pytest.approx(fuzzy))


def test_quality_set(spark):
    e = spark.createDataFrame([("1", "John Smith", "Person", {}), ("2", "Google", "Organization", {}), ("3", "", "Person", {}), ("4", "Mountain View", "Location", {}), ("5", "John Smith", "Person", {})], ENTITY)
    r = spark.createDataFrame([("a", "1", "2", "works_at", 0.9), ("b", "2", "4", "located_in", 0.8)], RELATION)
    got = quality.report(e, r).first()
    assert (got.completeness, got.accuracy, got.connectivity, got.consistency, got.overall) == tuple(pytest.approx(x) for x in (1, 1, 0.35, 1, 0.87))
    assert quality.completeness(e).agg(F.avg("completeness")).first()[0] == pytest.approx(0.9)
    assert {x.bucket: x.n for x in quality.confidence_buckets(r).collect()} == {"high": 2, "medium": 0, "low": 0, "unknown": 0}
    issues = quality.issues(e, r)
    assert {x.subject for x in issues.where("issue_type = 'orphaned_entity'").collect()} == {"3", "5"}
    assert [x.n for x in quality.duplicate_names(e).collect()] == [2]
    assert len(quality.recommendations(quality.report(e, r), issues).collect()) == 3


def test_consistency_set(spark):
    e = spark.createDataFrame([("1", "John Smith", "Person", {"birth_date": "1990-01-01", "death_date": "1985-01-01"}), ("2", "Google", "Organization", {}), ("3", "Test", "Person", {})], ENTITY)
    r = spark.createDataFrame([("a", "1", "2", "works_at", None), ("b", "1", "999", "knows", None)], RELATION)
    got = {(v.severity, v.subject) for v in consistency.check(e, r).collect()}
    assert got == {("HIGH", "1"), ("CRITICAL", "b")}
    broken = consistency.check(e, r, {"odd": lambda a, b: a.select("nothing")}).collect()
    assert [v.severity for v in broken] == ["WARNING"]


def test_schema_validation(spark):
    rows = [("1", "A", "person", {"full_name": "A", "age": "30"}), ("2", "B", "person", {"age": "30"}), ("3", "C", "person", {"full_name": "C", "age": "-1"}), ("4", "D", "ghost", {})]
    s = schema.default_schema()
    got = {r.id: r.errors for r in schema.validate_entities(spark.createDataFrame(rows, ENTITY), s).collect()}
    assert got == {"1": [], "2": ["Required property 'full_name' missing"], "3": ["Property 'age' validation failed"], "4": ["Entity type 'ghost' not found in schema"]}
    assert schema.Schema.from_json(s.to_json()) == s
    with pytest.raises(ValueError, match="no parent"):
        s.add_entity_type(schema.EntityType("x", parent="nowhere"))
    s.add_entity_type(schema.EntityType("employee", parent="person"))
    assert s.ancestors("employee") == ["employee", "person"]


def test_bank_requests(spark):
    b = api.Bank(spark)
    rows = [{"id": f"e{i}", "name": f"Name {i}", "entity_type": "person"} for i in range(10)]
    assert b.create_entities(rows) == 10
    assert b.create_entities(rows) == 0
    assert b.create_relations([{"source_entity_id": "e1", "target_entity_id": "e2", "relationship_type": "knows"}, {"source_entity_id": "e1", "target_entity_id": "zz", "relationship_type": "knows"}]) == 1
    b.add_observations([{"id": "o1", "entity_id": "e1", "content": "tall"}, {"id": "o2", "entity_id": "zz", "content": "lost"}])
    assert api.answer(b, "observations").count() == 1
    assert [r.id for r in api.answer(b, "open_nodes", names=["e3", "e1"]).collect()] == ["e3", "e1"]
    assert api.answer(b, "search_nodes", query="name 7").first().id == "e7"
    assert api.answer(b, "analytics", analysis="metrics").first().m == 1
    b.delete_entities(["e1"], cascade=False)
    assert api.answer(b, "entities").count() == 10
    b.delete_entities(["e1"])
    assert (api.answer(b, "entities").count(), api.answer(b, "relations").count()) == (9, 0)
    new, edges = b.ingest(spark.createDataFrame([(1, "Alice works with Bob on the Project. Charlie manages the Project and coordinates with Alice.")], "doc_id int, text string"))
    assert (new.count(), edges.count()) == (4, 6)
    with pytest.raises(ValueError, match="default"):
        b.delete_bank("default")
    assert {r.bank: r.entities_count for r in b.list_banks().collect()} == {"default": 13}


def test_legacy_migration(spark, tmp_path):
    legacy = {"memory_banks": {"b1": {"nodes": {"n1": {"id": "n1", "type": "person", "data": {"name": "Ann"}}, "n2": {"id": "n2", "type": "organization", "data": {}}}, "edges": [{"id": "e1", "source": "n1", "target": "n2", "type": "works_for", "data": {}}], "observations": [{"id": "o1", "entity_id": "n1", "content": "x", "timestamp": "t"}], "reasoning_steps": [{"id": "r1", "description": "d", "status": "done", "timestamp": "t"}]}}, "current_bank": "b1"}
    (tmp_path / "banks.json").write_text(json.dumps(legacy, indent=1))
    got = banks.create_store("legacy_json", spark, str(tmp_path / "banks.json"))
    assert {k: v.count() for k, v in got.items()} == {"entities": 2, "relationships": 1, "observations": 1, "reasoning_steps": 1}
    assert {r.id: r.name for r in got["entities"].collect()} == {"n1": "Ann", "n2": "n2"}
    with pytest.raises(ValueError, match="unknown store"):
        banks.create_store("neo")


def test_pattern_classes_against_re(spark):
    texts = ["Ada used fooBar and \"deep idea\", mail a.b@x.org, see http://x.org/a?b=1 — 12 kg on 2024-01-02 and March 5, 2024", "Élle Baré Foo Été", "", None, "x" * 50_000, "测试文本 \x00 \x1f", "AAA " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.id, r.text): r.entity_type for r in extraction.extract_entities(df).collect()}
    stops = set(extraction.stop_words())
    want = {}
    for i, t in enumerate(texts):
        for kind, _, p, g in extraction.CLASSES:
            for m in re.finditer(p, t or ""):
                x = m[g]
                if kind not in extraction.CHECKED or (len(x.strip()) > 2 and x.lower().strip() not in stops and not x.strip().isdigit()):
                    want[i, x] = kind
    assert got == want
    assert {"email", "url", "date", "concept", "technical_term", "named_entity"} <= set(got.values())


def test_fixed_values():
    words = extraction.stop_words()
    assert len(words) == len(set(words)) == 330
    assert {"able", "bad", "different", "important", "long", "public", "remembering"} <= set(words)
    assert not {"seed", "goed", "geted", "runing"} & set(words)
    templates = [t for _, ts in relations.TEMPLATES for t in ts]
    assert len(templates) == 16 and all("{entity1}" in t and "{entity2}" in t for t in templates)
    assert relations.template_confidence(r"{entity1}\s+(?:in|at)\s+{entity2}") == pytest.approx(0.65)
    assert relations.template_confidence(templates[0]) == pytest.approx(0.75)


def test_template_relations_of_sentences(spark):
    texts = [
        (1, "Alice Johnson works for TechCorp Inc, which is located in San Francisco. John Smith founded TechCorp Inc.", ["Alice Johnson", "TechCorp Inc", "San Francisco", "John Smith"]),
        (2, "Dr. Sarah Chen works for Microsoft Corporation in Seattle.", ["Dr. Sarah Chen", "Microsoft Corporation", "Seattle"]),
        (3, "Apple Inc was founded by Steve Jobs and Steve Wozniak.", ["Apple Inc", "Steve Jobs", "Steve Wozniak"]),
        (4, "The headquarters of Google is located in Mountain View, California.", ["Google", "Mountain View", "California"]),
        (5, "", []),
    ]
    docs = spark.createDataFrame([x[:2] for x in texts], "doc_id int, text string")
    ends = spark.createDataFrame([(i, e) for i, _, es in texts for e in es], "id int, text string")
    got = relations.template_relations(docs, ends).groupBy("id", "source", "target", "relationship_type").agg(F.max("confidence").alias("c")).collect()
    assert {(r.id, r.source, r.target, r.relationship_type): round(r.c, 6) for r in got} == {
        (1, "Alice Johnson", "TechCorp Inc", "works_for"): 0.8,
        (1, "TechCorp Inc", "John Smith", "founded_by"): 0.75,
        (2, "Dr. Sarah Chen", "Microsoft Corporation", "works_for"): 0.8,
        (2, "Microsoft Corporation", "Seattle", "located_in"): 0.65,
        (3, "Apple Inc", "Steve Jobs", "founded_by"): 0.8,
        (4, "Google", "Mountain View", "located_in"): 0.8,
    }


def test_concepts_of_sentences(spark):
    docs = spark.createDataFrame([(1, "Abel is an urban planner. I love woodworking and the acoustic guitar, in my house by the community garden."), (2, "Nothing here.")], "doc_id int, text string")
    found = knowledge.concepts(docs)
    want = {("Urban Planning", "profession"), ("Woodworking", "hobby"), ("Music", "hobby"), ("Gardening", "hobby"), ("Residence", "location"), ("Community Space", "location")}
    assert {(r.id, r.name, r.entity_type) for r in found.collect()} == {(1, *x) for x in want}
    person = spark.createDataFrame([(1, "Abel", "person")], "id int, name string, entity_type string")
    got = {(r.source, r.target, r.relationship_type) for r in knowledge.domain_relations(found.unionByName(person)).collect()}
    assert got == {("Abel", "Urban Planning", "works_in"), ("Abel", "Woodworking", "practices"), ("Abel", "Music", "practices"), ("Abel", "Gardening", "practices"), ("Abel", "Residence", "lives_in")}


def test_entry_and_oracles():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 100

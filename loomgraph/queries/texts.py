"""Extraction, coreference, resolution and knowledge queries, over whole texts and over small written-out fixtures."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.operators import coreference as C
from loomgraph.operators import extraction as E
from loomgraph.operators import knowledge as K
from loomgraph.operators import relations as R
from loomgraph.operators import resolution as N
from loomgraph.sources import warehouse as W

INGEST = "Alice works with Bob on the Project. Charlie manages the Project and coordinates with Alice."
WATER = "Water flows into the ocean. \nThe sun heats the water. \nEvaporation creates water vapor."
COREF = [(1, "John Smith works at Apple Inc. He is the CEO of the company."), (2, "Microsoft Corporation was founded in 1975. It became a major tech company."), (3, "Alice and Bob started a company. They hired many employees.")]
PEOPLE = [("e1", "John Smith", "person"), ("e2", "Jonathan Smith", "person"), ("e3", "Microsoft Corporation", "organization"), ("e4", "Microsoft Corp", "organization"), ("e5", "Bob Stone", "person")]
#: A report on each customer, written from the tables; the same in Spark and DuckDB.
REPORT = """SELECT c_custkey AS doc_id, c_custkey, c_mktsegment, person, org, place,
  concat(person, ' works for ', org, '. ', org, ' is located in ', place, '.', CASE WHEN c_mktsegment = 'BUILDING' THEN concat(' As an urban planner, ', person, ' likes woodworking in the house.') ELSE '' END,
    ' CEO ', org, ' said so. The company headquarters at ', place, ' were founded.') AS text
  FROM (SELECT c_custkey, c_mktsegment, concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)), ' ', CAST(c_custkey AS {string})) AS person,
    concat(upper(substr(n_name, 1, 1)), lower(substr(n_name, 2, 4)), ' Corp') AS org, concat(upper(substr(r_name, 1, 1)), lower(substr(r_name, 2, 3))) AS place
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
REPORTS = f"WITH report AS ({REPORT.format(string='VARCHAR')})"


def _reports(s, d):
    for t in ("customer", "nation", "region"):
        W.table(s, d, t).createOrReplaceTempView(f"loomgraph_{t}")
    sql = REPORT.format(string="STRING")
    for t in ("customer", "nation", "region"):
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 loomgraph_{t}", sql)
    return s.sql(sql)


def _report_templates(s, d):
    r = _reports(s, d)
    ends = r.select(F.col("doc_id").alias("id"), F.explode(F.array("person", "org", "place")).alias("text"))
    return R.template_relations(r, ends).groupBy("id", "source", "target", "relationship_type").agg(F.round(F.max("confidence"), 6).alias("confidence"))


def _report_persons(s, d):
    r = _reports(s, d)
    return K.domain_relations(K.concepts(r).unionByName(r.select(F.col("doc_id").alias("id"), F.col("person").alias("name"), F.lit("person").alias("entity_type"))))


def _docs(s, d):
    return W.table(s, d, "documents")


def _one(s, rows, schema):
    return s.createDataFrame(rows, schema)


def _text(s, t):
    return _one(s, [(1, t)], "doc_id int, text string")


def _ingest(s, d):
    docs = _text(s, INGEST)
    return R.sentence_relations(docs, E.extract_entities(docs)).select("source", "target", "relationship_type", F.round("confidence", 6).alias("confidence"))


def _coref(s):
    m = C.mentions(_one(s, COREF, "doc_id int, text string"))
    at = lambda side: m.select("id", F.concat_ws(":", F.col("sentence").cast("string"), F.col("n").cast("string")).alias(side), F.col("text").alias(f"{side}_text"))
    links = C.candidates(m).where("method = 'pronoun' and confidence >= 0.4")
    return links.join(at("mention"), ["id", "mention"]).join(at("antecedent"), ["id", "antecedent"]).select("id", F.col("mention_text").alias("pronoun"), F.col("antecedent_text").alias("antecedent"), F.round("confidence", 3).alias("confidence"))


def _people(s):
    return _one(s, PEOPLE, "id string, name string, entity_type string")


def _merge(s, d):
    row = "struct<aliases:array<string>,mentions:array<string>,properties:map<string,string>,confidence:double>"
    df = s.sql(f"select cast(struct(array('a'), array('m1', 'm2'), map('k', '1'), 0.9) as {row}) as a, cast(struct(array('b', 'a'), array('m3'), map('k', '2', 'j', '3'), 0.6) as {row}) as b")
    return df.select(N.merge(F.col("a"), F.col("b")).alias("m")).select(F.array_join("m.aliases", ",").alias("aliases"), F.size("m.mentions").alias("mentions"), F.col("m.properties")["k"].alias("k"), F.col("m.properties")["j"].alias("j"), F.round("m.confidence", 6).alias("confidence"))


def _parts(s, d):
    """Part names of two words, once each, as entities."""
    return W.table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id")).select("id", "name", F.lit("concept").alias("entity_type"))


def _starts(s, d):
    """Pretend mentions: each order line is a mention at an offset of its order."""
    t = W.table(s, d, "lineitem")
    return t.select(F.col("l_suppkey").alias("id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("mention"), (F.col("l_orderkey") % 100_000 * 3).alias("start"))


QUERIES = {
    "e1_entities": lambda s, d: E.extract_entities(_docs(s, d)),
    "e2_pattern_entities": lambda s, d: E.by_pattern(_docs(s, d)).groupBy("id", "text", "entity_type").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("confidence")),
    "e3_indicator_entities": lambda s, d: E.by_indicator(_docs(s, d)),
    "e4_merged_candidates": lambda s, d: E.merge_candidates(E.by_pattern(_docs(s, d))).drop("methods").withColumn("confidence", F.round("confidence", 6)),
    "e6_schema_entities": lambda s, d: E.by_schema(_docs(s, d)),
    "e7_refined_entities": lambda s, d: E.by_refined_pattern(_docs(s, d)),
    "e8_contextual_entities": lambda s, d: E.by_context(_docs(s, d)),
    "e9_folded_overlaps": lambda s, d: E.fold_overlaps(E.by_pattern(_docs(s, d)).dropDuplicates(["id", "text", "entity_type"])),
    "e17_basic_entities": lambda s, d: E.basic_entities(_docs(s, d)).groupBy("id").agg(F.count("*").alias("n")),
    "e18_ensemble": lambda s, d: E.ensemble(_docs(s, d)).drop("methods"),
    "a29_extraction_statistics": lambda s, d: E.statistics(E.by_pattern(_docs(s, d))).select("entity_type", "n"),
    "s11_text_ingest": _ingest,
    "r1_sentence_relations": lambda s, d: R.sentence_relations(_docs(s, d), E.extract_entities(_docs(s, d))).groupBy("relationship_type").agg(F.count("*").alias("n")),
    "r2_template_relations": _report_templates,
    "r5_ranked_relations": lambda s, d: R.ranked(R.deduplicate(_report_templates(s, d)), ["works_for", "related_to"]).select("id", "source", "target", "relationship_type", F.round("confidence", 6).alias("confidence")),
    "e6_schema_texts": lambda s, d: E.by_schema(_docs(s, d)).groupBy("id", "text", "entity_type").agg(F.count("*").alias("n")),
    "e8_contextual_reports": lambda s, d: E.by_context(_reports(s, d)).groupBy("id", "text", "entity_type").agg(F.count("*").alias("n")),
    "e3_indicator_reports": lambda s, d: E.by_indicator(_reports(s, d)).groupBy("entity_type", "text").agg(F.count("*").alias("n")),
    "r6_phrase_relations": lambda s, d: R.phrase_relations(_text(s, WATER)),
    "r6_quick_relations": lambda s, d: R.quick_relations(_docs(s, d), E.basic_entities(_docs(s, d))).groupBy("relationship_type").agg(F.count("*").alias("n")),
    "r7_proximity": lambda s, d: R.proximity_relations(_starts(s, d)).groupBy("id").agg(F.count("*").alias("n")),
    "r10_basic_pronouns": lambda s, d: C.basic_pronouns(_docs(s, d)).groupBy("pronoun").agg(F.count("*").alias("n")),
    "c1_mentions": lambda s, d: C.mentions(_docs(s, d)).groupBy("kind", "entity_type").agg(F.count("*").alias("n")),
    "c2_pronoun_links": lambda s, d: _coref(s),
    "c5_best_links": lambda s, d: C.best_links(C.candidates(scratch.write(C.mentions(_docs(s, d)), "mentions"), nearest=True)).groupBy("method").agg(F.count("*").alias("n")),
    "n1_resolution_matches": lambda s, d: N.matches(_people(s)).select("id_a", "id_b", "match_type", F.round("score", 6).alias("score")),
    "n3_resolution_clusters": lambda s, d: N.clusters(_people(s), N.matches(_people(s))).select("cluster", "size", F.round("confidence", 6).alias("confidence")),
    "n2_part_matches": lambda s, d: N.matches(_parts(s, d), "distance").select("id_a", "id_b", "match_type", F.round("score", 6).alias("score")),
    "n4_resolve_online": lambda s, d: N.resolve(_one(s, [("q1", "Microsoft Corp.", "organization"), ("q2", "Zed", "person")], "id string, name string, entity_type string"), _people(s)),
    "n5_merge": _merge,
    "n7_similar_existing": lambda s, d: N.similar_existing(_one(s, [("new1", "Supplier#00000001"), ("c7", "whatever"), ("new2", "zzz")], "id string, name string"), W.entities(s, d)),
    "j20_near_embeddings": lambda s, d: K.near_vectors(W.table(s, d, "embeddings"), 0.3).select("a", "b", F.round("cosine", 5).alias("cosine")),
    "e14_density_clusters": lambda s, d: K.density_clusters(W.table(s, d, "embeddings"), 0.65),
    "x30_concepts": lambda s, d: K.concepts(_docs(s, d)),
    "x30_report_concepts": lambda s, d: K.concepts(_reports(s, d)),
    "e15_domain_relations": _report_persons,
    "e16_verb_context": lambda s, d: _one(s, [("I love tea",), ("my house",), ("a job to do",), ("nothing",)], "t string").select("t", K.verb_context(F.col("t")).alias("relation")),
    "a30_importance": lambda s, d: _one(s, [("Music", "hobby", 0.9, "music, Music and more music"), ("Urban Planning", "profession", 0.5, "none"), ("x", "other", 0.5, "x y x")], "name string, kind string, c double, t string").select("name", F.round(K.importance(F.col("c"), F.col("name"), F.col("kind"), F.col("t")), 6).alias("importance")),
    "u2_alias_overlap": lambda s, d: N.pairs(_people(s)).where(F.arrays_overlap("alias_a", "alias_b")).select("id_a", "id_b"),
}


def _values(rows: list[tuple], *names: str) -> str:
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({', '.join(names)})"


_RELATION = ("id", "source", "target", "relationship_type", "confidence")
_PRONOUNS = "SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p, *_ in C.PRONOUNS) + ") v(pronoun)"
RELATED = """SELECT doc_id AS id, person AS source, org AS target, 'works_for' AS relationship_type, CAST(0.8 AS DOUBLE) AS confidence FROM report
  UNION ALL SELECT doc_id, org, place, 'located_in', round(CAST(0.8 AS DOUBLE){}, 6) FROM report"""
_KEYWORDS = "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{name}', '{kind}')" for kind, pairs in K.CONCEPTS for w, name in pairs) + ") v(word, name, entity_type)"


def _found(table: str, rules, flags: str, group: int) -> str:
    """Matches of typed patterns by DuckDB's matcher."""
    quote = lambda p: p.replace("'", "''")
    return " UNION ALL ".join(f"SELECT id, unnest(regexp_extract_all(t, '{flags}{quote(p)}', {group})) AS text, '{kind}' AS entity_type FROM {table}" for kind, ps in rules for p in ps)


#: DuckDB's word boundary knows ASCII only: letters and digits beyond it become "_", which no pattern here matches and which is part of a word.
_WORDED = r"worded AS (SELECT doc_id AS id, regexp_replace(text, '[^\x00-\x7F\pP\pS\pZ\pC\pM]', '_', 'g') AS t FROM documents WHERE text IS NOT NULL)"
_TYPED = f"""{_WORDED}, m AS ({_found('worded', E.TYPED, '(?i)', 0)}),
  typed AS (SELECT *, least(CAST(1 AS DOUBLE), CAST(0.7 AS DOUBLE) + CASE WHEN regexp_matches(trim(text), '\\s') THEN 0.1 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[A-Za-z][A-Z]|(?:^|[^A-Za-z])[a-z]') THEN 0.05 ELSE 0 END) AS confidence
    FROM m WHERE length(text) > 1 AND NOT list_contains(string_split('{' '.join(E.stop_words())}', ' '), lower(text)))"""
ORACLES = {
    "s11_text_ingest": _values(
        [("Alice", "Bob", "related_to", 0.3), ("Alice", "Project", "associated_with", 0.7), ("Bob", "Project", "related_to", 0.3), ("Charlie", "Project", "manages", 0.7), ("Charlie", "Alice", "manages", 0.7), ("Project", "Alice", "related_to", 0.3)], *_RELATION[1:]
    ),
    "r2_template_relations": f"{REPORTS} {RELATED.format('')}",
    "r5_ranked_relations": f"{REPORTS} {RELATED.format(' * 0.7')}",
    "r6_phrase_relations": _values([(1, "water", "flows_into", "ocean"), (1, "evaporation", "creates", "water vapor")], "id", "source", "relationship_type", "target"),
    "r7_proximity": """WITH m AS (SELECT l_suppkey AS id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS mention, l_orderkey % 100000 * 3 AS start FROM lineitem)
      SELECT a.id, count(*) AS n FROM m a JOIN m b ON a.id = b.id AND abs(a.start - b.start) < 100 AND (a.start < b.start OR (a.start = b.start AND a.mention < b.mention)) GROUP BY a.id""",
    "r10_basic_pronouns": f"WITH p AS ({_PRONOUNS}) SELECT pronoun, count(*) AS n FROM documents, p WHERE contains(lower(text), pronoun) GROUP BY pronoun",
    "c2_pronoun_links": _values([(1, "He", "John Smith", 0.611), (1, "He", "Apple Inc", 0.611), (2, "It", "Microsoft Corporation", 0.611)], "id", "pronoun", "antecedent", "confidence"),
    "n1_resolution_matches": _values([("e1", "e2", "alias", 0.9), ("e3", "e4", "alias", 0.9)], "id_a", "id_b", "match_type", "score"),
    "n3_resolution_clusters": _values([("e1", 2, 0.9), ("e3", 2, 0.9)], "cluster", "size", "confidence"),
    "n2_part_matches": """WITH p AS (SELECT p_name AS name, CAST(min(p_partkey) AS VARCHAR) AS id FROM part GROUP BY p_name),
      s AS (SELECT a.id AS id_a, b.id AS id_b, 1.0 - levenshtein(lower(a.name), lower(b.name)) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) AS score FROM p a JOIN p b ON a.id < b.id)
      SELECT id_a, id_b, 'fuzzy' AS match_type, round(score, 6) AS score FROM s WHERE score >= 0.85""",
    "n4_resolve_online": _values([("q1", "e3", 0.9), ("q2", None, None)], "id", "match", "score"),
    "n5_merge": _values([("a,b", 3, "1", "3", 0.8)], "aliases", "mentions", "k", "j", "confidence"),
    "n7_similar_existing": """SELECT * FROM (VALUES ('c7', 'c7')) v(id, match) UNION ALL SELECT 'new1', min('s' || s_suppkey) FROM supplier WHERE 1 - levenshtein(lower(s_name), 'supplier#00000001') / greatest(length(s_name), 17.0) >= 0.85""",
    "j20_near_embeddings": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.3",
    "e14_density_clusters": """WITH RECURSIVE e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.35),
      r(node, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node) SELECT node, min(root) AS component FROM r GROUP BY node""",
    "x30_concepts": f"WITH k AS ({_KEYWORDS}) SELECT DISTINCT doc_id AS id, name, entity_type FROM documents, k WHERE contains(lower(text), word)",
    "x30_report_concepts": f"{REPORTS}, k AS ({_KEYWORDS}) SELECT DISTINCT doc_id AS id, name, entity_type FROM report, k WHERE contains(lower(text), word)",
    "e15_domain_relations": f"""{REPORTS} SELECT doc_id AS id, person AS source, target, relationship_type, CAST(0.9 AS DOUBLE) AS confidence
      FROM report, (VALUES ('Urban Planning', 'works_in'), ('Woodworking', 'practices'), ('Residence', 'lives_in')) v(target, relationship_type) WHERE c_mktsegment = 'BUILDING' OR (target = 'Residence' AND contains(lower(text), 'house'))""",
    "e2_pattern_entities": f"WITH {_TYPED} SELECT id, text, entity_type, count(*) AS n, round(max(confidence), 6) AS confidence FROM typed GROUP BY ALL",
    "e4_merged_candidates": f"""WITH {_TYPED} SELECT id, arg_max(text, {{'c': confidence, 't': text}}) AS text, entity_type, round(least(1.0, max(confidence) + 0.1 * (count(*) - 1)), 6) AS confidence, count(*) AS mentions
      FROM typed GROUP BY id, lower(text), entity_type""",
    "a29_extraction_statistics": f"WITH {_TYPED} SELECT entity_type, count(*) AS n FROM typed GROUP BY entity_type",
    "e6_schema_texts": f"WITH {_WORDED}, m AS ({_found('worded', E.GUIDED, '', 0)}) SELECT id, text, entity_type, count(*) AS n FROM m GROUP BY ALL",
    "e8_contextual_reports": f"{REPORTS}, worded AS (SELECT doc_id AS id, text AS t FROM report), m AS ({_found('worded', E.CONTEXTUAL, '', 1)}) SELECT id, text, entity_type, count(*) AS n FROM m GROUP BY ALL",
    "e17_basic_entities": f"WITH {_WORDED} SELECT id, len(f) AS n FROM (SELECT id, regexp_extract_all(t, '\\b[A-Z][a-z]+\\b') AS f FROM worded) WHERE len(f) > 0",
    "e16_verb_context": _values([("I love tea", "practices"), ("my house", "lives_in"), ("a job to do", "works_in"), ("nothing", None)], "t", "relation"),
    "a30_importance": _values([("Music", 1.0), ("Urban Planning", 1.0), ("x", 0.85)], "name", "importance"),
    "u2_alias_overlap": _values([("e1", "e2"), ("e3", "e4")], "id_a", "id_b"),
}

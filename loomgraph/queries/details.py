"""Functions and aggregations of the inventory that the other queries only use in passing, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.functions import text as X
from loomgraph.operators import consistency as C
from loomgraph.operators import coreference as O
from loomgraph.operators import extraction as E
from loomgraph.operators import knowledge as K
from loomgraph.operators import quality as Q
from loomgraph.operators import relations as R
from loomgraph.operators import resolution as N
from loomgraph.operators import schema as V
from loomgraph.queries import audit
from loomgraph.sources import banks as B
from loomgraph.sources import warehouse as W


def _candidates(s, d):
    """Events as candidates: the user's own, by type, upper case for errors and signups."""
    e = W.table(s, d, "events")
    text = F.when(F.col("event_type").isin("error", "signup"), F.upper("event_type")).otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("id"), text.alias("text"), F.lit("action").alias("entity_type"), (F.round(F.least(F.lit(0.9), F.col("value") / 200), 2)).alias("confidence"), F.when(F.col("value") > 50, "big").otherwise("small").alias("method"))


def _relations(s, d):
    t = W.table(s, d, "lineitem")
    return t.select(F.col("l_suppkey").alias("id"), F.when(F.col("l_tax") > 0.04, F.upper("l_returnflag")).otherwise(F.lower("l_returnflag")).alias("source"), F.col("l_linestatus").alias("target"), F.lit("ships").alias("relationship_type"), F.round(1 - F.col("l_discount") * 5, 2).alias("confidence"), F.col("l_linenumber").cast("string").alias("method"))


def _legacy(s, d):
    """The nations' bank in the legacy layout, written as JSON and read again."""
    n = W.table(s, d, "nation")
    node = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("location").alias("type"), F.create_map(F.lit("name"), F.col("n_name")).alias("data")).alias("v"))))
    edge = F.collect_list(F.struct(F.concat(F.lit("e"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("part_of").alias("type"), F.create_map(F.lit("k"), F.lit("v")).alias("data")))
    obs = F.collect_list(F.struct(F.concat(F.lit("o"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("content"), F.lit("t").alias("timestamp")))
    steps = F.array(F.struct(F.lit("s1").alias("id"), F.lit("look").alias("description"), F.lit("done").alias("status"), F.lit("t").alias("timestamp")))
    one = n.groupBy().agg(F.create_map(F.lit("world"), F.struct(node.alias("nodes"), edge.alias("edges"), obs.alias("observations"), steps.alias("reasoning_steps"))).alias("memory_banks")).withColumn("current_bank", F.lit("world"))
    at = scratch.fresh(s, "legacy")
    one.write.json(at)
    return B.migrate(B.read_legacy(s, at))


def _union(tables):
    out = None
    for k, v in tables.items():
        one = v.select(F.lit(k).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def _schema_json(s, d):
    back = V.Schema.from_json(V.default_schema().to_json())
    return s.createDataFrame([(t.name, len(t.properties)) for t in back.entities.values()], "name string, properties int")


def _parts(s, d):
    return W.table(s, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")


QUERIES = {
    "a4_degrees": lambda s, d: W.places(s, d).select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")),
    "a8_relationship_completeness": lambda s, d: W.relationships(s, d).agg(F.round(F.avg(Q.relationship_complete().cast("double")), 6).alias("share")),
    "a14_first_errors": lambda s, d: Q.first_errors(W.entities(s, d), W.places(s, d).withColumn("properties", F.create_map().cast("map<string,string>")), V.default_schema()),
    "a21_merge_candidates": lambda s, d: E.merge_candidates(_candidates(s, d)).select("id", F.lower("text").alias("key"), "mentions", F.round("confidence", 4).alias("confidence")),
    "a22_relation_dedup": lambda s, d: R.deduplicate(_relations(s, d)).select("id", F.lower("source").alias("source"), "target", "confidence"),
    "a23_calibration": lambda s, d: R.calibrate(_relations(s, d)).select("id", "source", "target", F.round("confidence", 5).alias("confidence")),
    "a25_resolution_statistics": lambda s, d: N.statistics(N.matches(W.table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id")).withColumn("entity_type", F.lit("concept")), "distance")).select("match_type", "n", F.round("score", 5).alias("score")),
    "a31_fallback_scores": lambda s, d: s.createDataFrame([tuple(Q.fallback_scores(W.table(s, d, "nation").count(), W.table(s, d, "region").count()).values())], "completeness double, accuracy double, connectivity double, overall double"),
    "c6_coreference_clusters": lambda s, d: O.clusters(m := scratch.write(O.mentions(W.table(s, d, "documents")), "mentions"), O.candidates(m, nearest=True)),
    "e5_similar_clusters": lambda s, d: E.cluster_similar(E.by_schema(W.table(s, d, "documents"))),
    "e10_instances": lambda s, d: V.validate_entities(E.as_instances(E.by_schema(W.table(s, d, "documents"))), V.default_schema()).groupBy("entity_type", "valid").agg(F.count("*").alias("n")),
    "e13_knowledge_graph": lambda s, d: K.graph(e := scratch.write(E.extract_entities(W.table(s, d, "documents")), "entities"), R.sentence_relations(W.table(s, d, "documents"), e, least=0.3), 0.3)[1].groupBy("relationship_type").agg(F.count("*").alias("n")),
    "f7_valid_texts": lambda s, d: _parts(s, d).where(E.valid_text(F.element_at(F.split("p_name", " "), 1))).select("p_partkey"),
    "k5_ordered_limit": lambda s, d: W.entities(s, d).where("entity_type = 'person'").orderBy("id").limit(25).select("id"),
    "q25_logical_bundle": lambda s, d: C.check(audit.entities(s, d), audit.relationships(s, d), C.LOGICAL).groupBy("rule").agg(F.count("*").alias("n")),
    "r11_relation_instances": lambda s, d: R.as_instances(_relations(s, d)).groupBy("bank", "relationship_type").agg(F.count("*").alias("n")),
    "s7_legacy_source": lambda s, d: _union(_legacy(s, d)),
    "s8_migrated_names": lambda s, d: _legacy(s, d)["entities"].select("id", "name", "entity_type"),
    "s9_schema_round_trip": _schema_json,
    "x1_levenshtein": lambda s, d: _parts(s, d).select("p_partkey", F.levenshtein("p_name", F.lit("large ring")).alias("distance")),
    "x3_relevance": lambda s, d: _parts(s, d).select("p_partkey", F.round(X.relevance("ring", F.col("p_name")), 6).alias("score")),
    "x5_title_case": lambda s, d: _parts(s, d).select("p_partkey", X.title_if_one_case(F.col("p_name")).alias("title")),
    "x7_aliases": lambda s, d: _parts(s, d).select("p_partkey", F.array_join(X.aliases(F.col("p_name"), F.lit("organization")), "|").alias("aliases")),
    "x10_coreference_similarity": lambda s, d: _parts(s, d).select("p_partkey", F.round(X.coreference_similarity(F.col("p_name"), F.lit("small ring")), 6).alias("similarity")),
    "x11_similar_entities": lambda s, d: _parts(s, d).where(E.similar_entities(F.col("p_name"), F.lit("ring"))).select("p_partkey"),
    "x12_agreement": lambda s, d: s.createDataFrame([("PERSON", "PERSON"), ("PERSON", "LOCATION"), ("ORGANIZATION LOCATION", "LOCATION")], "types string, kind string").select("types", "kind", F.round(O.agreement(F.col("types"), F.col("kind"), F.lit("")), 6).alias("score")),
    "x13_pattern_confidence": lambda s, d: _parts(s, d).select("p_partkey", F.round(E.pattern_confidence(F.initcap("p_name")), 6).alias("title"), F.round(E.pattern_confidence(F.col("p_name")), 6).alias("plain")),
    "x15_context_window": lambda s, d: W.table(s, d, "events").select("event_id", X.context_window(F.concat_ws(" ", "event_type", "props", "event_type"), F.lit(4), F.lit(6), 3).alias("window")),
    "x17_clean_phrase": lambda s, d: _parts(s, d).select("p_partkey", X.clean_phrase(F.concat(F.lit("The  "), "p_name", F.lit(" of a kind."))).alias("clean")),
    "x18_clean_context": lambda s, d: _parts(s, d).select("p_partkey", X.clean_context(F.concat("p_name", F.lit(", of the"))).alias("clean")),
    "x19_canonical_form": lambda s, d: _parts(s, d).select("p_partkey", X.canonical_form(F.col("p_name"), F.lit("person")).alias("person"), X.canonical_form(F.concat("p_name", F.lit(" inc")), F.lit("organization")).alias("organization")),
    "x20_normalised_text": lambda s, d: _parts(s, d).select("p_partkey", X.normalised_text(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  X "))).alias("normal")),
    "x21_parse_date": lambda s, d: W.table(s, d, "orders").select("o_orderkey", X.parse_date(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("day")),
    "x23_first_date": lambda s, d: W.table(s, d, "orders").select("o_orderkey", X.first_date(F.create_map(F.lit("start_date"), F.date_format("o_orderdate", "yyyy-MM-dd")), C.ENTITY_DATES).alias("day")),
    "x25_labels": lambda s, d: s.createDataFrame([("ORG",), ("GPE",), ("PER",), ("ODD",)], "label string").select("label", X.type_of_label(F.col("label")).alias("type")),
    "x27_sentence_relation": lambda s, d: s.createDataFrame([("rain causes floods",), ("we use tools",), ("a piece",), ("one part of it",)], "t string").select("t", R.sentence_relation(F.col("t")).alias("relation")),
    "x28_lemmas": lambda s, d: s.createDataFrame([("build",), ("Lead",), ("employ",), ("sing",)], "lemma string").select("lemma", X.relation_of_lemma(F.col("lemma")).alias("relation")),
    "x31_observation_text": lambda s, d: W.table(s, d, "events").select("event_id", X.observation_text(F.when(F.col("event_type") == "click", F.to_json(F.struct(F.col("props").alias("content")))).otherwise(F.col("props"))).alias("content")),
    "x32_records_as_json": lambda s, d: W.table(s, d, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("record")),
}

_LEV = "levenshtein(p_name, 'large ring')"
ORACLES = {
    "a4_degrees": f"WITH {W.SQL} SELECT id, count(*) AS degree FROM (SELECT source_entity_id AS id FROM places UNION ALL SELECT target_entity_id FROM places) GROUP BY id",
    "a8_relationship_completeness": "SELECT CAST(1 AS DOUBLE) AS share",
    "a14_first_errors": "SELECT 'entity' AS kind, id, 'Required property ''full_name'' missing' AS error FROM (SELECT 'c' || c_custkey AS id FROM customer) ORDER BY id LIMIT 10",
    "a21_merge_candidates": "SELECT user_id AS id, event_type AS key, count(*) AS mentions, round(least(1.0, max(round(least(0.9, value / 200), 2)) + 0.1 * (count(*) - 1)), 4) AS confidence FROM events GROUP BY ALL",
    "a22_relation_dedup": "SELECT l_suppkey AS id, lower(l_returnflag) AS source, l_linestatus AS target, max(round(1 - l_discount * 5, 2)) AS confidence FROM lineitem GROUP BY ALL",
    "a23_calibration": "SELECT l_suppkey AS id, lower(l_returnflag) AS source, lower(l_linestatus) AS target, round(least(1.0, avg(round(1 - l_discount * 5, 2)) + least(0.2, 0.05 * count(DISTINCT l_linenumber))), 5) AS confidence FROM lineitem GROUP BY ALL",
    "a25_resolution_statistics": """WITH p AS (SELECT p_name AS name FROM part GROUP BY p_name), s AS (SELECT 1.0 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) AS score FROM p a JOIN p b ON a.name < b.name)
      SELECT 'fuzzy' AS match_type, count(*) AS n, round(avg(score), 5) AS score FROM s WHERE score >= 0.85""",
    "a31_fallback_scores": "SELECT 0.25 AS completeness, 0.2 AS accuracy, 0.4 AS connectivity, 0.28 AS overall",
    "f7_valid_texts": f"SELECT p_partkey FROM part WHERE NOT list_contains(string_split('{' '.join(E.stop_words())}', ' '), lower(string_split(p_name, ' ')[1])) AND length(string_split(p_name, ' ')[1]) > 2 AND NOT regexp_full_match(string_split(p_name, ' ')[1], '[0-9]+')",
    "k5_ordered_limit": "SELECT 'c' || c_custkey AS id FROM customer ORDER BY id LIMIT 25",
    "q25_logical_bundle": f"WITH {audit.SQL} SELECT rule, count(*) AS n FROM violation WHERE rule IN ('symmetric', 'transitive', 'inverse') GROUP BY rule",
    "r11_relation_instances": "SELECT 'default' AS bank, 'ships' AS relationship_type, count(*) AS n FROM lineitem",
    "s7_legacy_source": "SELECT 'entities' AS kind, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'relationships', 'e' || n_nationkey FROM nation UNION ALL SELECT 'observations', 'o' || n_nationkey FROM nation UNION ALL SELECT 'reasoning_steps', 's1'",
    "s8_migrated_names": "SELECT 'n' || n_nationkey AS id, n_name AS name, 'location' AS entity_type FROM nation",
    "s9_schema_round_trip": "SELECT * FROM (VALUES ('person', 4), ('organization', 3), ('location', 3), ('concept', 2)) v(name, properties)",
    "x1_levenshtein": f"SELECT p_partkey, CAST({_LEV} AS INTEGER) AS distance FROM part",
    "x3_relevance": "SELECT p_partkey, round(CASE WHEN p_name = 'ring' THEN 1.0 WHEN contains(' ' || p_name || ' ', ' ring ') THEN 1.3 WHEN contains(p_name, 'ring') THEN least(0.7, 0.3 + 4 / CAST(length(p_name) AS DOUBLE)) ELSE 0.0 END, 6) AS score FROM part",
    "x5_title_case": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part",
    "x7_aliases": "SELECT p_partkey, p_name || CASE WHEN contains(p_name, ' ') THEN '|' || upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) ELSE '' END AS aliases FROM part",
    "x10_coreference_similarity": """SELECT p_partkey, round(CASE WHEN p_name = 'small ring' THEN 1.0 WHEN contains('small ring', p_name) OR contains(p_name, 'small ring') THEN least(length(p_name), 10) / CAST(greatest(length(p_name), 10) AS DOUBLE)
      ELSE len(list_intersect(list_distinct(string_split(p_name, ' ')), ['small', 'ring'])) / CAST(len(list_distinct(list_concat(string_split(p_name, ' '), ['small', 'ring']))) AS DOUBLE) END, 6) AS similarity FROM part""",
    "x11_similar_entities": "SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains('ring', p_name)",
    "x12_agreement": "SELECT * FROM (VALUES ('PERSON', 'PERSON', 0.65), ('PERSON', 'LOCATION', 0.35), ('ORGANIZATION LOCATION', 'LOCATION', 0.65)) v(types, kind, score)",
    "x13_pattern_confidence": "SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN 0.85 ELSE 0.75 END AS title, CASE WHEN contains(p_name, ' ') THEN 0.8 ELSE 0.7 END AS plain FROM part",
    "x15_context_window": "SELECT event_id, trim(substring(event_type || ' ' || props || ' ' || event_type, 2, 8)) AS window FROM events",
    "x17_clean_phrase": "SELECT p_partkey, p_name || ' of kind' AS clean FROM part",
    "x18_clean_context": "SELECT p_partkey, p_name AS clean FROM part",
    "x19_canonical_form": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS person, p_name || ' INC.' AS organization FROM part",
    "x20_normalised_text": "SELECT p_partkey, p_name || ' x' AS normal FROM part",
    "x21_parse_date": "SELECT o_orderkey, date_trunc('day', o_orderdate) AS day FROM orders",
    "x23_first_date": "SELECT o_orderkey, date_trunc('day', o_orderdate) AS day FROM orders",
    "x25_labels": "SELECT * FROM (VALUES ('ORG', 'organization'), ('GPE', 'location'), ('PER', 'person'), ('ODD', NULL)) v(label, type)",
    "x27_sentence_relation": "SELECT * FROM (VALUES ('rain causes floods', 'causes'), ('we use tools', 'utilizes'), ('a piece', 'associated_with'), ('one part of it', 'part_of')) v(t, relation)",
    "x28_lemmas": "SELECT * FROM (VALUES ('build', 'creates'), ('Lead', 'causes'), ('employ', 'works_for'), ('sing', NULL)) v(lemma, relation)",
    "x31_observation_text": "SELECT event_id, props AS content FROM events",
    "x32_records_as_json": """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS record FROM region""",
}

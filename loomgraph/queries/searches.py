"""Search, lookup and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import search as T
from loomgraph.operators import store as S
from loomgraph.sources import warehouse as W

R6 = lambda c: F.round(c, 6).alias(c)


def _scores(df, *more):
    return df.select(*more, R6("relevance_score"))


def _first_vector(s, d):
    row = W.table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row[0]])


QUERIES = {
    "t4_entity_blob_search": lambda s, d: _scores(T.search_blob(W.entities(s, d), "ring", T.entity_blob()), "id", "name"),
    "t4_entity_fuzzy_search": lambda s, d: _scores(T.search_blob(W.entities(s, d), "rnig", T.entity_blob(), fuzzy=True, threshold=0.5), "id", "name"),
    "t1_entity_field_search": lambda s, d: _scores(T.search_entities(W.entities(s, d), "Customer#00000010", limit=None), "id", "entity_type"),
    "t2_relationship_field_search": lambda s, d: _scores(T.search_relationships(W.places(s, d), "part", limit=None), "id"),
    "t3_observation_field_search": lambda s, d: _scores(T.search_observations(W.observations(s, d), "signup", limit=None), "id"),
    "t5_relationship_blob_search": lambda s, d: _scores(T.search_blob(T.relationship_blob(W.places(s, d), W.entities(s, d)), "NATION_3", F.col("blob"), limit=None), "id", "target_name"),
    "t6_observation_search": lambda s, d: _scores(T.search_blob(W.observations(s, d), "error", F.col("content"), limit=100), "id"),
    "t7_universal_search": lambda s, d: _scores(T.search_all(W.entities(s, d), W.places(s, d), W.observations(s, d), "nation", limit=None), "kind", "id"),
    "f5_text_predicate": lambda s, d: W.entities(s, d).where(X.matches(r"ring$|^REGION", F.col("name"), use_regex=True)).select("id", "name"),
    "x2_fuzzy_similarity": lambda s, d: W.table(s, d, "part").select("p_partkey", F.round(X.fuzzy_similarity(F.lit("small bolt"), F.col("p_name")), 6).alias("similarity")),
    "x4_normalised_names": lambda s, d: W.entities(s, d).select("id", X.normalised_name(F.concat(F.lit("Dr. The  "), F.col("name"), F.lit(" Inc."))).alias("normal")),
    "x9_cosine_to_first": lambda s, d: W.table(s, d, "embeddings").select("vec_id", F.round(X.cosine(F.col("embedding"), _first_vector(s, d)), 5).alias("cosine")),
    "x16_sentence_split": lambda s, d: W.table(s, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("position", "sentence")).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).alias("longest")),
    "s1_bank_counts": lambda s, d: S.bank_counts(entities=W.entities(s, d).select("bank"), relationships=W.relationships(s, d).select("bank"), observations=W.observations(s, d).select("bank")),
    "s2_entity_scan": lambda s, d: W.entities(s, d).where("bank = 'sales'").select("id", "name", "entity_type"),
    "s3_relation_scan": lambda s, d: W.relationships(s, d).where("bank = 'sales'").select("id", "source_entity_id", "target_entity_id"),
    "s4_observation_scan": lambda s, d: S.explode_observations(W.observations(s, d).groupBy("entity_id").agg(F.array_sort(F.collect_set("content")).alias("observations")).select(F.col("entity_id").alias("id"), "observations")),
    "s5_reasoning_scan": lambda s, d: W.reasoning_steps(s, d).select("id", "step_number", "thought"),
    "s6_graph_read_counts": lambda s, d: W.entities(s, d).select(F.lit("entity").alias("kind")).unionByName(W.relationships(s, d).select(F.lit("relationship").alias("kind"))).unionByName(W.observations(s, d).select(F.lit("observation").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n")),
    "s10_export_nodes": lambda s, d: S.export_nodes(W.entities(s, d), W.observations(s, d)),
    "s10_export_edges": lambda s, d: S.export_edges(W.places(s, d)),
    "f1_entity_query": lambda s, d: S.query_entities(W.entities(s, d), "person", {"segment": "BUILDING"}).select("id", "name"),
    "f2_relationship_query": lambda s, d: S.query_relationships(W.relationships(s, d), "located_in", target="n3").select("id"),
    "f3_point_lookup": lambda s, d: W.entities(s, d).where("id = 'c7'").select("id", "name"),
    "f4_open_nodes": lambda s, d: S.open_nodes(W.entities(s, d), ["r1", "c5", "p9"]).select("position", "id", "name"),
    "f6_confidence_filter": lambda s, d: W.places(s, d).where("confidence >= 0.8").select("id"),
    "k1_top_relevance": lambda s, d: _scores(T.search_blob(W.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "small", F.col("name"), limit=50), "id"),
    "u1_union_tagged": lambda s, d: W.entities(s, d).select(F.lit("entity").alias("kind"), "id").unionByName(W.places(s, d).select(F.lit("relationship").alias("kind"), "id")),
    "x6_initials": lambda s, d: W.table(s, d, "part").select("p_partkey", X.initials(F.col("p_name")).alias("initials")),
    "x22_date_shapes": lambda s, d: W.table(s, d, "orders").select(X.date_shape(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n")),
    "x24_index_keys": lambda s, d: S.duplicate_keys(W.table(s, d, "customer"), "c_mktsegment", "c_nationkey"),
}

_REL = """CASE WHEN lower({t}) = '{q}' THEN 1.0 WHEN contains(' ' || lower({t}) || ' ', ' {q} ') THEN 1.3
 WHEN contains(lower({t}), '{q}') THEN least(0.7, 0.3 + {n} / length({t})) ELSE 0.0 END"""


def _rel(text: str, query: str) -> str:
    return _REL.format(t=text, q=query.lower(), n=f"{len(query)}.0")


_FUZZY = "CASE WHEN length(trim({a})) = 0 THEN 0 ELSE 1.0 - CAST(levenshtein(lower(trim({a})), '{q}') AS DOUBLE) / greatest(length(trim({a})), {n}) END"


def _field(fields: dict[str, float], query: str) -> str:
    return "greatest(" + ", ".join(f"CAST(({_rel(f, query)}) * {w} AS DOUBLE)" for f, w in fields.items()) + ")"


_B = "(name || ' ' || entity_type || ' ')"
ORACLES = {
    "t4_entity_blob_search": f"WITH {W.SQL} SELECT id, name, round(CAST(s AS DOUBLE), 6) AS relevance_score FROM (SELECT *, {_rel(_B, 'ring')} AS s FROM entities) WHERE s > 0 ORDER BY s DESC, id LIMIT 50",
    "t4_entity_fuzzy_search": f"""WITH {W.SQL}, w AS (SELECT id, name, {_rel(_B, 'rnig')} AS plain, {_FUZZY.format(a=_B, q='rnig', n=4)} AS whole,
      list_max(list_transform(list_filter(string_split_regex({_B}, '\\s+'), lambda x: x <> ''), lambda x: {_FUZZY.format(a='x', q='rnig', n=4)})) AS word FROM entities),
      f AS (SELECT id, name, CAST(CASE WHEN plain > 0 THEN plain WHEN whole >= 0.5 THEN whole * 0.6 WHEN word >= 0.5 THEN word * 0.5 ELSE 0 END AS DOUBLE) AS s FROM w)
      SELECT id, name, round(s, 6) AS relevance_score FROM f WHERE s > 0 ORDER BY s DESC, id LIMIT 50""",
    "t1_entity_field_search": f"WITH {W.SQL} SELECT id, entity_type, round(s, 6) AS relevance_score FROM (SELECT *, {_field({'name': 1.0, 'entity_type': 0.8}, 'Customer#00000010')} AS s FROM entities) WHERE s > 0",
    "t2_relationship_field_search": f"WITH {W.SQL}, c AS (SELECT *, source_entity_id || ' ' || relationship_type || ' ' || target_entity_id AS context FROM places) SELECT id, round(s, 6) AS relevance_score FROM (SELECT *, {_field({'relationship_type': 1.0, 'context': 0.8, 'source_entity_id': 0.6, 'target_entity_id': 0.6}, 'part')} AS s FROM c) WHERE s > 0",
    "t3_observation_field_search": f"WITH {W.SQL} SELECT id, round(s, 6) AS relevance_score FROM (SELECT *, {_field({'content': 1.0, 'entity_id': 0.7}, 'signup')} AS s FROM observations) WHERE s > 0",
    "t5_relationship_blob_search": f"""WITH {W.SQL}, b AS (SELECT r.id, coalesce(t.name, '') AS target_name, r.relationship_type || ' ' || r.source_entity_id || ' ' || r.relationship_type || ' ' || r.target_entity_id || ' ' || coalesce(s.name, '') || ' ' || coalesce(t.name, '') AS blob
      FROM places r LEFT JOIN entities s ON s.id = r.source_entity_id LEFT JOIN entities t ON t.id = r.target_entity_id)
      SELECT id, target_name, round(CAST(s AS DOUBLE), 6) AS relevance_score FROM (SELECT *, {_rel('blob', 'NATION_3')} AS s FROM b) WHERE s > 0""",
    "t6_observation_search": f"WITH {W.SQL} SELECT id, round(CAST(s AS DOUBLE), 6) AS relevance_score FROM (SELECT *, {_rel('content', 'error')} AS s FROM observations) WHERE s > 0 ORDER BY s DESC, id LIMIT 100",
    "t7_universal_search": f"""WITH {W.SQL}, c AS (SELECT *, source_entity_id || ' ' || relationship_type || ' ' || target_entity_id AS context FROM places), u AS (
      SELECT 'entity' AS kind, id, {_field({'name': 1.0, 'entity_type': 0.8}, 'nation')} AS s FROM entities
      UNION ALL SELECT 'relationship', id, {_field({'relationship_type': 1.0, 'context': 0.8, 'source_entity_id': 0.6, 'target_entity_id': 0.6}, 'nation')} FROM c
      UNION ALL SELECT 'observation', id, {_field({'content': 1.0, 'entity_id': 0.7}, 'nation')} FROM observations)
      SELECT kind, id, round(s, 6) AS relevance_score FROM u WHERE s > 0""",
    "f5_text_predicate": f"WITH {W.SQL} SELECT id, name FROM entities WHERE regexp_matches(name, '(?i)ring$|^REGION')",
    "x2_fuzzy_similarity": f"SELECT p_partkey, round({_FUZZY.format(a='p_name', q='small bolt', n=10)}, 6) AS similarity FROM part",
    "x4_normalised_names": f"WITH {W.SQL} SELECT id, trim(regexp_replace(lower(name), '[^\\w\\s]', '', 'g')) AS normal FROM entities",
    "x9_cosine_to_first": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b",
    "x16_sentence_split": "SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '[.!?;]')), ' \t\n\v\f\r') AS s FROM documents) WHERE s <> '' GROUP BY doc_id",
    "s1_bank_counts": f"""WITH {W.SQL}, u AS (SELECT bank, 1 AS e, 0 AS r, 0 AS o FROM entities UNION ALL SELECT bank, 0, 1, 0 FROM relationships UNION ALL SELECT 'sales', 0, 0, 1 FROM observations UNION ALL SELECT 'default', 0, 0, 0)
      SELECT bank, CAST(sum(e) AS BIGINT) AS entities_count, CAST(sum(r) AS BIGINT) AS relationships_count, CAST(sum(o) AS BIGINT) AS observations_count FROM u GROUP BY bank""",
    "s2_entity_scan": f"WITH {W.SQL} SELECT id, name, entity_type FROM entities WHERE bank = 'sales'",
    "s3_relation_scan": f"WITH {W.SQL} SELECT id, source_entity_id, target_entity_id FROM relationships WHERE bank = 'sales'",
    "s4_observation_scan": f"WITH {W.SQL}, d AS (SELECT DISTINCT entity_id, content FROM observations) SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY content) - 1 AS INTEGER) AS position, content FROM d",
    "s5_reasoning_scan": "SELECT conv_id || '-' || turn AS id, CAST(turn AS INTEGER) AS step_number, role AS thought FROM conversations",
    "s6_graph_read_counts": f"WITH {W.SQL} SELECT 'entity' AS kind, count(*) AS n FROM entities UNION ALL SELECT 'relationship', count(*) FROM relationships UNION ALL SELECT 'observation', count(*) FROM observations",
    "s10_export_nodes": f"WITH {W.SQL} SELECT e.id, e.name AS label, e.entity_type AS type, 1 + count(o.id) AS size FROM entities e LEFT JOIN observations o ON o.entity_id = e.id GROUP BY ALL",
    "s10_export_edges": f"WITH {W.SQL} SELECT source_entity_id AS source, target_entity_id AS target, relationship_type AS type, relationship_type AS label FROM places",
    "f1_entity_query": "SELECT 'c' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "f2_relationship_query": f"WITH {W.SQL} SELECT id FROM places WHERE relationship_type = 'located_in' AND target_entity_id = 'n3'",
    "f3_point_lookup": "SELECT 'c' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7",
    "f4_open_nodes": f"WITH {W.SQL} SELECT CAST(position AS BIGINT) AS position, id, name FROM entities JOIN (VALUES (0, 'r1'), (1, 'c5'), (2, 'p9')) v(position, k) ON k = id",
    "f6_confidence_filter": f"WITH {W.SQL} SELECT id FROM places WHERE confidence >= 0.8",
    "k1_top_relevance": f"SELECT p_partkey AS id, round(CAST(s AS DOUBLE), 6) AS relevance_score FROM (SELECT *, {_rel('p_name', 'small')} AS s FROM part) WHERE s > 0 ORDER BY s DESC, p_partkey LIMIT 50",
    "u1_union_tagged": f"WITH {W.SQL} SELECT 'entity' AS kind, id FROM entities UNION ALL SELECT 'relationship', id FROM places",
    "x6_initials": "SELECT p_partkey, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) AS initials FROM part",
    "x22_date_shapes": "SELECT 'YYYY-MM-DD' AS shape, count(*) AS n FROM orders",
    "x24_index_keys": "SELECT c_mktsegment || '|' || c_nationkey AS key, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1",
}

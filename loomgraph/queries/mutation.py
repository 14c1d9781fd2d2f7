"""Mutations of banks as transformations, and schema validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import schema as V
from loomgraph.operators import store as S
from loomgraph.sources import warehouse as W


def _new_entities(s, d):
    """Every supplier again (refused), and one warehouse for each (created)."""
    e = W.entities(s, d)
    old = e.where("entity_type = 'organization'")
    fresh = old.withColumns({"id": F.concat(F.lit("w"), F.substring("id", 2, 20)), "name": F.concat(F.lit("Warehouse of "), "name"), "entity_type": F.lit("location")})
    return old.unionByName(fresh).unionByName(fresh)


def _new_edges(s, d):
    """A stock edge from each supplier to its warehouse, and one to a warehouse that is not there."""
    e = W.entities(s, d).where("entity_type = 'organization'")
    w = F.concat(F.lit("w"), F.substring("id", 2, 20))
    good = e.select(F.concat_ws("-", "id", F.lit("stocks"), w).alias("id"), F.col("id").alias("source_entity_id"), w.alias("target_entity_id"), F.lit("stocks").alias("relationship_type"))
    bad = good.withColumns({"id": F.concat("id", F.lit("-x")), "target_entity_id": F.lit("nowhere")})
    return good.unionByName(bad)


def _w1(s, d):
    return S.create_entities(W.entities(s, d), _new_entities(s, d), ["id", "name"])[1].select("id", "name", "entity_type")


def _w2(s, d):
    everything = S.create_entities(W.entities(s, d), _new_entities(s, d), ["id", "name"])[0]
    return S.create_relationships(W.places(s, d), _new_edges(s, d), everything)[1].select("id", "source_entity_id", "target_entity_id")


def _w3(s, d):
    return _w1(s, d).agg(F.count("*").alias("created"))


def _w4(s, d):
    e = W.entities(s, d)
    new = e.where("entity_type = 'location'").withColumn("name", F.upper(F.concat(F.lit("new "), "name")))
    return S.upsert(e, new).select("id", "name")


def _w5(s, d):
    return S.update(W.entities(s, d), "c7", {"name": F.lit("Seven"), "properties": F.map_concat("properties", F.create_map(F.lit("vip"), F.lit("yes")))}).select("id", "name", F.col("properties")["vip"].alias("vip"))


def _w6(s, d, cascade):
    e, r = W.entities(s, d), W.places(s, d)
    ids = e.where("entity_type in ('location', 'concept')")
    kept, edges = S.delete_entities(e, r, ids, cascade)
    return kept.select(F.lit("entity").alias("kind"), "id").unionByName(edges.select(F.lit("relationship").alias("kind"), "id"))


def _w7(s, d):
    gone = W.places(s, d).where("relationship_type = 'part_of'").select("source_entity_id", "target_entity_id", "relationship_type")
    return S.delete_relationships(W.places(s, d), gone).select("id")


def _w9(s, d):
    r = W.places(s, d)
    new = r.where("relationship_type = 'part_of'").select(F.col("target_entity_id").alias("source_entity_id"), F.col("source_entity_id").alias("target_entity_id"), F.lit("contains").alias("relationship_type"))
    return S.add_edges(r, new).where("relationship_type = 'contains'").select("id", "relationship_type")


def _w10(s, d):
    r = S.update(W.places(s, d), "n3-part_of-r3", {"relationship_type": F.lit("belongs_to")})
    return r.where("id <> 'n4-part_of-r4'").select("id", "relationship_type")


def _w11(s, d):
    return S.add_observations(W.observations(s, d).where("false"), W.observations(s, d), W.entities(s, d)).groupBy("entity_id").agg(F.count("*").alias("n"))


def _w12(s, d):
    steps = W.reasoning_steps(s, d)
    new = steps.groupBy("bank").agg(F.lit("extra").alias("id"), (F.max("step_number") + 1).alias("step_number"), F.lit("done").alias("reasoning"), F.lit("closing").alias("thought"))
    return steps.unionByName(new).groupBy("thought").agg(F.count("*").alias("n"), F.max("step_number").alias("last_step"))


def _f8(s, d):
    # intent: an extracted person carries its name as full name
    e = W.entities(s, d).withColumn("properties", F.when((F.col("entity_type") == "person") & (F.col("properties")["segment"] != "MACHINERY"), F.map_concat("properties", F.create_map(F.lit("full_name"), F.col("name")))).otherwise(F.col("properties")))
    return V.validate_entities(e, V.default_schema()).select("id", "valid", F.array_join("errors", ";").alias("errors"))


def _f9(s, d):
    r = W.relationships(s, d).withColumn("properties", F.create_map().cast("map<string,string>"))
    return V.validate_relationships(r, W.entities(s, d), V.default_schema()).groupBy("relationship_type", "valid").agg(F.count("*").alias("n"))


def _f10(s, d):
    p = V.Property("balance", "float", least=0, most=5000)
    return W.table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("_v")).select("c_custkey", V.value_fits(F.col("_v"), p).alias("fits"))


def _f11(s, d):
    types = s.createDataFrame([("thing", None), ("agent", "thing"), ("person", "agent"), ("employee", "person")], "name string, parent string")
    return V.hierarchy(types, "employee").select("name", "depth")


def _x29(s, d):
    return W.table(s, d, "part").select("p_partkey", V.closest_type(F.element_at(F.split("p_name", " "), -1), ["Bolt", "Spring", "screws"]).alias("type"))


def _i1(s, d):
    return S.duplicate_keys(W.table(s, d, "lineitem"), "l_suppkey", "l_partkey")


QUERIES = {
    "s1_bank_delete": lambda s, d: S.drop_bank(W.entities(s, d), "catalogue").groupBy("bank").agg(F.count("*").alias("n")),
    "w1_create_entities": _w1,
    "w2_create_relationships": _w2,
    "w3_bulk_create_count": _w3,
    "w4_upsert_entities": _w4,
    "w5_update_entity": _w5,
    "w6_delete_restrict": lambda s, d: _w6(s, d, False),
    "w6_delete_cascade": lambda s, d: _w6(s, d, True),
    "w7_delete_relationships": _w7,
    "w8_delete_entity": lambda s, d: W.entities(s, d).where("id <> 'c7'").select("id"),
    "w9_add_edges": _w9,
    "w10_edit_edge": _w10,
    "w11_add_observations": _w11,
    "w12_add_steps": _w12,
    "f8_validate_entities": _f8,
    "f9_validate_relationships": _f9,
    "f10_value_checks": _f10,
    "f11_type_hierarchy": _f11,
    "x29_closest_type": _x29,
    "i1_unique_index_check": _i1,
}

_ORG = "SELECT s_suppkey AS k, s_name AS name FROM supplier"
_ALL = f"WITH {W.SQL}"
ORACLES = {
    "s1_bank_delete": f"{_ALL} SELECT bank, count(*) AS n FROM entities WHERE bank <> 'catalogue' GROUP BY bank",
    "w1_create_entities": "SELECT 'w' || s_suppkey AS id, 'Warehouse of ' || s_name AS name, 'location' AS entity_type FROM supplier",
    "w2_create_relationships": "SELECT 's' || s_suppkey || '-stocks-w' || s_suppkey AS id, 's' || s_suppkey AS source_entity_id, 'w' || s_suppkey AS target_entity_id FROM supplier",
    "w3_bulk_create_count": "SELECT count(*) AS created FROM supplier",
    "w4_upsert_entities": f"{_ALL} SELECT id, CASE WHEN entity_type = 'location' THEN 'NEW ' || upper(name) ELSE name END AS name FROM entities",
    "w5_update_entity": f"{_ALL} SELECT id, CASE WHEN id = 'c7' THEN 'Seven' ELSE name END AS name, CASE WHEN id = 'c7' THEN 'yes' END AS vip FROM entities",
    "w6_delete_restrict": f"""{_ALL} SELECT 'entity' AS kind, id FROM entities e WHERE entity_type NOT IN ('location', 'concept') OR EXISTS (SELECT 1 FROM places p WHERE e.id IN (p.source_entity_id, p.target_entity_id))
      UNION ALL SELECT 'relationship', id FROM places""",
    "w6_delete_cascade": f"{_ALL} SELECT 'entity' AS kind, id FROM entities WHERE entity_type NOT IN ('location', 'concept') UNION ALL SELECT 'relationship', id FROM places WHERE false",
    "w7_delete_relationships": f"{_ALL} SELECT id FROM places WHERE relationship_type <> 'part_of'",
    "w8_delete_entity": f"{_ALL} SELECT id FROM entities EXCEPT ALL SELECT 'c7'",
    "w9_add_edges": f"""{_ALL} SELECT source_entity_id || '-' || target_entity_id || '-' || ((SELECT count(*) FROM places) + row_number() OVER (ORDER BY source_entity_id, target_entity_id) - 1) AS id, 'contains' AS relationship_type
      FROM (SELECT target_entity_id AS source_entity_id, source_entity_id AS target_entity_id FROM places WHERE relationship_type = 'part_of')""",
    "w10_edit_edge": f"{_ALL} SELECT id, CASE WHEN id = 'n3-part_of-r3' THEN 'belongs_to' ELSE relationship_type END AS relationship_type FROM places WHERE id <> 'n4-part_of-r4'",
    "w11_add_observations": "SELECT 'c' || user_id AS entity_id, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id",
    "w12_add_steps": "SELECT role AS thought, count(*) AS n, CAST(max(turn) AS INTEGER) AS last_step FROM conversations GROUP BY role UNION ALL SELECT 'closing', 1, CAST(max(turn) + 1 AS INTEGER) FROM conversations",
    "f8_validate_entities": f"""{_ALL} SELECT e.id, NOT coalesce(c_mktsegment = 'MACHINERY', false) AS valid, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Required property ''full_name'' missing' ELSE '' END AS errors
      FROM entities e LEFT JOIN customer ON e.id = 'c' || c_custkey""",
    "f9_validate_relationships": f"{_ALL} SELECT relationship_type, relationship_type = 'located_in' AS valid, count(*) AS n FROM relationships GROUP BY ALL",
    "f10_value_checks": "SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AS fits FROM customer",
    "f11_type_hierarchy": "SELECT name, CAST(depth AS INTEGER) AS depth FROM (VALUES ('employee', 0), ('person', 1), ('agent', 2), ('thing', 3)) t(name, depth)",
    "x29_closest_type": """WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[-1] AS w FROM part), v AS (SELECT * FROM (VALUES (0, 'Bolt'), (1, 'Spring'), (2, 'screws')) v(o, t)),
      m AS (SELECT p_partkey, t, row_number() OVER (PARTITION BY p_partkey ORDER BY lower(t) <> lower(w), o) AS r FROM w, v WHERE contains(lower(t), lower(w)) OR contains(lower(w), lower(t)))
      SELECT w.p_partkey, t AS type FROM w LEFT JOIN m ON m.p_partkey = w.p_partkey AND r = 1""",
    "i1_unique_index_check": "SELECT l_suppkey || '|' || l_partkey AS key, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
}

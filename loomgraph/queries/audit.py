"""Quality and consistency queries over a graph of orders, customers, suppliers and nations that breaks every rule somewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import consistency as C
from loomgraph.operators import quality as Q
from loomgraph.operators import schema as V
from loomgraph.sources import warehouse as W


def _e(df: DataFrame, ident, name, kind: str, **props) -> DataFrame:
    m = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v)]) if props else F.create_map().cast("map<string,string>")
    return df.select(F.lit("audit").alias("bank"), ident.alias("id"), name.alias("name"), F.lit(kind).alias("entity_type"), m.alias("properties"))


def entities(s, d) -> DataFrame:
    t = lambda n: W.table(s, d, n)
    last = t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    orders = t("orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shape = lambda c: F.when(F.col("o_orderstatus") == "P", F.date_format(c, "MM/dd/yyyy")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    age = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("n/a")).otherwise(F.floor(F.col("c_acctbal") / 50).cast("string"))
    mail = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("a@b")).otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.org")))
    return reduce(
        DataFrame.unionByName,
        [
            _e(orders, key("o", "o_orderkey"), F.col("o_orderpriority"), "event", start_date=shape("o_orderdate"), end_date=F.date_format("ship", "yyyy-MM-dd")),
            _e(t("customer"), key("c", "c_custkey"), F.col("c_name"), "person", age=age, email=mail),
            _e(t("supplier"), key("s", "s_suppkey"), F.col("s_name"), "organization"),
            _e(t("nation"), key("n", "n_nationkey"), F.col("n_name"), "location"),
            _e(t("region"), key("r", "r_regionkey"), F.col("r_name"), "location"),
        ],
    )


def _r(df: DataFrame, kind: str, source, target, confidence=None) -> DataFrame:
    c = F.lit(None).cast("double") if confidence is None else confidence
    return df.select(F.concat_ws("-", source, F.lit(kind), target).alias("id"), source.alias("source_entity_id"), target.alias("target_entity_id"), F.lit(kind).alias("relationship_type"), c.alias("confidence"))


def relationships(s, d) -> DataFrame:
    from pyspark.sql import Window

    t = lambda n: W.table(s, d, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    cust = t("customer").join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    poor = cust.where("c_acctbal < 0")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    prior = t("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("p")).where("p is not null")
    trade = W.trade(s, d)
    place = lambda k: (key("n", "n_nationkey"), key("r", "n_regionkey")) if k else (key("r", "n_regionkey"), key("n", "n_nationkey"))
    return reduce(
        DataFrame.unionByName,
        [
            _r(cust, "born_in", key("c", "c_custkey"), key("n", "c_nationkey"), F.lit(0.9)),
            _r(poor, "born_in", key("c", "c_custkey"), key("r", "n_regionkey"), F.lit(0.65)),
            _r(cust.where("c_mktsegment = 'MACHINERY'"), "employed_by", key("c", "c_custkey"), key("s", "c_nationkey"), F.lit(0.7)),
            _r(poor, "unemployed", key("c", "c_custkey"), key("n", "c_nationkey"), F.lit(0.3)),
            _r(cust, "located_in", key("c", "c_custkey"), key("n", "c_nationkey"), F.lit(0.8)),
            _r(t("nation"), "located_in", *place(True)),
            _r(t("nation"), "contains", *place(True)),
            _r(t("nation"), "contains", *place(False)),
            _r(trade, "allied_with", key("n", "src"), key("n", "dst"), F.lit(0.5)),
            _r(t("supplier"), "manages", key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit(1.0)),
            _r(t("supplier").where("s_acctbal > 0"), "managed_by", key("n", "s_nationkey"), key("s", "s_suppkey"), F.lit(1.0)),
            _r(t("supplier").where("s_acctbal < 1000"), "knows", key("s", "s_suppkey"), key("x", "s_nationkey")),
            _r(prior, "before", key("o", "o_orderkey"), key("o", "p")),
        ],
    )


def _rule(rule):
    def run(s, d):
        return rule(entities(s, d), relationships(s, d)).select("rule", "severity", "subject", "detail", "confidence")

    return run


def _round(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


QUERIES = {
    "q13_temporal": _rule(C.temporal),
    "q14_before_edges": _rule(C.before_edges),
    "q15_circular": _rule(C.circular),
    "q16_cardinality": _rule(C.cardinality),
    "q17_exclusion": _rule(C.exclusion),
    "q18_referential": _rule(C.referential),
    "q19_date_formats": _rule(C.date_formats),
    "q20_numbers": _rule(C.numbers),
    "q21_formats": _rule(C.formats),
    "q22_symmetric": _rule(C.symmetric),
    "q23_transitive": _rule(C.transitive),
    "q24_inverse": _rule(C.inverse),
    "q12_rule_runner": lambda s, d: C.check(entities(s, d), relationships(s, d), C.RULES | C.LOGICAL).groupBy("rule", "severity").agg(F.count("*").alias("n")),
    "q11_high_priority": lambda s, d: C.check(entities(s, d), relationships(s, d), {"r": C.referential, "e": C.exclusion}).where("severity in ('CRITICAL', 'HIGH')").groupBy("severity").agg(F.count("*").alias("n")),
    "a7_completeness": lambda s, d: _round(Q.completeness(entities(s, d)), "completeness").select("id", "completeness"),
    "a9_property_coverage": lambda s, d: _round(Q.property_coverage(entities(s, d)), "required_coverage", "optional_coverage", "overall_coverage"),
    "a10_accuracy": lambda s, d: _round(Q.accuracy(relationships(s, d), entities(s, d)), "accuracy"),
    "a11_schema_compliance": lambda s, d: _round(Q.schema_compliance(W.entities(s, d), W.places(s, d).withColumn("properties", F.create_map().cast("map<string,string>")), V.default_schema()), "compliance"),
    "a12_confidence_buckets": lambda s, d: Q.confidence_buckets(relationships(s, d)),
    "a13_accuracy_by_type": lambda s, d: _round(Q.accuracy_by_type(relationships(s, d), entities(s, d)), "accuracy"),
    "a17_consistency": lambda s, d: _round(Q.consistency_score(entities(s, d), relationships(s, d)), "consistency"),
    "a18_duplicate_names": lambda s, d: Q.duplicate_names(entities(s, d)),
    "a27_connected_share": lambda s, d: _round(Q.connected_share(entities(s, d), relationships(s, d)), "connected_share"),
    "q1_completeness_metrics": lambda s, d: _round(Q.completeness_metrics(entities(s, d), relationships(s, d)), "required_coverage", "optional_coverage", "overall_coverage", "entity_completeness", "relationship_completeness", "score"),
    "q6_q9_issues": lambda s, d: _round(Q.issues(entities(s, d), relationships(s, d)), "confidence"),
    "j3_dangling": lambda s, d: C.referential(entities(s, d), relationships(s, d)).select("subject", "detail"),
    "j4_orphans": lambda s, d: Q.issues(entities(s, d), relationships(s, d)).where("issue_type = 'orphaned_entity'").select("subject"),
    "q5_report": lambda s, d: _round(Q.report(W.entities(s, d), W.places(s, d)), "completeness", "accuracy", "connectivity", "consistency", "overall"),
    "q10_recommendations": lambda s, d: Q.recommendations(Q.report(W.entities(s, d), W.places(s, d)), Q.issues(W.entities(s, d), W.places(s, d))),
}

SQL = f"""{W.SQL}, ship AS (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey),
ae AS (
  SELECT 'o' || o_orderkey AS id, o_orderpriority AS name, 'event' AS kind, o_orderdate AS d1, ship AS d2, o_orderstatus AS st, NULL AS age, NULL AS email FROM orders LEFT JOIN ship ON l_orderkey = o_orderkey
  UNION ALL SELECT 'c' || c_custkey, c_name, 'person', NULL, NULL, NULL, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'n/a' ELSE CAST(CAST(floor(c_acctbal / 50) AS BIGINT) AS VARCHAR) END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'a@b' ELSE 'u' || c_custkey || '@mail.org' END FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'organization', NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'location', NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'location', NULL, NULL, NULL, NULL, NULL FROM region),
prior AS (SELECT * FROM (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER w AS p, lag(o_orderdate) OVER w AS pd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE p IS NOT NULL),
ar AS (SELECT s || '-' || k || '-' || t AS id, * FROM (
  SELECT 'c' || c_custkey AS s, 'born_in' AS k, 'n' || c_nationkey AS t, 0.9 AS c FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'born_in', 'r' || n_regionkey, 0.65 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0
  UNION ALL SELECT 'c' || c_custkey, 'employed_by', 's' || c_nationkey, 0.7 FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT 'c' || c_custkey, 'unemployed', 'n' || c_nationkey, 0.3 FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'c' || c_custkey, 'located_in', 'n' || c_nationkey, 0.8 FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'located_in', 'r' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'contains', 'r' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'contains', 'n' || n_nationkey, NULL FROM nation
  UNION ALL SELECT 'n' || src, 'allied_with', 'n' || dst, 0.5 FROM trade
  UNION ALL SELECT 's' || s_suppkey, 'manages', 'n' || s_nationkey, 1 FROM supplier
  UNION ALL SELECT 'n' || s_nationkey, 'managed_by', 's' || s_suppkey, 1 FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 's' || s_suppkey, 'knows', 'x' || s_nationkey, NULL FROM supplier WHERE s_acctbal < 1000
  UNION ALL SELECT 'o' || o_orderkey, 'before', 'o' || p, NULL FROM prior)),
bad AS (SELECT * FROM ar WHERE t NOT IN (SELECT id FROM ae)),
full_ae AS (SELECT id, name, kind, CASE kind WHEN 'event' THEN (CASE WHEN coalesce(name, '') <> '' THEN 1 ELSE 0 END + 1) / 3.0 ELSE 1.0 END AS completeness FROM ae),
issue AS (
  SELECT 'duplicate_entity' AS issue_type, 'MEDIUM' AS severity, name AS subject, 0.8 AS confidence FROM ae GROUP BY name HAVING count(*) > 1
  UNION ALL SELECT 'incomplete_entity', CASE WHEN completeness < 0.5 THEN 'MEDIUM' ELSE 'LOW' END, id, round(1 - completeness, 6) FROM full_ae WHERE completeness < 0.7
  UNION ALL SELECT 'invalid_relationship', 'HIGH', id, 0.9 FROM bad
  UNION ALL SELECT 'orphaned_entity', 'LOW', id, 1 FROM ae WHERE id NOT IN (SELECT s FROM ar) AND id NOT IN (SELECT t FROM ar)),
violation AS (
  SELECT 'temporal_consistency' AS rule, 'HIGH' AS severity, id AS subject, 'start_date after end_date' AS detail, 1.0 AS confidence FROM ae WHERE kind = 'event' AND CAST(d1 AS DATE) > CAST(d2 AS DATE)
  UNION ALL SELECT 'temporal_ordering', 'MEDIUM', 'o' || o_orderkey || '-before-o' || p, 'o' || o_orderkey || '>o' || p, 0.8 FROM prior WHERE o_orderdate >= pd
  UNION ALL SELECT 'circular_dependency', 'CRITICAL', 'contains', 'n' || n_nationkey || '>r' || n_regionkey, 1 FROM nation
  UNION ALL SELECT 'cardinality', 'HIGH', s, 'born_in:' || count(*), 1 FROM ar WHERE k = 'born_in' GROUP BY s HAVING count(*) > 1
  UNION ALL SELECT 'mutual_exclusion', 'HIGH', a.s, 'employed_by|unemployed', 1 FROM ar a JOIN ar b ON a.s = b.s WHERE a.k = 'employed_by' AND b.k = 'unemployed'
  UNION ALL SELECT 'referential_integrity', 'CRITICAL', id, 'target:' || t, 1 FROM bad
  UNION ALL SELECT 'date_format', 'LOW', id, 'start_date:MM/DD/YYYY', 0.7 FROM ae WHERE st = 'P' AND (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') * 2 < (SELECT count(*) FROM orders)
  UNION ALL SELECT 'numeric', 'MEDIUM', id, 'age:' || age, CASE WHEN age = 'n/a' THEN 1.0 ELSE 0.9 END FROM ae WHERE kind = 'person' AND (age = 'n/a' OR TRY_CAST(age AS DOUBLE) NOT BETWEEN 0 AND 150)
  UNION ALL SELECT 'string_format', 'LOW', id, 'email:a@b', 0.8 FROM ae WHERE email = 'a@b'
  UNION ALL SELECT 'symmetric', 'MEDIUM', a.s || '>' || a.t, a.k, 0.9 FROM ar a LEFT JOIN ar b ON a.s = b.t AND a.t = b.s AND b.k = a.k WHERE a.k = 'allied_with' AND b.id IS NULL
  UNION ALL SELECT 'transitive', 'LOW', 'c' || c_custkey || '>r' || n_regionkey, 'located_in', 0.6 FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'inverse', 'MEDIUM', 's' || s_suppkey || '>n' || s_nationkey, 'manages|managed_by', 0.8 FROM supplier WHERE NOT s_acctbal > 0)"""
_A = f"WITH {SQL}"
_V = {
    "q13_temporal": ["temporal_consistency"],
    "q14_before_edges": ["temporal_ordering"],
    "q15_circular": ["circular_dependency"],
    "q16_cardinality": ["cardinality"],
    "q17_exclusion": ["mutual_exclusion"],
    "q18_referential": ["referential_integrity"],
    "q19_date_formats": ["date_format"],
    "q20_numbers": ["numeric"],
    "q21_formats": ["string_format"],
    "q22_symmetric": ["symmetric"],
    "q23_transitive": ["transitive"],
    "q24_inverse": ["inverse"],
}
ORACLES = {k: f"{_A} SELECT rule, severity, subject, detail, CAST(confidence AS DOUBLE) AS confidence FROM violation WHERE rule = '{v[0]}'" for k, v in _V.items()} | {
    "q12_rule_runner": f"{_A} SELECT rule, severity, count(*) AS n FROM violation GROUP BY ALL",
    "q11_high_priority": f"{_A} SELECT severity, count(*) AS n FROM violation WHERE rule IN ('referential_integrity', 'mutual_exclusion') GROUP BY severity",
    "a7_completeness": f"{_A} SELECT id, round(CAST(completeness AS DOUBLE), 6) AS completeness FROM full_ae",
    "a9_property_coverage": f"""{_A}, r AS (SELECT sum(CASE kind WHEN 'event' THEN CAST(round(completeness * 3) AS INTEGER) ELSE 2 END) AS h, sum(CASE kind WHEN 'event' THEN 3 ELSE 2 END) AS w, sum(3) AS o FROM full_ae)
      SELECT round(h / CAST(w AS DOUBLE), 6) AS required_coverage, CAST(0 AS DOUBLE) AS optional_coverage, round(h / CAST(w + o AS DOUBLE), 6) AS overall_coverage FROM r""",
    "a10_accuracy": f"{_A} SELECT round(1 - (SELECT count(*) FROM bad) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM ar",
    "a11_schema_compliance": f"""{_A}, x AS (SELECT (SELECT count(*) FROM entities WHERE entity_type <> 'person') + (SELECT count(*) FROM places WHERE relationship_type = 'located_in') AS ok, (SELECT count(*) FROM entities) + (SELECT count(*) FROM places) AS n) SELECT round(ok / CAST(n AS DOUBLE), 6) AS compliance FROM x""",
    "a12_confidence_buckets": f"{_A} SELECT b AS bucket, count(c2) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('unknown')) v(b) LEFT JOIN (SELECT CASE WHEN c IS NULL THEN 'unknown' WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS c2 FROM ar) ON c2 = b GROUP BY b",
    "a13_accuracy_by_type": f"""{_A} SELECT 'entity_' || kind AS key, CAST(1 AS DOUBLE) AS accuracy FROM ae GROUP BY kind
      UNION ALL SELECT 'relationship_' || k, round(avg(CASE WHEN t IN (SELECT id FROM ae) THEN 1.0 ELSE 0.0 END), 6) FROM ar GROUP BY k""",
    "a17_consistency": f"{_A} SELECT CAST(1 AS DOUBLE) AS consistency",
    "a18_duplicate_names": f"{_A} SELECT name, count(*) AS n, min(id) AS first_id FROM ae GROUP BY name HAVING count(*) > 1",
    "a27_connected_share": f"{_A} SELECT round(1 - (SELECT count(*) FROM issue WHERE issue_type = 'orphaned_entity') / CAST(count(*) AS DOUBLE), 6) AS connected_share FROM ae",
    "q1_completeness_metrics": f"""{_A}, r AS (SELECT sum(CASE kind WHEN 'event' THEN 2 ELSE 2 END) AS h, sum(CASE kind WHEN 'event' THEN 3 ELSE 2 END) AS w, sum(3) AS o, avg(completeness) AS e FROM full_ae)
      SELECT round(h / CAST(w AS DOUBLE), 6) AS required_coverage, CAST(0 AS DOUBLE) AS optional_coverage, round(h / CAST(w + o AS DOUBLE), 6) AS overall_coverage, round(e, 6) AS entity_completeness, CAST(1 AS DOUBLE) AS relationship_completeness, round(0.4 * e + 0.3 + 0.3 * h / (w + o), 6) AS score FROM r""",
    "q6_q9_issues": f"{_A} SELECT issue_type, severity, subject, CAST(confidence AS DOUBLE) AS confidence FROM issue",
    "j3_dangling": f"{_A} SELECT id AS subject, 'target:' || t AS detail FROM bad",
    "j4_orphans": f"{_A} SELECT subject FROM issue WHERE issue_type = 'orphaned_entity'",
    "q5_report": f"""WITH {W.SQL}, n AS (SELECT count(*) AS n FROM entities), k AS (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM region) AS c), x AS (SELECT 0.7 * (1 - (c - 1) / CAST(n - 1 AS DOUBLE)) AS con FROM n, k)
      SELECT CAST(1 AS DOUBLE) AS completeness, CAST(1 AS DOUBLE) AS accuracy, round(con, 6) AS connectivity, CAST(1 AS DOUBLE) AS consistency, round(0.8 + 0.2 * con, 6) AS overall FROM x""",
    "q10_recommendations": f"""WITH {W.SQL} SELECT 'add relationships between entities' AS recommendation UNION ALL SELECT 'merge duplicate entities' FROM (SELECT name FROM entities GROUP BY name HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'connect orphaned entities'""",
}

"""Edges added to a bank, schema changes, merged clusters and figures of a store, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.operators import knowledge as K
from loomgraph.operators import resolution as N
from loomgraph.operators import schema as V
from loomgraph.operators import store as S
from loomgraph.sources import warehouse as W


def _seen_edges(s, d):
    """Every order line as an edge seen in a text: its supplier to the nation of its line number, and to its part; dangling and known ones among them."""
    t = W.table(s, d, "lineitem")
    end = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    both = F.array(
        F.struct(end("n", "l_linenumber").alias("target"), F.lit("located_in").alias("relationship_type")),
        F.struct(end("p", "l_partkey").alias("target"), F.lit("mentions").alias("relationship_type")),
        F.struct(end("x", "l_partkey").alias("target"), F.lit("mentions").alias("relationship_type")),
    )
    return t.select(end("s", "l_suppkey").alias("source"), F.explode(both).alias("e"), F.round(1 - F.col("l_discount"), 2).alias("confidence")).select("source", "e.*", "confidence")


def _known_edges(s, d):
    t = W.table(s, d, "supplier")
    return t.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_entity_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target_entity_id"), F.lit("located_in").alias("relationship_type"))


def _parts(s, d):
    """Part names, once each."""
    return W.table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id")).select("id", "name", F.lit("concept").alias("entity_type"))


def _representatives(s, d):
    parts = _parts(s, d)
    return N.representatives(parts, scratch.write(N.matches(parts, "distance"), "matches"))


def _merged(s, d):
    t = W.table(s, d, "embeddings")
    return K.merge_clusters(t.select(F.col("vec_id").alias("id"), (F.col("vec_id") * 7919 % 1009 / 1009.0).alias("importance")), K.density_clusters(t, 0.65))


def _schema_changes(s, d):
    """Types named after regions and nations: a nation's type has its region's as parent; one whose parent is not there is refused."""
    schema = V.Schema()
    # two tables of a fixed size, the catalogue of types
    for r in W.table(s, d, "region").orderBy("r_regionkey").collect()[1:]:
        schema.add_entity_type(V.EntityType(r.r_name))
    out, region = [], {r.r_regionkey: r.r_name for r in W.table(s, d, "region").collect()}
    for n in W.table(s, d, "nation").orderBy("n_nationkey").collect():
        try:
            schema.add_entity_type(V.EntityType(n.n_name, parent=region[n.n_regionkey]))
            out.append((n.n_name, True))
        except ValueError:
            out.append((n.n_name, False))
    return s.createDataFrame(out, "name string, added boolean")


QUERIES = {
    "j21_new_edges": lambda s, d: S.new_edges(_seen_edges(s, d), _known_edges(s, d), W.entities(s, d)),
    "a28_store_statistics": lambda s, d: S.statistics(W.entities(s, d), W.relationships(s, d)).withColumn("memory_mb", F.round("memory_mb", 4)),
    "q4_performance": lambda s, d: S.statistics(W.entities(s, d), W.relationships(s, d), 2.5).select(F.round("entities_per_second", 4).alias("entities_per_second"), F.round("relationships_per_second", 4).alias("relationships_per_second")),
    "f12_schema_changes": _schema_changes,
    "e19_representatives": lambda s, d: _representatives(s, d)[0].select("id", "name", "entity_type", "cluster_size", F.round("resolution_confidence", 6).alias("resolution_confidence")),
    "e19_aliases": lambda s, d: _representatives(s, d)[1],
    "n8_merged_clusters": lambda s, d: _merged(s, d).select("id", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"), "n_members", F.round("importance", 6).alias("importance")),
}

_CLUSTERS = """RECURSIVE p AS (SELECT p_name AS name, CAST(min(p_partkey) AS VARCHAR) AS id FROM part GROUP BY p_name),
  m AS (SELECT a.id AS a, b.id AS b, 1.0 - levenshtein(lower(a.name), lower(b.name)) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) AS score FROM p a JOIN p b ON a.id < b.id),
  k AS (SELECT * FROM m WHERE score >= 0.85), e AS (SELECT a AS u, b AS v FROM k UNION SELECT b, a FROM k),
  r(node, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
  c AS (SELECT node AS id, min(root) AS cluster FROM r GROUP BY node),
  f AS (SELECT cluster, arg_max(name, {'l': length(name), 'i': id}) AS name, count(*) AS size FROM c JOIN p USING (id) GROUP BY cluster)"""

ORACLES = {
    "j21_new_edges": f"""WITH {W.SQL}, n AS (SELECT 's' || l_suppkey AS source, unnest([{{'t': 'n' || l_linenumber, 'k': 'located_in'}}, {{'t': 'p' || l_partkey, 'k': 'mentions'}}, {{'t': 'x' || l_partkey, 'k': 'mentions'}}]) AS e, round(1 - l_discount, 2) AS confidence FROM lineitem)
      SELECT source, e.t AS target, e.k AS relationship_type, max(confidence) AS confidence FROM n WHERE source IN (SELECT id FROM entities) AND e.t IN (SELECT id FROM entities)
        AND NOT EXISTS (SELECT 1 FROM supplier WHERE 's' || s_suppkey = source AND 'n' || s_nationkey = e.t AND e.k = 'located_in') GROUP BY ALL""",
    "a28_store_statistics": f"WITH {W.SQL} SELECT e AS entity_count, r AS relationship_count, round(e * CAST(0.001 AS DOUBLE) + r * CAST(0.0005 AS DOUBLE), 4) AS memory_mb FROM (SELECT count(*) AS e FROM entities), (SELECT count(*) AS r FROM relationships)",
    "q4_performance": f"WITH {W.SQL} SELECT round(e / CAST(2.5 AS DOUBLE), 4) AS entities_per_second, round(r / CAST(2.5 AS DOUBLE), 4) AS relationships_per_second FROM (SELECT count(*) AS e FROM entities), (SELECT count(*) AS r FROM relationships)",
    "f12_schema_changes": "SELECT n_name AS name, n_regionkey <> (SELECT min(r_regionkey) FROM region) AS added FROM nation",
    "e19_representatives": f"""WITH {_CLUSTERS} SELECT 'resolved_' || cluster AS id, any_value(f.name) AS name, 'concept' AS entity_type, any_value(f.size) AS cluster_size, round(avg(score), 6) AS resolution_confidence
      FROM k JOIN c ON c.id = k.a JOIN f USING (cluster) GROUP BY cluster""",
    "e19_aliases": f"WITH {_CLUSTERS} SELECT DISTINCT 'resolved_' || cluster AS id, p.name AS alias FROM c JOIN p USING (id) JOIN f USING (cluster) WHERE p.name <> f.name",
    "n8_merged_clusters": """WITH RECURSIVE e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.35),
      r(node, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node), c AS (SELECT node AS vec_id, min(root) AS cluster_id FROM r GROUP BY node),
      a AS (SELECT vec_id, cluster_id, vec_id * 7919 % 1009 / CAST(1009 AS DOUBLE) AS i FROM embeddings LEFT JOIN c USING (vec_id)),
      w AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY i DESC, vec_id) AS n, count(*) OVER (PARTITION BY cluster_id) AS size FROM a)
      SELECT vec_id AS id, coalesce(cluster_id, -1) AS cluster_id, CASE WHEN cluster_id IS NULL THEN 1 ELSE size END AS n_members, round(i, 6) AS importance FROM w WHERE cluster_id IS NULL OR n = 1""",
}

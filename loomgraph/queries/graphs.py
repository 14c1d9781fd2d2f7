"""Graph queries: over places (customers, suppliers, nations, regions) and over trade between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import quality as Q
from loomgraph.sources import warehouse as W


def _places(s, d):
    edges = W.places(s, d).select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), F.col("relationship_type").alias("edge_type"), "weight", "confidence")
    return edges, W.entities(s, d).where("entity_type <> 'concept'").select("id")


def _trade(s, d):
    return W.trade(s, d), W.trade_nodes(s, d)


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _one_value(s, name, value):
    return s.range(1).select(F.lit(value).alias(name))


def _region_of(s, d):
    row = W.table(s, d, "customer").where("c_custkey = 7").join(W.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()
    return f"r{row['n_regionkey']}"


def _g24(s, d):
    e, _ = _trade(s, d)
    return G.cycles(e, 3).groupBy("length").agg(F.count("*").alias("n"))


QUERIES = {
    "g1_last_edge_wins": lambda s, d: G.simple_edges(W.table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("o"), "l_quantity"), None, "o").select("src", "dst", "l_quantity"),
    "j2_neighbours": lambda s, d: G.neighbours(_places(s, d)[0], "n3"),
    "g2_shortest_path_length": lambda s, d: G.hops(_trade(s, d)[0], s.createDataFrame([(0,)], "id int")).select("id", "distance"),
    "g3_weighted_distances": lambda s, d: _round(G.distances(_trade(s, d)[0], _trade(s, d)[1]), "distance").select("source", "id", "distance"),
    "g4_simple_paths": lambda s, d: _round(G.simple_paths(_trade(s, d)[0], 1, 2, 3, 10), "total_weight").select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length", "total_weight"),
    "g5_store_paths": lambda s, d: G.store_paths(_places(s, d)[0], "c7", _region_of(s, d), 3).select(F.array_join("path", ">").alias("path"), "length"),
    "g6_neighbourhood": lambda s, d: G.neighbourhood(_places(s, d)[0], "r2", 2),
    "g7_subgraph_edges": lambda s, d: G.subgraph(_places(s, d)[0], _places(s, d)[1].where("id like 'n%' or id like 'r%'"), both_ends=True)[1].select("src", "dst"),
    "g8_components": lambda s, d: G.components(*_places(s, d)),
    "g8_communities": lambda s, d: _round(G.communities(*_places(s, d)), "density"),
    "g9_degree_centrality": lambda s, d: _round(G.degrees(*_places(s, d)), "degree_centrality", "half_centrality"),
    "g10_pagerank": lambda s, d: _round(G.pagerank(*_trade(s, d), tolerance=1e-12), "rank", digits=5),
    "g11_degree_share": lambda s, d: _round(G.degree_share(*_trade(s, d)), "score"),
    "g12_betweenness": lambda s, d: _round(G.betweenness(*_trade(s, d), weighted=False), "betweenness"),
    "g13_closeness": lambda s, d: _round(G.closeness(*_trade(s, d)), "closeness"),
    "g14_importance": lambda s, d: _round(G.importance(*_trade(s, d)), "importance", digits=4).select("id", "importance"),
    "g15_label_communities": lambda s, d: G.label_communities(*_places(s, d)),
    "g16_modularity": lambda s, d: _round(G.modularity(_places(s, d)[0], G.components(*_places(s, d)).withColumnRenamed("component", "community")), "modularity"),
    "g17_summary": lambda s, d: _round(G.summary(*_places(s, d)), "density", "average_degree", "average_size"),
    "g18_clustering": lambda s, d: _round(G.clustering(*_trade(s, d)), "coefficient"),
    "g19_diameter": lambda s, d: _one_value(s, "diameter", G.diameter(*_trade(s, d))),
    "g20_component_sizes": lambda s, d: G.components(*_places(s, d)).groupBy("component").agg(F.count("*").alias("n")),
    "g21_hubs": lambda s, d: G.hubs(*_places(s, d)),
    "g22_centrality_averages": lambda s, d: _round(G.degrees(*_trade(s, d)).join(G.closeness(*_trade(s, d)), "id").agg(F.avg("degree_centrality").alias("degree"), F.avg("closeness").alias("closeness")), "degree", "closeness"),
    "g23_connectivity": lambda s, d: _round(Q.connectivity(W.entities(s, d), W.places(s, d)), "connectivity", "clustering"),
    "g24_cycles": _g24,
    "a2_type_distribution": lambda s, d: Q.type_distribution(W.entities(s, d), "entity_type"),
    "a3_density": lambda s, d: _round(G.density(*_places(s, d)), "density", "average_degree", digits=9),
    "a5_top_nodes": lambda s, d: G.degrees(*_places(s, d)).orderBy(F.desc("degree"), "id").limit(10).select("id", "degree"),
    "j1_edge_names": lambda s, d: W.places(s, d).join(W.entities(s, d).select(F.col("id").alias("target_entity_id"), F.col("name").alias("target_name")), "target_entity_id", "left").select("id", F.coalesce("target_name", F.lit("")).alias("target_name")),
    "u3_frontier": lambda s, d: G.hops(_places(s, d)[0], _places(s, d)[1].where("id = 'r0'"), 2, directed=False).where("distance = 2").select("id"),
}

_T = f"WITH {W.SQL}"
_R = f"WITH RECURSIVE {W.SQL}"
_G = f"""{_T}, g AS (SELECT id FROM entities WHERE entity_type <> 'concept'),
 region_of AS (SELECT 'n' || n_nationkey AS id, n_regionkey AS r FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region
   UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 named AS (SELECT id, min(id) OVER (PARTITION BY r) AS component FROM region_of),
 sized AS (SELECT component, count(*) AS size FROM named GROUP BY component),
 deg AS (SELECT g.id, (SELECT count(*) FROM places WHERE target_entity_id = g.id) AS i, (SELECT count(*) FROM places WHERE source_entity_id = g.id) AS o FROM g)"""
_BFS = """reach(source, id, distance) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT r.source, t.dst, r.distance + 1 FROM reach r JOIN trade t ON t.src = r.id WHERE r.distance < 8),
 hop AS (SELECT source, id, min(distance) AS distance FROM reach GROUP BY ALL)"""
_UND = "und AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM trade UNION ALL SELECT dst, src FROM trade))"
_SSSP = """walk(source, id, distance, steps) AS (SELECT n_nationkey, n_nationkey, CAST(0 AS DOUBLE), 0 FROM nation
   UNION ALL SELECT source, id, distance, steps FROM (SELECT w.source, t.dst AS id, min(w.distance + t.weight) AS distance, w.steps + 1 AS steps FROM walk w JOIN trade t ON t.src = w.id WHERE w.steps < 12 GROUP BY w.source, t.dst, w.steps)),
 best AS (SELECT source, id, min(distance) AS distance FROM walk GROUP BY ALL)"""
ORACLES = {
    "g1_last_edge_wins": "SELECT l_suppkey AS src, l_partkey AS dst, arg_max(l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_quantity}) AS l_quantity FROM lineitem GROUP BY ALL",
    "j2_neighbours": f"{_T} SELECT target_entity_id AS id FROM places WHERE source_entity_id = 'n3' UNION SELECT source_entity_id FROM places WHERE target_entity_id = 'n3'",
    "g2_shortest_path_length": f"{_R}, {_BFS} SELECT id, CAST(distance AS INTEGER) AS distance FROM hop WHERE source = 0",
    "g3_weighted_distances": f"{_R}, {_SSSP} SELECT source, id, round(distance, 6) AS distance FROM best",
    "g4_simple_paths": f"""{_T}, e AS (SELECT * FROM trade), p AS (
      SELECT '1>2' AS path, [1, 2] AS o, 1 AS length, weight AS w FROM e WHERE src = 1 AND dst = 2
      UNION ALL SELECT '1>' || a.dst || '>2', [1, a.dst, 2], 2, a.weight + b.weight FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 1 AND b.dst = 2 AND a.dst NOT IN (1, 2)
      UNION ALL SELECT '1>' || a.dst || '>' || b.dst || '>2', [1, a.dst, b.dst, 2], 3, a.weight + b.weight + c.weight FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src = 1 AND c.dst = 2 AND a.dst NOT IN (1, 2) AND b.dst NOT IN (1, 2) AND a.dst <> b.dst)
      SELECT path, length, round(w, 6) AS total_weight FROM p ORDER BY length, w, o LIMIT 10""",
    "g5_store_paths": f"{_T} SELECT 'c7>' || p.target_entity_id || '>' || q.target_entity_id AS path, 2 AS length FROM places p JOIN places q ON q.source_entity_id = p.target_entity_id WHERE p.source_entity_id = 'c7'",
    "g6_neighbourhood": f"{_G} SELECT id, CASE WHEN id LIKE 'r%' THEN 0 WHEN id LIKE 'n%' THEN 1 ELSE 2 END AS distance FROM region_of WHERE r = 2",
    "g7_subgraph_edges": "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation",
    "g8_components": f"{_G} SELECT id, component FROM named",
    "g8_communities": f"""{_G}, d AS (SELECT component, id, i + o AS degree, row_number() OVER (PARTITION BY component ORDER BY i + o DESC, id) AS r FROM deg JOIN named USING (id))
      SELECT component, size, round((size - 1) / (CAST(size AS DOUBLE) * (size - 1)), 6) AS density, (SELECT string_agg(id, ',' ORDER BY r) FROM d WHERE d.component = s.component AND r <= 3) AS central_nodes FROM sized s""",
    "g9_degree_centrality": f"{_G} SELECT id, i AS in_degree, o AS out_degree, i + o AS degree, round((i + o) / ((SELECT count(*) FROM g) - 1), 6) AS degree_centrality, round((i + o) / (2 * ((SELECT count(*) FROM g) - 1)), 6) AS half_centrality FROM deg",
    "g10_pagerank": f"""{_R}, o AS (SELECT src, sum(weight) AS w FROM trade GROUP BY src), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nation),
      pr(k, id, rank) AS (SELECT 0, n_nationkey, 1 / n FROM nation, n UNION ALL
        SELECT k + 1, id, rank FROM (SELECT p.k AS k, m.n_nationkey AS id, 0.15 / max(n.n) + 0.85 * (sum(CASE WHEN t.dst = m.n_nationkey THEN p.rank * t.weight / o.w ELSE 0 END) + sum(CASE WHEN o.src IS NULL AND t.src IS NULL THEN p.rank / n.n ELSE 0 END)) AS rank
          FROM pr p CROSS JOIN nation m CROSS JOIN n LEFT JOIN o ON o.src = p.id LEFT JOIN trade t ON t.src = p.id AND t.dst = m.n_nationkey WHERE p.k < 60 GROUP BY p.k, m.n_nationkey))
      SELECT id, round(rank, 5) AS rank FROM pr WHERE k = 60""",
    "g11_degree_share": f"{_T} SELECT n_nationkey AS id, round(((SELECT count(*) FROM trade WHERE src = n_nationkey) + (SELECT count(*) FROM trade WHERE dst = n_nationkey)) / CAST((SELECT count(*) FROM trade) AS DOUBLE), 6) AS score FROM nation",
    "g12_betweenness": f"""{_R}, {_BFS}, cnt(source, id, distance, sigma) AS (SELECT n_nationkey, n_nationkey, 0, CAST(1 AS DOUBLE) FROM nation
        UNION ALL SELECT source, id, distance, sigma FROM (SELECT c.source, t.dst AS id, c.distance + 1 AS distance, sum(c.sigma) AS sigma FROM cnt c JOIN trade t ON t.src = c.id JOIN hop h ON h.source = c.source AND h.id = t.dst AND h.distance = c.distance + 1 GROUP BY c.source, t.dst, c.distance)),
      pairs AS (SELECT a.id AS v, a.sigma * b.sigma / c.sigma AS x FROM cnt a JOIN cnt b ON b.source = a.id JOIN cnt c ON c.source = a.source AND c.id = b.id WHERE a.distance + b.distance = c.distance AND a.id <> a.source AND b.id <> a.id)
      SELECT n_nationkey AS id, round(coalesce(sum(x), 0) / (24.0 * 23.0), 6) AS betweenness FROM nation LEFT JOIN pairs ON v = n_nationkey GROUP BY n_nationkey""",
    "g13_closeness": f"{_R}, {_SSSP} SELECT n_nationkey AS id, round(coalesce(count(b.id) / sum(b.distance) * count(b.id) / 24.0, 0), 6) AS closeness FROM nation LEFT JOIN best b ON b.id = n_nationkey AND b.source <> b.id GROUP BY n_nationkey",
    "g16_modularity": f"{_G} SELECT round(sum((size - 1) / m - pow((size - 1) / m, 2)), 6) AS modularity FROM sized, (SELECT CAST(count(*) AS DOUBLE) AS m FROM places)",
    "g17_summary": f"""{_G}, n AS (SELECT count(*) AS n FROM g), m AS (SELECT count(*) AS m FROM places) SELECT n, m, round(m / (CAST(n AS DOUBLE) * (n - 1)), 6) AS density, round(2 * m / CAST(n AS DOUBLE), 6) AS average_degree,
      (SELECT count(*) FROM sized WHERE size >= 3) AS communities, (SELECT round(avg(size), 6) FROM sized WHERE size >= 3) AS average_size, (SELECT max(size) FROM sized) AS largest_size FROM n, m""",
    "g18_clustering": f"""{_T}, {_UND}, d AS (SELECT n_nationkey AS id, (SELECT count(*) FROM und WHERE src = n_nationkey) AS degree FROM nation),
      t AS (SELECT a.src AS id, count(*) / 2 AS t FROM und a JOIN und b ON b.src = a.src JOIN und c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
      SELECT d.id, degree, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (CAST(degree AS DOUBLE) * (degree - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t USING (id)""",
    "g19_diameter": f"""{_R}, {_UND}, far(source, id, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT f.source, u.dst, f.d + 1 FROM far f JOIN und u ON u.src = f.id WHERE f.d < 12)
      SELECT CAST(max(d) AS INTEGER) AS diameter FROM (SELECT source, id, min(d) AS d FROM far GROUP BY ALL)""",
    "g20_component_sizes": f"{_G} SELECT component, size AS n FROM sized",
    "g21_hubs": f"{_G}, a AS (SELECT avg(i + o) AS a FROM deg) SELECT id, i + o AS degree, CASE WHEN i + o = 0 THEN 'isolated' ELSE 'hub' END AS role FROM deg, a WHERE i + o = 0 OR i + o >= 2 * a",
    "g22_centrality_averages": f"""{_R}, {_SSSP}, c AS (SELECT coalesce(count(b.id) / sum(b.distance) * count(b.id) / 24.0, 0) AS c FROM nation LEFT JOIN best b ON b.id = n_nationkey AND b.source <> b.id GROUP BY n_nationkey)
      SELECT round((SELECT 2 * count(*) FROM trade) / 24.0 / 25.0, 6) AS degree, round(avg(c), 6) AS closeness FROM c""",
    "g23_connectivity": f"""{_G}, n AS (SELECT count(*) AS n FROM entities), k AS (SELECT (SELECT count(*) FROM sized) + (SELECT count(*) FROM part) AS c)
      SELECT n, c AS components, CAST(0 AS DOUBLE) AS clustering, round(0.7 * (1 - (c - 1) / CAST(n - 1 AS DOUBLE)), 6) AS connectivity FROM n, k""",
    "g24_cycles": f"""{_T} SELECT CAST(2 AS INTEGER) AS length, count(*) AS n FROM trade a JOIN trade b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst HAVING count(*) > 0
      UNION ALL SELECT 3, count(*) FROM trade a JOIN trade b ON a.dst = b.src JOIN trade c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst HAVING count(*) > 0""",
    "a2_type_distribution": f"{_T} SELECT entity_type AS type, count(*) AS n FROM entities GROUP BY entity_type",
    "a3_density": f"{_G}, n AS (SELECT count(*) AS n FROM g), m AS (SELECT count(*) AS m FROM places) SELECT n, m, round(m / (CAST(n AS DOUBLE) * (n - 1)), 9) AS density, round(2 * m / CAST(n AS DOUBLE), 9) AS average_degree FROM n, m",
    "a5_top_nodes": f"{_G} SELECT id, i + o AS degree FROM deg ORDER BY degree DESC, id LIMIT 10",
    "j1_edge_names": f"{_T} SELECT p.id, coalesce(e.name, '') AS target_name FROM places p LEFT JOIN entities e ON e.id = p.target_entity_id",
    "u3_frontier": f"{_G} SELECT id FROM region_of WHERE r = 0 AND id NOT LIKE 'n%' AND id NOT LIKE 'r%'",
}

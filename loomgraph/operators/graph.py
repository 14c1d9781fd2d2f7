"""Graph analytics on edge tables: ``src``, ``dst`` and, where asked for, ``weight``, ``confidence``, ``edge_type``.

Everything iterates over DataFrames. Frontiers are written to the shared folder
each round, so lineage stays short and a lost executor costs one re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.operators.components import connected_components


def simple_edges(edges: DataFrame, nodes: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """One edge for each pair, the last in `order`; both ends must be among `nodes`."""
    out = edges
    if nodes is not None:
        for end in ("src", "dst"):
            out = out.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    if order is None:
        return out.dropDuplicates(["src", "dst"])
    rest = [c for c in out.columns if c not in ("src", "dst")]
    return out.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), order).alias("_e")).select("src", "dst", "_e.*")


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair of different nodes once, in both directions."""
    one = edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbours(edges: DataFrame, node, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    own = edges.where(F.col("edge_type").isin(types)) if types else edges
    out = own.where(F.col("src") == node).select(F.col("dst").alias("id"))
    back = own.where(F.col("dst") == node).select(F.col("src").alias("id"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction].distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In, out and total degree of every node, and both normalisations of degree centrality."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    own = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = nodes.count()
    out = nodes.select("id").join(own, "id", "left").fillna(0, ["in_degree", "out_degree"]).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return out.withColumns({"degree_centrality": F.col("degree") / max(1, n - 1), "half_centrality": F.col("degree") / (2 * max(1, n - 1))})


def degree_share(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Approximation of PageRank by total degree over the number of edges; 1/n where there are none."""
    m, n = edges.count(), nodes.count()
    return degrees(edges, nodes).select("id", (F.col("degree") / m if m else F.lit(1.0 / max(1, n))).alias("score"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    one = nodes.agg(F.count("*").alias("n")).withColumn("m", F.lit(edges.count()))
    some = F.col("n") > 1
    return one.select("n", "m", F.when(some, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"), F.when(F.col("n") > 0, 2 * F.col("m") / F.col("n")).otherwise(0.0).alias("average_degree"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, component)``: weakly connected components; a node without edges is its own."""
    own = connected_components(edges.select("src", "dst")).withColumnRenamed("node", "id")
    return nodes.select("id").join(own, "id", "left").withColumn("component", F.coalesce("component", "id"))


def communities(edges: DataFrame, nodes: DataFrame, min_size: int = 3, top: int = 3) -> DataFrame:
    """Components of `min_size` nodes or more: size, density of the edges within, and the `top` nodes by degree within."""
    own = scratch.write(components(edges, nodes), "communities")
    at = own.select(F.col("id").alias("src"), "component")
    to = own.select(F.col("id").alias("dst"), F.col("component").alias("_to"))
    inside = edges.join(at, "src").join(to, "dst").where("component = _to")
    m = inside.groupBy("component").agg(F.count("*").alias("m"))
    deg = inside.select("component", F.explode(F.array("src", "dst")).alias("id")).groupBy("component", "id").agg(F.count("*").alias("degree"))
    w = Window.partitionBy("component").orderBy(F.desc("degree"), "id")
    best = deg.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("b"))
    size = own.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    out = size.join(m, "component", "left").join(best, "component", "left")
    d = F.coalesce("m", F.lit(0)) / (F.col("size") * (F.col("size") - 1))
    return out.select("component", "size", F.when(F.col("size") > 1, d).otherwise(0.0).alias("density"), F.concat_ws(",", F.transform("b", lambda x: x["id"].cast("string"))).alias("central_nodes"))


def label_communities(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """``(id, community)`` by label propagation: each node takes the most frequent label around it, ties to the smallest; even and odd ids move in turn."""
    both = scratch.write(undirected(edges), "lpa")
    own = scratch.write(nodes.select("id", F.col("id").alias("community")), "lpa")
    for r in range(rounds):
        votes = both.join(own.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("new"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2
        new = scratch.write(own.join(best, own["id"] == best["src"], "left").select("id", F.when(turn, F.coalesce("new", "community")).otherwise(F.col("community")).alias("community")), "lpa")
        moved = new.join(own.withColumnRenamed("community", "old"), "id").where("community != old").limit(1).count()
        own = new
        if not moved and r:
            break
    return own


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Newman's modularity of a partition of the undirected graph."""
    e = undirected(edges).where("src < dst")
    at = membership.select(F.col("id").alias("src"), F.col("community").alias("a"))
    to = membership.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    own = e.join(at, "src").join(to, "dst")
    m = F.lit(own.count())
    part = own.select(F.col("a").alias("c"), F.when(F.col("a") == F.col("b"), 1).otherwise(0).alias("w"), F.lit(1).alias("d")).unionByName(own.select(F.col("b").alias("c"), F.lit(0).alias("w"), F.lit(1).alias("d")))
    sums = part.groupBy("c").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    return sums.agg(F.coalesce(F.sum(F.col("w") / m - F.pow(F.col("d") / (2 * m), 2)), F.lit(0.0)).alias("modularity"))


def hops(edges: DataFrame, starts: DataFrame, most: int | None = None, directed: bool = True) -> DataFrame:
    """``(source, id, distance)``: least number of edges from each start (column ``id``), up to `most`. Frontiers drop what was reached before."""
    step = scratch.write((edges.select("src", "dst").distinct() if directed else undirected(edges)), "step")
    seen = scratch.write(starts.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")), "hops")
    front, k = seen, 0
    while most is None or k < most:
        k += 1
        new = front.join(step, front["id"] == step["src"]).select("source", F.col("dst").alias("id")).distinct().join(seen.select("source", "id"), ["source", "id"], "left_anti")
        front = scratch.write(new.select("source", "id", F.lit(k).alias("distance")), "front")
        if not front.limit(1).count():
            break
        seen = scratch.write(seen.unionByName(front), "hops")
    return seen


def neighbourhood(edges: DataFrame, node, radius: int = 1, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes within `radius` undirected steps, the centre included."""
    known = (nodes.select("id") if nodes is not None else edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()).where(F.col("id") == node)
    return hops(edges, known, radius, directed=False).select("id", "distance")


def distances(edges: DataFrame, starts: DataFrame, min_confidence: float = 0.0, rounds: int = 1000) -> DataFrame:
    """``(source, id, distance)``: least total weight from each start, by relaxing the nodes that improved in the round before."""
    own = edges.where(F.col("confidence") >= min_confidence) if min_confidence and "confidence" in edges.columns else edges
    step = scratch.write(own.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "step")
    best = scratch.write(starts.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")), "dist")
    front = best
    for _ in range(rounds):
        offer = front.join(step, front["id"] == step["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
        better = offer.join(best, ["source", "id"], "left").where(F.col("distance").isNull() | (F.col("offer") < F.col("distance") - 1e-12))
        front = scratch.write(better.select("source", "id", F.col("offer").alias("distance")), "front")
        if not front.limit(1).count():
            break
        best = scratch.write(best.join(front.select("source", "id"), ["source", "id"], "left_anti").unionByName(front), "dist")
    return best


def simple_paths(edges: DataFrame, source, target, cutoff: int = 4, most: int | None = 10) -> DataFrame:
    """Paths without repeated nodes of up to `cutoff` edges: path, length, weight, edge types, least confidence; shortest first, then lightest, then by nodes."""
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("weight").alias("_w"), F.col("confidence").alias("_c"), F.col("edge_type").alias("_t"))
    start = edges.select(F.explode(F.array("src", "dst")).alias("id")).where(F.col("id") == source).distinct()
    front = start.select(F.array("id").alias("path"), F.lit(0).alias("length"), F.lit(0.0).alias("total_weight"), F.array().cast("array<string>").alias("edge_types"), F.lit(1.0).alias("confidence"))
    if source == target:
        return front
    found = None
    for _ in range(cutoff):
        on = front.join(e, F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_d")))
        front = scratch.write(on.select(F.array_append("path", F.col("_d")).alias("path"), (F.col("length") + 1).alias("length"), (F.col("total_weight") + F.col("_w")).alias("total_weight"), F.array_append("edge_types", F.col("_t")).alias("edge_types"), F.least("confidence", F.col("_c")).alias("confidence")), "paths")
        done = front.where(F.element_at("path", -1) == target)
        found = done if found is None else found.unionByName(done)
        front = front.where(F.element_at("path", -1) != target)
    out = found.orderBy("length", "total_weight", "path")
    return out.limit(most) if most else out


def shortest_path(edges: DataFrame, source, target, most: int = 6) -> DataFrame:
    """One path of fewest edges, ties to the lightest and then the smallest nodes; none beyond `most` edges."""
    near = hops(edges, edges.select(F.explode(F.array("src", "dst")).alias("id")).where(F.col("id") == source).distinct(), most).where(F.col("id") == target).first()
    return simple_paths(edges, source, target, near["distance"] if near else 0, 1) if near else simple_paths(edges.where("false"), source, target, 1, 1)


def store_paths(edges: DataFrame, source, target, depth: int = 5, types: list[str] | None = None, most: int = 10) -> DataFrame:
    """Paths as the store finds them: of up to `depth` edges of the given types, shortest first."""
    own = edges.where(F.col("edge_type").isin(types)) if types else edges
    return simple_paths(own, source, target, depth, most).select("path", "length")


def subgraph(edges: DataFrame, ids: DataFrame, both_ends: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around `ids`: edges with both ends in them, or with either end, whose other ends come along."""
    own = ids.select("id").distinct()
    a, b = own.select(F.col("id").alias("src")), own.select(F.col("id").alias("dst"))
    if both_ends:
        return own, edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")
    kept = edges.join(a.withColumn("_a", F.lit(True)), "src", "left").join(b.withColumn("_b", F.lit(True)), "dst", "left").where("_a or _b").drop("_a", "_b")
    return own.unionByName(kept.select(F.explode(F.array("src", "dst")).alias("id"))).distinct(), kept


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Weighted PageRank; the mass of nodes without outgoing edges is spread evenly; ends when the total change is under n * `tolerance`."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    one = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")) if "weight" in edges.columns else edges.select("src", "dst", F.lit(1.0).alias("weight"))
    out = one.groupBy("src").agg(F.sum("weight").alias("_out"))
    share = scratch.write(one.join(out, "src").where("_out > 0").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "share")
    sources = share.select("src").distinct().withColumn("_has", F.lit(True))
    own = scratch.write(nodes.select("id").distinct().join(sources, F.col("id") == F.col("src"), "left").select("id", F.coalesce("_has", F.lit(False)).alias("has"), F.lit(1.0 / n).alias("rank")), "rank")
    for _ in range(rounds):
        loose = own.where("not has").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = share.join(own.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = own.withColumnRenamed("rank", "old").join(got, "id", "left").withColumn("rank", F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0)))
        new = scratch.write(new.select("id", "has", "rank", "old"), "rank")
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        own = new.drop("old")
        if change < n * tolerance:
            break
    return own.select("id", "rank")


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closeness by incoming weighted distances, scaled by the share of nodes that reach the node."""
    n = nodes.count()
    d = distances(edges, nodes).where("source != id").groupBy("id").agg(F.sum("distance").alias("total"), F.count("*").alias("k"))
    out = nodes.select("id").join(d, "id", "left")
    return out.select("id", F.when((F.col("total") > 0) & (n > 1), F.col("k") / F.col("total") * F.col("k") / (n - 1)).otherwise(0.0).alias("closeness"))


def betweenness(edges: DataFrame, nodes: DataFrame, weighted: bool = True) -> DataFrame:
    """Share of shortest paths through each node, normalised by (n-1)(n-2).

    Counts of shortest paths go forward over the edges that lie on one, in order
    of distance rank, and dependencies come back the same way: two joins a level
    for all sources at once.
    """
    n = nodes.count()
    base = edges.where("src != dst")
    step = scratch.write(base.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if weighted else base.select("src", "dst").distinct().withColumn("weight", F.lit(1.0)), "step")
    dist = scratch.write(distances(step, nodes), "dist")
    to = dist.select("source", F.col("id").alias("dst"), F.col("distance").alias("far"))
    tight = scratch.write(dist.withColumnRenamed("id", "src").join(step, "src").join(to, ["source", "dst"]).where(F.abs(F.col("distance") + F.col("weight") - F.col("far")) < 1e-9).select("source", "src", "dst"), "tight")
    # longest number of edges of a shortest path to a node sets the level in which its count is complete
    level = scratch.write(dist.where("source = id").select("source", "id", F.lit(0).alias("level")), "level")
    front, k = level, 0
    while front.limit(1).count():
        k += 1
        new = front.select("source", F.col("id").alias("src")).join(tight, ["source", "src"]).select("source", F.col("dst").alias("id")).distinct()
        front = scratch.write(new.withColumn("level", F.lit(k)), "front")
        level = scratch.write(level.join(front.select("source", "id"), ["source", "id"], "left_anti").unionByName(front), "level")
    depth = level.agg(F.max("level")).first()[0] or 0
    paths = scratch.write(level.where("level = 0").select("source", "id", F.lit(1.0).alias("sigma")), "sigma")
    for k in range(1, depth + 1):
        now = level.where(F.col("level") == k).select("source", F.col("id").alias("dst"))
        got = tight.join(now, ["source", "dst"]).join(paths.select("source", F.col("id").alias("src"), "sigma"), ["source", "src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        paths = scratch.write(paths.unionByName(got), "sigma")
    credit = scratch.write(level.where(F.col("level") == depth).select("source", "id", F.lit(0.0).alias("delta")), "delta")
    for k in range(depth - 1, -1, -1):
        now = level.where(F.col("level") == k).select("source", "id")
        after = credit.join(paths, ["source", "id"]).select("source", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("part"))
        got = tight.join(after, ["source", "dst"]).join(paths.select("source", F.col("id").alias("src"), "sigma"), ["source", "src"]).groupBy("source", F.col("src").alias("id")).agg(F.sum(F.col("part") * F.col("sigma")).alias("delta"))
        credit = scratch.write(credit.unionByName(now.join(got, ["source", "id"], "left").fillna(0.0, ["delta"])), "delta")
    total = credit.where("source != id").groupBy("id").agg(F.sum("delta").alias("total"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) * scale).alias("betweenness"))


def importance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """.3 degree + .4 betweenness + .3 PageRank."""
    out = degrees(edges, nodes).select("id", "degree_centrality").join(betweenness(edges, nodes), "id").join(pagerank(edges, nodes), "id")
    return out.withColumn("importance", 0.3 * F.col("degree_centrality") + 0.4 * F.col("betweenness") + 0.3 * F.col("rank"))


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, triangles, degree, coefficient)`` on the undirected graph. Wedges start at the end of lower degree, which bounds them on hubs."""
    both = scratch.write(undirected(edges), "undirected")
    deg = both.groupBy("src").agg(F.count("*").alias("degree"))
    d = scratch.write(deg, "degree")
    up = both.join(d.withColumnRenamed("degree", "a"), "src").join(d.select(F.col("src").alias("dst"), F.col("degree").alias("b")), "dst")
    up = scratch.write(up.where("a < b or (a = b and src < dst)").select("src", "dst"), "up")
    x = up.select(F.col("src").alias("p"), F.col("dst").alias("q"))
    y = up.select(F.col("src").alias("p"), F.col("dst").alias("r"))
    wedge = x.join(y, "p").where("q < r").select("p", "q", "r")
    closed = up.select(F.least("src", "dst").alias("q"), F.greatest("src", "dst").alias("r"))
    tri = wedge.join(closed, ["q", "r"]).select(F.explode(F.array("p", "q", "r")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = nodes.select("id").join(d.withColumnRenamed("src", "id"), "id", "left").join(tri, "id", "left").fillna(0, ["degree", "triangles"])
    return out.withColumn("coefficient", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def diameter(edges: DataFrame, nodes: DataFrame) -> int:
    """Longest undirected distance within the largest component (ties to the smallest id)."""
    own = components(edges, nodes)
    best = own.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    if not best:
        return 0
    inside = scratch.write(own.where(F.col("component") == best["component"]).select("id"), "largest")
    return int(hops(edges, inside, directed=False).agg(F.max("distance")).first()[0] or 0)


def cycles(edges: DataFrame, most: int = 8) -> DataFrame:
    """Elementary directed cycles of up to `most` edges, each once and beginning with its smallest node.

    Of a strongly connected group that has only longer ones, the shortest through its smallest node is given. Nodes that no cycle can hold are shed first, layer by layer.
    """
    e = scratch.write(edges.select("src", "dst").distinct(), "cycles")
    while True:
        n = e.count()
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = scratch.write(kept.select("src", "dst"), "cycles")
        if e.count() == n:
            break
    step = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    front = e.select("src").distinct().select(F.array("src").alias("path"))
    found = None
    for _ in range(most):
        on = front.join(step, F.element_at("path", -1) == F.col("_s"))
        done = on.where(F.col("_d") == F.col("path")[0]).select("path")
        found = done if found is None else found.unionByName(done)
        front = scratch.write(on.where((F.col("_d") > F.col("path")[0]) & ~F.array_contains("path", F.col("_d"))).select(F.array_append("path", F.col("_d")).alias("path")), "cycles")
        if not front.limit(1).count():
            break
    else:
        groups = strong_groups(e)
        met = found.select(F.col("path")[0].alias("id")).join(groups, "id").select("root")
        found = found.unionByName(_root_cycles(e, groups.join(met, "root", "left_anti")))
    return found.withColumn("length", F.size("path"))


def strong_groups(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of the strongly connected groups of two or more nodes; root is a member.

    The smallest node that reaches each is its colour; those of a colour that reach it back are one group and leave the graph.
    """
    e, out = scratch.write(edges.select("src", "dst").where("src != dst").distinct(), "strong"), None
    while True:
        colour = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("c", F.col("id"))
        colour = scratch.write(colour, "strong")
        while True:
            via = e.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("d"))
            new = scratch.write(colour.join(via, "id", "left").select("id", F.least("c", "d").alias("c"), (F.col("d") < F.col("c")).alias("less")), "strong")
            colour = new.select("id", "c")
            if not new.where("less").limit(1).count():
                break
        ends = colour.select(F.col("id").alias("src"), "c").join(e, "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst")
        inside = scratch.write(ends.where("c = d").select("src", "dst"), "strong")
        group = front = scratch.write(colour.where("id = c").select("id", F.col("c").alias("root")), "strong")
        while True:
            back = inside.join(front.select(F.col("id").alias("dst"), "root"), "dst").select(F.col("src").alias("id"), "root").distinct()
            front = scratch.write(back.join(group.select("id"), "id", "left_anti"), "strong")
            if not front.limit(1).count():
                break
            group = scratch.write(group.unionByName(front), "strong")
        out = group if out is None else out.unionByName(group)
        gone = group.select("id")
        e = scratch.write(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "strong")
        if not e.limit(1).count():
            break
    large = out.groupBy("root").count().where("count > 1").select("root")
    return scratch.write(out.join(large, "root").select("id", "root"), "strong")


def _root_cycles(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``path``: for each root its shortest cycle within its group, ties to the smallest path."""
    groups = scratch.write(groups.groupBy("root").agg(F.min("id").alias("least"), F.collect_list("id").alias("ids")).select(F.col("least").alias("root"), F.explode("ids").alias("id")), "strong")
    inside = scratch.write(edges.join(groups.withColumnRenamed("id", "src"), "src").join(groups.select(F.col("id").alias("dst"), F.col("root").alias("_r")), "dst").where("root = _r").select("root", "src", "dst"), "strong")
    front = scratch.write(groups.where("id = root").select("root", "id", F.array("id").alias("path")), "strong")
    seen, found = front.select("root", "id"), None
    while True:
        on = front.join(inside.withColumnRenamed("src", "id"), ["root", "id"])
        done = scratch.write(on.where("dst = root").groupBy("root").agg(F.min("path").alias("path")), "strong")
        found = done.select("path") if found is None else found.unionByName(done.select("path"))
        step = on.join(done.select("root"), "root", "left_anti").select("root", F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        front = scratch.write(step.join(seen, ["root", "id"], "left_anti").groupBy("root", "id").agg(F.min("path").alias("path")), "strong")
        if not front.limit(1).count():
            return found
        seen = scratch.write(seen.unionByName(front.select("root", "id")), "strong")


def hubs(edges: DataFrame, nodes: DataFrame, times: float = 2.0) -> DataFrame:
    """Nodes whose degree is `times` the average or more (role hub), and those without edges (role isolated)."""
    own = scratch.write(degrees(edges, nodes), "degrees")
    average = own.agg(F.avg("degree")).first()[0] or 0.0
    role = F.when(F.col("degree") == 0, "isolated").when((F.col("degree") >= times * average) & F.lit(average > 0), "hub")
    return own.select("id", "degree", role.alias("role")).where("role is not null")


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average degree, communities and their average and largest size."""
    sizes = communities(edges, nodes).agg(F.count("*").alias("communities"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("average_size"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_size")).first()
    return density(edges, nodes).withColumns({k: F.lit(sizes[k]) for k in ("communities", "average_size", "largest_size")})

"""Graph queries over edges (edge_id, src, dst).

Paths are arrays of hops struct<node, edge> without the source. Comparing such arrays gives the order in which a
search that visits neighbours by (node, edge) finds them, so the first path found is the least one.
"""

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions.columns import uuid5
from mnemos.functions.shared import settled, spread
from mnemos.operators.ranges import numbered

#: The most sweeps of label propagation; the namespace of URL-named UUIDs.
SWEEPS, URL_NAMESPACE = 25, "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(node, edge, neighbour). In `both`, a loop counts twice."""
    out = edges.select(F.col("src").alias("node"), F.col("edge_id").alias("edge"), F.col("dst").alias("neighbour"))
    back = edges.select(F.col("dst").alias("node"), F.col("edge_id").alias("edge"), F.col("src").alias("neighbour"))
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node_id)."""
    n = nodes.select("node_id").distinct()
    return edges.join(n, edges["src"] == n["node_id"], "left_semi").join(n, edges["dst"] == n["node_id"], "left_semi")


def one_hop(seeds: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    return neighbours(edges, direction).join(seeds.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame, normalised: bool = True) -> DataFrame:
    """(node_id, in_degree, out_degree, degree, centrality) of all nodes; centrality is the degree over n - 1, or the degree."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    n = nodes.count() if normalised else 0
    out = nodes.join(sums, "node_id", "left").select("node_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    total = F.col("in_degree") + F.col("out_degree")
    return out.withColumn("degree", total).withColumn("centrality", total / F.lit(float(max(1, n - 1))) if normalised else total.cast("double"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    return nodes.join(ends, "node_id", "left_anti")


def common_neighbours(edges: DataFrame, a: str, b: str, limit: int | None = None) -> DataFrame:
    """(neighbour, edges): nodes next to both a and b, and the sorted edges that lead there."""
    near = neighbours(edges).where(F.col("node").isin(a, b))
    out = near.groupBy("neighbour").agg(F.count_distinct("node").alias("_n"), F.sort_array(F.collect_list("edge")).alias("edges")).where("_n = 2").select("neighbour", "edges").orderBy("neighbour")
    return out.limit(limit) if limit is not None else out


def local_graph(edges: DataFrame, root: str, depth: int, direction: str = "both") -> DataFrame:
    """(node_id, depth) of the nodes within `depth` hops of the root."""
    return nearest(edges, edges.sparkSession.createDataFrame([(root,)], "node_id string"), depth, direction)


def nearest(edges: DataFrame, roots: DataFrame, depth: int | None, direction: str = "both") -> DataFrame:
    """(node_id, depth): hops from the nearest of several roots (node_id), up to a depth if there is one."""
    return _nearest(settled(neighbours(edges, direction).select("node", "neighbour")), roots, depth)


def _nearest(near: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    """`nearest` over (node, neighbour). A small frontier goes to the neighbours, which then aren't dealt and sorted anew at each hop."""
    found = roots.select("node_id").distinct().withColumn("depth", F.lit(0))
    frontier = found
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        step = near.join(spread(frontier.select(F.col("node_id").alias("node"))), "node", "left_semi").select(F.col("neighbour").alias("node_id")).distinct()
        frontier = settled(step.join(found.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def snapshot(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int, dangling: bool = False, orphans_too: bool = True) -> tuple[DataFrame, DataFrame]:
    """The first nodes, with their degrees, and of the edges between them the first, by id.

    dangling: also edges whose target is unknown (null); they don't count as degrees. orphans_too: nodes without an edge stay.
    """
    n = nodes.orderBy("node_id").limit(most_nodes)
    inside = visible(edges, n)
    if dangling:
        inside = inside.unionByName(edges.where("dst is null").join(n.select(F.col("node_id").alias("src")), "src", "left_semi").select(*edges.columns))
    kept = inside.orderBy("edge_id").limit(most_edges)
    counted = n.join(degrees(n, kept.where("dst is not null"), False).select("node_id", "in_degree", "out_degree"), "node_id")
    return counted if orphans_too else counted.where("in_degree + out_degree > 0"), kept


def local_snapshot(edges: DataFrame, root: str, depth: int, most_nodes: int, most_edges: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(nodes with depth and degrees, edges) around a root: nodes by depth and id, up to a limit, and the first edges, by the depth they are met at and
    id, of those that nodes nearer than `depth` have. Degrees count the edges that are kept."""
    near = local_graph(edges, root, depth, direction).orderBy("depth", "node_id").limit(most_nodes)
    open_ = near.where(F.col("depth") < depth).select("node_id", "depth")
    met = neighbours(edges, direction).select("node", "edge").join(open_, F.col("node") == F.col("node_id")).groupBy(F.col("edge").alias("edge_id")).agg(F.min("depth").alias("_d"))
    kept = edges.join(met, "edge_id").orderBy("_d", "edge_id").limit(most_edges).drop("_d")
    return near.join(degrees(near, kept, False).select("node_id", "in_degree", "out_degree"), "node_id"), kept


def _grown(paths: DataFrame, near: DataFrame) -> DataFrame:
    """Paths (source, last, hops) a hop longer, without those that come back to a node."""
    hop = F.struct(F.col("neighbour").alias("node"), F.col("edge").alias("edge"))
    seen = F.array_contains(F.transform("hops", lambda h: h["node"]), F.col("neighbour")) | (F.col("neighbour") == F.col("source"))
    return paths.join(near, paths["last"] == near["node"]).where(~seen).select("source", F.col("neighbour").alias("last"), F.concat("hops", F.array(hop)).alias("hops"))


def _started(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("last"), F.array().cast("array<struct<node: string, edge: string>>").alias("hops"))


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, depth: int | None = None, direction: str = "both") -> DataFrame:
    """(source, target, hops): one shortest path from each source to each node reached, that which sorts first.

    One path is kept for each node and level, so levels stay as small as the graph. Without a depth all nodes that can be reached are. With targets only nodes are gone to from
    which one of them can still be reached in the hops that are left, and the search ends when every source has met every target.
    """
    near = settled(neighbours(edges, direction))
    level = settled(_started(sources.distinct()))
    found, left, wanted = level, None, None
    if targets is not None:
        ends = settled(targets.select("node_id").distinct())
        left = settled(nearest(edges, ends, depth, {"out": "in", "in": "out"}.get(direction, "both")).select(F.col("node_id").alias("last"), F.col("depth").alias("_left")))
        ends = ends.select(F.col("node_id").alias("last"))
        wanted = sources.select("node_id").distinct().count() * ends.count()
    for i in itertools.count() if depth is None else range(depth):
        if wanted is not None and found.join(ends, "last", "left_semi").count() == wanted:
            break
        best = _grown(level, near).groupBy("source", "last").agg(F.min("hops").alias("hops"))
        if left is not None:
            best = best.join(left if depth is None else left.where(F.col("_left") <= depth - i - 1), "last", "left_semi").select("source", "last", "hops")
        level = settled(best.join(found.select("source", "last"), ["source", "last"], "left_anti"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    out = found.select("source", F.col("last").alias("target"), "hops")
    return out if targets is None else out.join(targets.select(F.col("node_id").alias("target")), "target", "left_semi").select("source", "target", "hops")


def simple_paths(edges: DataFrame, source: str, target: str, depth: int = 4, most: int | None = None, direction: str = "both") -> DataFrame:
    """Paths without repeated nodes from source to target, by hops, nodes and edges; `most`: only the first that a depth-first search finds.

    Only nodes from which the target can still be reached in the hops that are left are gone to, so what is kept are beginnings of walks that end there.
    """
    near = settled(neighbours(edges, direction))
    start = edges.sparkSession.createDataFrame([(source,)], "node_id string")
    level = _started(start)
    back = near.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))
    left = settled(_nearest(back, edges.sparkSession.createDataFrame([(target,)], "node_id string"), depth)).select(F.col("node_id").alias("last"), F.col("depth").alias("_left"))
    done = None
    for i in range(depth):
        level = _grown(spread(level), near).join(spread(left), "last").where(F.col("_left") <= depth - i - 1).select("source", "last", "hops")
        level = settled(level)
        ends = level.where(F.col("last") == target)
        done = ends if done is None else done.unionByName(ends)
        level = level.where(F.col("last") != target)
    if most is not None:
        done = done.orderBy(F.slice("hops", 1, F.size("hops") - 1), F.element_at("hops", -1)["edge"].desc()).limit(most)
    return done.select("source", F.col("last").alias("target"), "hops").orderBy(F.size("hops"), F.transform("hops", lambda h: h["node"]), F.transform("hops", lambda h: h["edge"]))


def patterns(edges: DataFrame, seeds: DataFrame, candidates: DataFrame, least: int = 1, most: int = 2, limit: int | None = None) -> DataFrame:
    """For each seed and candidate the first path that a depth-first search of up to `most` hops finds; dropped if it is shorter than `least`."""
    near = settled(neighbours(edges))
    level, done = _started(seeds), None
    wanted = candidates.select(F.col("node_id").alias("last")).distinct()
    for _ in range(most):
        level = settled(_grown(level, near))
        ends = level.join(wanted, "last", "left_semi").select(*level.columns)
        done = ends if done is None else done.unionByName(ends)
    w = Window.partitionBy("source", "last").orderBy(F.slice("hops", 1, F.size("hops") - 1), F.element_at("hops", -1)["edge"].desc())
    first = done.withColumn("_n", F.row_number().over(w)).where("_n = 1").where(F.size("hops") >= least)
    out = first.select("source", F.col("last").alias("target"), "hops").orderBy("source", "target")
    return out.limit(limit) if limit is not None else out


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node_id, component): the least node that can be reached. Labels jump to their labels' labels, so long chains settle in few rounds."""
    both = settled(neighbours(edges).select("node", "neighbour").distinct())
    labels = settled(nodes.select("node_id", F.col("node_id").alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both["neighbour"] == labels["node_id"]).groupBy("node").agg(F.min("component").alias("_m"))
        nearer = labels.join(near, labels["node_id"] == near["node"], "left").select("node_id", F.col("component").alias("_was"), F.least("component", "_m").alias("_to"))
        its = labels.select(F.col("node_id").alias("_of"), F.col("component").alias("_its"))
        jumped = settled(nearer.join(its, F.col("_to") == F.col("_of"), "left").select("node_id", "_was", F.least("_to", "_its").alias("component")))
        labels = jumped.select("node_id", "component")
        if jumped.where("_was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def label_propagation(nodes: DataFrame, edges: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """(node_id, label) after sweeps in which every node takes the commonest label among its neighbours and itself, the least of equals.

    All nodes look at the labels of the sweep before (its own label keeps a node from swapping with its neighbour for ever), so a sweep is one
    join and one count and no component has to fit in a task. Ends when no label changes, or after the last sweep.
    """
    near = neighbours(edges).select("node", "neighbour").unionByName(nodes.select(F.col("node_id").alias("node"), F.col("node_id").alias("neighbour")))
    near = settled(near.join(nodes.select(F.col("node_id").alias("node")), "node", "left_semi").groupBy("node", "neighbour").agg(F.count("*").alias("_n")))
    labels = settled(nodes.select("node_id", F.col("node_id").alias("label")))
    for _ in range(sweeps):
        votes = near.join(labels, F.col("neighbour") == F.col("node_id")).groupBy("node", "label").agg(F.sum("_n").alias("_v"))
        best = votes.groupBy("node").agg(F.min(F.struct(-F.col("_v"), F.col("label"))).alias("_b"))
        new = settled(labels.join(best, F.col("node") == F.col("node_id")).select("node_id", F.col("label").alias("_was"), F.col("_b.label").alias("label")))
        labels = new.select("node_id", "label")
        if new.where("_was <> label").isEmpty():
            break
    return labels


def communities(labels: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(label, community_id, size, seed, internal_edges, score) of groups (node_id, label) with at least `least` members, largest first.

    The score is the edges inside over size - 1. The id is a UUID of the size and two sums over the members' hashes, so members are never gathered;
    they are the rows of labels. seed: the member with the greatest degree, the least id of equals.
    """
    ends = neighbours(edges).groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("_degree"))
    h = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "node_id"), F.lit(1 << 53))
    members = labels.join(ends, "node_id", "left").groupBy("label")
    groups = members.agg(F.count("*").cast("int").alias("size"), F.min_by("node_id", F.struct(-F.coalesce("_degree", F.lit(0)), F.col("node_id"))).alias("seed"), F.min("node_id").alias("_first"), F.sum(h(1).cast("decimal(38,0)")).alias("_x"), F.sum(h(2).cast("decimal(38,0)")).alias("_y"))
    a, b = labels.select(F.col("node_id").alias("src"), F.col("label").alias("_a")), labels.select(F.col("node_id").alias("dst"), F.col("label").alias("_b"))
    inside = edges.join(a, "src").join(b, "dst").where("_a = _b").groupBy(F.col("_a").alias("label")).agg(F.count("*").alias("internal_edges"))
    out = groups.where(F.col("size") >= least).join(inside, "label", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    key = F.concat_ws("|", F.col("size").cast("string"), F.col("_x").cast("string"), F.col("_y").cast("string"))
    score = F.col("internal_edges") / F.greatest(F.lit(1), F.col("size") - 1)
    return out.orderBy(F.desc("size"), "_first").select("label", uuid5(URL_NAMESPACE, key).alias("community_id"), "size", "seed", "internal_edges", score.alias("score"))


def community_status(changes: DataFrame, pinned: int) -> DataFrame:
    """One row: whether communities that were computed at a cursor are stale, the last cursor that matters, and the kinds of objects that changed since."""
    since = changes.where((F.col("cursor") > pinned) & F.col("object_type").isin("record", "relation", "link"))
    return since.agg((F.count("*") > 0).alias("stale"), F.coalesce(F.max("cursor"), F.lit(pinned)).alias("latest_cursor"), F.array_sort(F.collect_set("object_type")).alias("stale_reasons"))


def community_hits(labels: DataFrame, records: DataFrame, edges: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, label, score) of records (id, source_id, updated_at) in communities, latest first: the degree, and a tenth more with a source."""
    ends = neighbours(edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("_degree"))
    chosen = labels if ids is None else labels.where(F.col("label").isin(ids))
    found = records.join(chosen.withColumnRenamed("node_id", "id"), "id").join(ends, "id", "left")
    score = F.coalesce("_degree", F.lit(0)) + F.when(F.col("source_id").isNotNull(), 0.1).otherwise(0.0)
    out = found.orderBy(F.desc("updated_at"), "id").select("id", "label", score.alias("score"))
    return out.limit(limit) if limit is not None else out


def community_paths(labels: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, hops): from each community's seed (label, seed) to each other member the first path of up to two hops, as a depth-first search finds it.

    Paths of two hops are only built between members that are asked for.
    """
    asked = labels.join(seeds, "label").where("node_id <> seed").select(F.col("seed").alias("source"), F.col("node_id").alias("target"))
    near = neighbours(edges)
    one = asked.join(near, (F.col("source") == F.col("node")) & (F.col("target") == F.col("neighbour"))).select("source", "target", F.array(F.struct(F.col("neighbour").alias("node"), F.col("edge").alias("edge"))).alias("hops"))
    first = near.join(asked.select(F.col("source").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("source"), F.col("neighbour").alias("_mid"), F.col("edge").alias("_e"))
    last = near.select(F.col("node").alias("_mid"), F.col("neighbour").alias("target"), F.col("edge").alias("_f"))
    two = first.join(last, "_mid").where("source <> _mid and target <> source and target <> _mid").join(asked, ["source", "target"], "left_semi")
    two = two.select("source", "target", F.array(F.struct(F.col("_mid").alias("node"), F.col("_e").alias("edge")), F.struct(F.col("target").alias("node"), F.col("_f").alias("edge"))).alias("hops"))
    # The search looks at the ends of a path after its beginnings, and at the last hop from the greatest edge down.
    both = one.unionByName(two).withColumn("_k", F.slice("hops", 1, F.size("hops") - 1))
    best = both.groupBy("source", "target").agg(F.min("_k").alias("_k"))
    return both.join(best, ["source", "target", "_k"]).groupBy("source", "target").agg(F.max_by("hops", F.element_at("hops", -1)["edge"]).alias("hops"))


def source_sets(labels: DataFrame, records: DataFrame) -> DataFrame:
    """(label, key, n): how many members of each community come from each source, and have each source id."""
    m = records.join(labels.withColumnRenamed("node_id", "id"), "id")
    keys = F.array_compact(F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("source_id:"), "source_id")))
    return m.select("label", F.explode(keys).alias("key")).groupBy("label", "key").agg(F.count("*").alias("n"))


def layout(labels: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, label, weight, radius): the degree, and one more."""
    d = degrees(nodes, edges, False).select("node_id", F.col("degree").cast("double").alias("weight"))
    return d.join(labels, "node_id", "left").select("node_id", "label", "weight", (F.col("weight") + 1).alias("radius"))


def membership_ranks(labels: DataFrame, degree: DataFrame) -> DataFrame:
    """Place of each node in its group, by degree and then id. Groups are numbered by ranges, so none has to fit in a task."""
    members = labels.join(degree.select("node_id", "degree"), "node_id")
    return numbered(members, ["label"], [F.desc("degree"), F.asc("node_id")], "rank")


# What an external graph store answers, on the tables


def node_filter(nodes: DataFrame, labels: list[str] | None = None, namespace: str | None = None, properties: dict | None = None, limit: int | None = None) -> DataFrame:
    """Nodes (node_id, labels array, namespace, properties map) with one of the labels, in a namespace (a null one never matches) and with all properties; by id."""
    out = nodes
    if labels:
        out = out.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    if namespace is not None:
        out = out.where(F.col("namespace") == namespace)
    for k, v in (properties or {}).items():
        out = out.where(F.col("properties")[k] == str(v))
    out = out.orderBy("node_id")
    return out.limit(limit) if limit is not None else out


def store_neighbours(edges: DataFrame, nodes: DataFrame, node: str, types: list[str] | None = None, namespace: str | None = None, limit: int | None = None) -> DataFrame:
    """(target, edge_id, relation_type) over the edges that go out of a node, by target and edge. A namespace must be the edge's and the target's."""
    out = edges.where(F.col("src") == node)
    out = out.where(F.col("relation_type").isin(types)) if types else out
    there = nodes
    if namespace is not None:
        out, there = out.where(F.col("namespace") == namespace), nodes.where(F.col("namespace") == namespace)
    out = out.join(there.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("target"), "edge_id", "relation_type").orderBy("target", "edge_id")
    return out.limit(limit) if limit is not None else out


def store_patterns(edges: DataFrame, seeds: DataFrame, candidates: DataFrame, least: int = 1, most: int = 2, limit: int | None = None) -> DataFrame:
    """(source, target, hops): the shortest path over out edges from each seed to each candidate, if it has from `least` to `most` hops, in order of both."""
    found = shortest_paths(edges, seeds, candidates, most, "out").where((F.size("hops") >= least) & (F.size("hops") > 0)).orderBy("source", "target")
    return found.limit(limit) if limit is not None else found


def record_nodes(records: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, label, title, in_degree, out_degree, orphan) of records; degrees count resolved links, and an orphan has none."""
    d = degrees(records.select(F.col("id").alias("node_id")), link_edges(links).where("dst is not null").select("edge_id", "src", "dst"), False)
    n = records.select(F.col("id").alias("node_id"), F.col("type").alias("label"), "title")
    return n.join(d.select("node_id", "in_degree", "out_degree"), "node_id").withColumn("orphan", F.col("in_degree") + F.col("out_degree") == 0)


def link_edges(links: DataFrame) -> DataFrame:
    """(edge_id, src, dst, relation_type, unresolved_target) of links; an edge without a target keeps what the link says."""
    return links.select(F.col("link_id").alias("edge_id"), F.col("source_record_id").alias("src"), F.col("target_record_id").alias("dst"), F.col("link_kind").alias("relation_type"), F.when(F.col("target_record_id").isNull(), F.col("raw_target")).alias("unresolved_target"))


def export_batch(records: DataFrame, relations: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of records, and edges of relations and of resolved links with a relation type; relations from unknown records, and edges to nowhere, are dropped."""
    ids = records.select(F.col("id").alias("src"))
    of_relations = relations.join(ids, "src", "left_semi").select("edge_id", "src", "dst", "relation_type")
    of_links = links.where("resolution_status = 'resolved' and relation_type is not null").select(F.col("link_id").alias("edge_id"), F.col("source_record_id").alias("src"), F.col("target_record_id").alias("dst"), "relation_type")
    edges = of_relations.unionByName(of_links.join(ids, "src", "left_semi").select("edge_id", "src", "dst", "relation_type")).where("dst is not null")
    return records.select(F.col("id").alias("node_id"), F.col("type").alias("label"), "title"), edges


def related_records(edges: DataFrame, records: DataFrame, record: str, direction: str = "both", types: list[str] | None = None, limit: int | None = None, scopes: list[str] | None = None) -> DataFrame:
    """(edge_id, id): records at the other end of a record's edges (edge_id, src, dst, relation_type, created_at), the newest first. The limit counts
    edges before scopes are looked at."""
    out = edges.where((F.col("src") == record) & F.lit(direction in ("out", "both")) | (F.col("dst") == record) & F.lit(direction in ("in", "both")))
    out = (out.where(F.col("relation_type").isin(types)) if types else out).orderBy(F.desc("created_at"), "edge_id")
    out = out.limit(limit) if limit is not None else out
    other = F.when(F.col("src") == record, F.col("dst")).otherwise(F.col("src"))
    there = records.where(F.col("scope").isin(scopes)) if scopes else records
    return out.select("edge_id", other.alias("id")).join(there.select("id"), "id", "left_semi").select("edge_id", "id")


def planned(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n) of a query's stages, in order: how many rows each had."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        line = df.agg(F.lit(i).alias("_i"), F.lit(name).alias("stage"), F.count("*").alias("n"))
        out = line if out is None else out.unionByName(line)
    return out.orderBy("_i").drop("_i")

"""Queries over graphs, vectors and hybrid retrieval, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.operators import graph as g
from mnemos.operators import retrieval as r
from mnemos.operators.records import search_text
from mnemos.plans.record_queries import _RECORDS
from mnemos.sources import tables as t

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_NODES = "n AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer)"
_EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
_BOTH = "b AS (SELECT src || '>' || dst AS edge, src AS u, dst AS v FROM e UNION ALL SELECT src || '>' || dst, dst, src FROM e)"
_PARTS = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"


def _hops(c="hops"):
    return F.concat_ws(",", F.transform(c, lambda h: h["node"]))


@query(f"WITH {_NODES}, {_EDGES} SELECT n.id AS node_id, CAST(count(*) FILTER (e.dst = n.id) AS BIGINT) AS in_degree, CAST(count(*) FILTER (e.src = n.id) AS BIGINT) AS out_degree, round(count(e.src) / (SELECT count(*) - 1 FROM n), 9) AS centrality FROM n LEFT JOIN e ON n.id = e.src OR n.id = e.dst GROUP BY n.id")
def degree_metrics(spark, sf) -> DataFrame:
    return g.degrees(t.nodes(spark, sf), t.edges(spark, sf)).select("node_id", F.col("in_degree").cast("long"), F.col("out_degree").cast("long"), F.round("centrality", 9).alias("centrality"))


@query("SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_nodes(spark, sf) -> DataFrame:
    """Customers without an order, in the graph of customers and orders."""
    edges = t.table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return g.orphans(t.nodes(spark, sf).where("label = 'customer'"), edges).select("node_id")


@query(f"WITH {_EDGES}, {_BOTH} SELECT u AS node, edge, v AS neighbour FROM b WHERE u IN ('n1', 'r2', 's3')")
def neighbours_both(spark, sf) -> DataFrame:
    return g.one_hop(spark.createDataFrame([("n1",), ("r2",), ("s3",)], "node_id string"), t.edges(spark, sf))


@query(f"WITH {_EDGES} SELECT src AS node, src || '>' || dst AS edge, dst AS neighbour FROM e WHERE src LIKE 's%'")
def neighbours_out(spark, sf) -> DataFrame:
    return g.one_hop(t.nodes(spark, sf).where("label = 'supplier'"), t.edges(spark, sf), "out")


@query(f"WITH {_PARTS}, {_BOTH} SELECT v AS neighbour, string_agg(edge, ',' ORDER BY edge) AS edges FROM b WHERE u IN ('p1', 'p2') GROUP BY v HAVING count(DISTINCT u) = 2")
def common_neighbours(spark, sf) -> DataFrame:
    return g.common_neighbours(t.supply_edges(spark, sf), "p1", "p2").select("neighbour", F.concat_ws(",", "edges").alias("edges"))


@query(f"WITH RECURSIVE {_EDGES}, {_BOTH}, reach(id, d) AS (SELECT 'n1', 0 UNION SELECT v, d + 1 FROM reach JOIN b ON u = id WHERE d < 2) SELECT id AS node_id, min(d) AS depth FROM reach GROUP BY id")
def local_graph(spark, sf) -> DataFrame:
    return g.local_graph(t.edges(spark, sf), "n1", 2)


@query(
    f"""WITH {_NODES}, {_EDGES}, k AS (SELECT id FROM n ORDER BY id LIMIT 300)
SELECT src || '>' || dst AS edge_id, src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) ORDER BY edge_id LIMIT 200"""
)
def graph_snapshot(spark, sf) -> DataFrame:
    return g.snapshot(t.nodes(spark, sf), t.edges(spark, sf), 300, 200)[1].select("edge_id", "src", "dst")


@query(
    f"""WITH RECURSIVE {_EDGES}, {_BOTH}, p(id, d, hops) AS (SELECT 's1', 0, CAST([] AS STRUCT(node VARCHAR, edge VARCHAR)[]) UNION ALL SELECT v, d + 1, list_append(hops, {{'node': v, 'edge': edge}}) FROM p JOIN b ON u = id WHERE d < 8 AND NOT list_contains(list_transform(hops, lambda x: x.node), v) AND v <> 's1'),
best AS (SELECT id, d, hops, row_number() OVER (PARTITION BY id ORDER BY d, hops) AS n FROM p)
SELECT 's1' AS source, id AS target, array_to_string(list_transform(hops, lambda x: x.node), ',') AS path FROM best WHERE n = 1"""
)
def shortest_paths(spark, sf) -> DataFrame:
    return g.shortest_paths(t.edges(spark, sf), spark.createDataFrame([("s1",)], "node_id string")).select("source", "target", _hops().alias("path"))


@query(
    f"""WITH RECURSIVE {_PARTS}, {_BOTH}, p(id, hops) AS (SELECT 'p1', CAST([] AS STRUCT(node VARCHAR, edge VARCHAR)[]) UNION ALL SELECT v, list_append(hops, {{'node': v, 'edge': edge}}) FROM p JOIN b ON u = id WHERE len(hops) < 2 AND id <> 'p2' AND v <> 'p1' AND NOT list_contains(list_transform(hops, lambda x: x.node), v))
SELECT array_to_string(list_transform(hops, lambda x: x.node), ',') AS path FROM p WHERE id = 'p2'"""
)
def simple_paths(spark, sf) -> DataFrame:
    return g.simple_paths(t.supply_edges(spark, sf), "p1", "p2", 2).select(_hops().alias("path"))


@query(
    f"""WITH RECURSIVE {_EDGES}, {_BOTH}, p(source, id, hops) AS (SELECT u, u, CAST([] AS STRUCT(node VARCHAR, edge VARCHAR)[]) FROM (SELECT DISTINCT u FROM b WHERE u LIKE 'r%') UNION ALL SELECT source, v, list_append(hops, {{'node': v, 'edge': edge}}) FROM p JOIN b ON u = id WHERE len(hops) < 2 AND v <> source AND NOT list_contains(list_transform(hops, lambda x: x.node), v)),
first AS (SELECT source, id, hops, row_number() OVER (PARTITION BY source, id ORDER BY hops[1:len(hops) - 1], hops[len(hops)].edge DESC) AS n FROM p WHERE id LIKE 's%' AND len(hops) > 0)
SELECT source, id AS target, array_to_string(list_transform(hops, lambda x: x.node), ',') AS path FROM first WHERE n = 1 AND len(hops) >= 1"""
)
def pattern_match(spark, sf) -> DataFrame:
    n = t.nodes(spark, sf)
    return g.patterns(t.edges(spark, sf), n.where("label = 'region'"), n.where("label = 'supplier'")).select("source", "target", _hops().alias("path"))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, {_BOTH}, reach(x, y) AS (SELECT id, id FROM n WHERE id LIKE 'r%' OR id LIKE 'n%' UNION SELECT x, v FROM reach JOIN b ON u = y WHERE x LIKE 'r%'), c AS (SELECT y AS id, min(x) AS r FROM reach WHERE x LIKE 'r%' GROUP BY y) SELECT n.id AS node_id, min(m.id) OVER (PARTITION BY coalesce(c.r, n.id)) AS component FROM n LEFT JOIN c USING (id) JOIN n m ON m.id = n.id")
def connected_components(spark, sf) -> DataFrame:
    return g.components(t.nodes(spark, sf), t.edges(spark, sf))


@query()
def label_propagation(spark, sf) -> DataFrame:
    return g.label_propagation(t.nodes(spark, sf), t.edges(spark, sf))


@query(f"WITH {_EDGES}, l AS (SELECT id, 'x' || (length(id) % 3) AS label FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)) SELECT label_a AS label, size, internal_edges, round(internal_edges / greatest(1, size - 1), 9) AS score FROM (SELECT label AS label_a, CAST(count(*) AS INTEGER) AS size FROM l GROUP BY label) JOIN (SELECT a.label, count(*) AS internal_edges FROM e JOIN l a ON a.id = src JOIN l b ON b.id = dst AND a.label = b.label GROUP BY a.label) k ON k.label = label_a WHERE size >= 2")
def community_scores(spark, sf) -> DataFrame:
    e = t.edges(spark, sf)
    ends = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    c = g.communities(ends.withColumn("label", F.concat(F.lit("x"), F.length("node_id") % 3)), e, 2)
    return c.where("internal_edges > 0").select("label", "size", "internal_edges", F.round("score", 9).alias("score"))


@query(f"WITH {_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT id AS node_id, left(id, 1) AS label, degree, CAST(row_number() OVER (PARTITION BY left(id, 1) ORDER BY degree DESC, id) AS INTEGER) AS rank FROM d")
def membership_ranks(spark, sf) -> DataFrame:
    n, e = t.nodes(spark, sf), t.edges(spark, sf)
    return g.membership_ranks(n.select("node_id", F.left("node_id", F.lit(1)).alias("label")), g.degrees(n, e, False).where("degree > 0").select("node_id", F.col("degree").cast("long").alias("degree")))


@query(f"WITH {_RECORDS} SELECT lang AS community, 'source:' || source AS key, count(*) AS n FROM r GROUP BY ALL")
def community_sources(spark, sf) -> DataFrame:
    records = t.records(spark, sf)
    sets = g.source_sets(records.select(F.col("id").alias("node_id"), F.col("lang").alias("label")), records.withColumn("source_id", F.lit(None).cast("string")))
    return sets.withColumnRenamed("label", "community")


# Vectors


_QUERY = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def _first(spark, sf) -> list[float]:
    return t.embeddings(spark, sf).where("vec_id = 0").first()["vector"]


@query(f"SELECT 'doc-' || vec_id AS record_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY}) DESC, record_id LIMIT 10")
def vector_topk_cosine(spark, sf) -> DataFrame:
    return r.top_k(t.embeddings(spark, sf), _first(spark, sf), "cosine", 10).withColumn("score", F.round("score", 6))


@query(f"SELECT 'doc-' || vec_id AS record_id, round(-list_distance(CAST(embedding AS DOUBLE[]), {_QUERY}), 6) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_QUERY}), record_id LIMIT 10")
def vector_topk_l2(spark, sf) -> DataFrame:
    return r.top_k(t.embeddings(spark, sf), _first(spark, sf), "l2", 10).withColumn("score", F.round("score", 6))


@query(f"SELECT 'doc-' || vec_id AS record_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), {_QUERY}), 6) AS score FROM embeddings ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), {_QUERY}) DESC, record_id LIMIT 10")
def vector_topk_dot(spark, sf) -> DataFrame:
    return r.top_k(t.embeddings(spark, sf), _first(spark, sf), "dot", 10).withColumn("score", F.round("score", 6))


# Retrieval

_NOW = "2024-01-02"
_TRUST = {"validated": 1.0, "user_said": 0.8}
_KEYWORD = "kw AS (SELECT id, greatest(0, 1 - (row_number() OVER (ORDER BY updated_at DESC, id) - 1) / 40.0) AS w FROM (SELECT * FROM r WHERE contains(lower(title || chr(10) || content || chr(10) || lang), 'license') ORDER BY updated_at DESC, id LIMIT 40))"
_VECTOR = f"vs AS (SELECT 'doc-' || vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY}) AS w FROM embeddings ORDER BY w DESC, id LIMIT 20)"
_CAND = "cand AS (SELECT id FROM kw UNION SELECT id FROM vs)"
_RECENT = "rec AS (SELECT r.id, pow(0.5, greatest(0, epoch(TIMESTAMP '2024-01-02') - epoch(updated_at)) / 86400 / 7) AS w FROM r JOIN cand USING (id))"
_TRUSTED = "tr AS (SELECT r.id, CASE source WHEN 'validated' THEN 1.0 WHEN 'user_said' THEN 0.8 ELSE 0.5 END AS w FROM r JOIN cand USING (id))"


def _stages(spark, sf) -> DataFrame:
    records = t.records(spark, sf)
    keyword = r.keyword_stage(records, search_text(), "license", 40)
    vector = r.vector_stage(t.embeddings(spark, sf), _first(spark, sf), "cosine", 20)
    found = records.join(keyword.select("id").unionByName(vector.select("id")).distinct(), "id", "left_semi")
    return keyword.unionByName(vector).unionByName(r.recency_stage(found, F.lit(_NOW).cast("timestamp"), 7)).unionByName(r.trust_stage(found, _TRUST, 0.5))


def _fusion(stages: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{k}' AS kind, id, w FROM {v}" for k, v in stages.items())
    return f"ranked AS (SELECT id, kind, 1.0 / (60 + row_number() OVER (PARTITION BY kind ORDER BY w DESC, id)) AS s FROM ({parts}))"


@query(f"WITH {_RECORDS}, {_KEYWORD}, {_VECTOR}, {_CAND}, {_RECENT}, {_TRUSTED}, {_fusion({'keyword': 'kw', 'vector': 'vs', 'recency': 'rec', 'trust': 'tr'})} SELECT id, round(sum(s), 9) AS score FROM ranked GROUP BY id")
def retrieval_rrf(spark, sf) -> DataFrame:
    return r.fused(_stages(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_RECORDS}, {_KEYWORD}, {_VECTOR}, {_CAND}, {_RECENT} SELECT id, round(w, 9) AS score FROM rec")
def retrieval_recency(spark, sf) -> DataFrame:
    return _stages(spark, sf).where("kind = 'recency'").select("id", F.round("raw", 9).alias("score"))


@query(f"WITH {_RECORDS}, {_KEYWORD}, {_VECTOR}, {_CAND}, {_TRUSTED} SELECT id, CAST(w AS DOUBLE) AS weight FROM tr")
def retrieval_trust(spark, sf) -> DataFrame:
    return _stages(spark, sf).where("kind = 'trust'").select("id", "weight")


@query(f"WITH {_RECORDS}, {_KEYWORD}, {_VECTOR}, {_fusion({'keyword': 'kw', 'vector': 'vs'})}, s AS (SELECT id, sum(s) AS s FROM ranked GROUP BY id) SELECT id, round(CASE WHEN CAST(substr(id, 5) AS BIGINT) % 4 = 0 THEN 2.0 ELSE 0 END + s, 9) AS score FROM s")
def retrieval_rerank(spark, sf) -> DataFrame:
    two = _stages(spark, sf).where("kind in ('keyword', 'vector')")
    again = r.component(two.select("id").distinct().where(F.substring("id", 5, 20).cast("long") % 4 == 0), "rerank", F.lit(2.0))
    return r.fused(two.unionByName(again)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_EDGES}, {_BOTH}, k AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY edge DESC) AS n FROM b WHERE u IN ('n1', 'n2', 'r0')) SELECT v AS id, count(*) AS n, CAST(max(0.5) AS DOUBLE) AS raw FROM k WHERE n <= 20 GROUP BY v")
def graph_expansion(spark, sf) -> DataFrame:
    seeds = spark.createDataFrame([("n1",), ("n2",), ("r0",)], "id string")
    e = t.edges(spark, sf).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return r.graph_stage(seeds, e, 20).groupBy("id").agg(F.count("*").alias("n"), F.max("raw").alias("raw"))


@query(f"WITH {_RECORDS} SELECT id, row_number() OVER (ORDER BY confidence DESC, id) <= 30 AS included FROM r")
def item_budget(spark, sf) -> DataFrame:
    return r.item_budget(t.records(spark, sf).select("id", "confidence"), 30, [F.desc("confidence"), "id"]).select("id", "included")

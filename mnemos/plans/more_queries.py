"""Queries over single records, word indexes, store-like graph answers, replays, privacy and reviews, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos import schemas
from mnemos.operators import explorer, facts, policy, upkeep, views
from mnemos.operators import graph as g
from mnemos.operators import records as ops
from mnemos.plans.graph_queries import _EDGES, _NODES
from mnemos.plans.record_queries import _RECORDS
from mnemos.plans.typed_queries import made
from mnemos.sources import tables as t

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_RECORDS} SELECT id, title, lang FROM r WHERE id = 'doc-17'")
def record_by_id(spark, sf) -> DataFrame:
    return ops.got(t.records(spark, sf), "id", "doc-17").select("id", "title", "lang")


@query("SELECT 'records' AS name, count(*) AS n FROM documents UNION ALL SELECT 'orders', count(*) FROM orders")
def table_counts(spark, sf) -> DataFrame:
    return ops.counts({"records": t.records(spark, sf), "orders": t.order_records(spark, sf)})


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE list_contains(regexp_extract_all(lower(concat_ws(' ', title, scope, 'fact', lang, content)), '[\\p{{L}}\\p{{N}}_]+'), 'license') AND list_contains(regexp_extract_all(lower(concat_ws(' ', title, scope, 'fact', lang, content)), '[\\p{{L}}\\p{{N}}_]+'), 'en')")
def word_prefilter(spark, sf) -> DataFrame:
    return ops.with_words(ops.word_index(t.records(spark, sf)), "License, EN")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'new' ELSE c_name END AS title, c_custkey % 4 = 2 AS archived FROM customer WHERE c_custkey % 4 < 3 UNION ALL SELECT c_custkey, 'made', FALSE FROM customer WHERE c_custkey % 4 = 3")
def human_notes(spark, sf) -> DataFrame:
    k = F.col("id")
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("c").alias("content"), F.lit("2024").alias("updated_at"), F.lit(False).alias("archived"))
    action = F.when(k % 4 == 1, "update").when(k % 4 == 2, "archive").when(k % 4 == 3, "create")
    edits = c.where(k % 4 > 0).select("id", action.alias("action"), F.when(k % 4 == 1, "new").when(k % 4 == 3, "made").alias("title"), F.lit(None).cast("string").alias("content"))
    return ops.notes_after(c.where(k % 4 < 3), edits, F.lit("2025")).select("id", "title", "archived")


def _store_nodes(spark, sf):
    return t.nodes(spark, sf).select("node_id", F.array("label", F.left("node_id", F.lit(2))).alias("labels"), F.when(F.length("node_id") != 3, F.concat(F.lit("ns"), F.length("node_id"))).alias("namespace"), F.create_map(F.lit("size"), F.length("node_id").cast("string")).alias("properties"))


@query(f"WITH {_NODES} SELECT id AS node_id FROM n WHERE (id LIKE 's%' OR left(id, 2) = 'c1') AND length(id) = 4 ORDER BY id LIMIT 50")
def store_node_filter(spark, sf) -> DataFrame:
    return g.node_filter(_store_nodes(spark, sf), ["supplier", "c1"], "ns4", {"size": 4}, 50).select("node_id")


@query(f"WITH {_EDGES} SELECT dst AS target, src || '>' || dst AS edge_id FROM e WHERE src = 's7' ORDER BY dst, edge_id LIMIT 10")
def store_neighbours(spark, sf) -> DataFrame:
    return g.store_neighbours(t.edges(spark, sf), t.nodes(spark, sf), "s7", ["supports"], None, 10).select("target", "edge_id")


@query(f"WITH {_EDGES} SELECT a.src AS source, b.dst AS target, a.dst || ',' || b.dst AS path FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 's%' ORDER BY 1, 2 LIMIT 70")
def store_patterns(spark, sf) -> DataFrame:
    n = t.nodes(spark, sf)
    return g.store_patterns(t.edges(spark, sf), n.where("label = 'supplier'"), n.where("label = 'region'"), 1, 2, 70).select("source", "target", F.concat_ws(",", F.transform("hops", lambda h: h["node"])).alias("path"))


def _record_links(spark, sf):
    k = F.col("doc_id")
    r = t.records(spark, sf)
    links = r.where(k % 2 == 0).select(F.concat(F.lit("l"), k).alias("link_id"), F.col("id").alias("source_record_id"), F.when(k % 4 == 0, F.concat(F.lit("doc-"), k + 1)).alias("target_record_id"), F.lit("wikilink").alias("link_kind"), F.concat(F.lit("t"), k).alias("raw_target"))
    return r, links


@query(f"WITH {_RECORDS}, l AS (SELECT doc_id, 'doc-' || doc_id AS src, 'doc-' || (doc_id + 1) AS dst FROM documents WHERE doc_id % 4 = 0) SELECT id AS node_id, CAST((SELECT count(*) FROM l WHERE dst = id) AS BIGINT) AS in_degree, CAST((SELECT count(*) FROM l WHERE src = id) AS BIGINT) AS out_degree, id NOT IN (SELECT src FROM l) AND id NOT IN (SELECT dst FROM l) AS orphan FROM r")
def record_nodes(spark, sf) -> DataFrame:
    return g.record_nodes(*_record_links(spark, sf)).select("node_id", "in_degree", "out_degree", "orphan")


@query("SELECT 'l' || doc_id AS edge_id, CASE WHEN doc_id % 4 > 0 THEN 't' || doc_id END AS unresolved_target FROM documents WHERE doc_id % 2 = 0")
def link_edges(spark, sf) -> DataFrame:
    return g.link_edges(_record_links(spark, sf)[1]).select("edge_id", "unresolved_target")


@query(f"WITH {_RECORDS} SELECT 'l' || doc_id AS edge_id FROM r WHERE doc_id % 4 = 0 AND doc_id % 3 > 0 UNION ALL SELECT 'rel' || doc_id FROM r WHERE doc_id % 5 = 0 AND lang = 'en'")
def graph_export(spark, sf) -> DataFrame:
    r, links = _record_links(spark, sf)
    k = F.col("doc_id")
    relations = r.where(k % 5 == 0).select(F.concat(F.lit("rel"), k).alias("edge_id"), F.when(F.col("lang") == "en", F.col("id")).otherwise("gone").alias("src"), F.lit("doc-1").alias("dst"), F.lit("supports").alias("relation_type"))
    n = F.substring("link_id", 2, 20).cast("long")
    typed = links.withColumns({"resolution_status": F.when(F.col("target_record_id").isNotNull(), "resolved").otherwise("unresolved"), "relation_type": F.when(n % 3 > 0, "related_to")})
    return g.export_batch(r, relations, typed)[1].select("edge_id")


@query(f"WITH {_EDGES}, x AS (SELECT src || '>' || dst AS edge_id, CASE WHEN src = 'n4' THEN dst ELSE src END AS id FROM e WHERE src = 'n4' OR dst = 'n4' ORDER BY length(src) DESC, edge_id LIMIT 12) SELECT * FROM x WHERE id NOT LIKE 's%'")
def related_records(spark, sf) -> DataFrame:
    edges = t.edges(spark, sf).withColumn("created_at", F.length("src"))
    return g.related_records(edges, t.nodes(spark, sf).select(F.col("node_id").alias("id"), F.col("label").alias("scope")), "n4", "both", None, 12, ["customer", "region", "nation"])


@query(f"WITH {_NODES}, {_EDGES} SELECT 'nodes' AS stage, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'paths', count(*) FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 's%'")
def query_stages(spark, sf) -> DataFrame:
    n, e = t.nodes(spark, sf), t.edges(spark, sf)
    return g.planned({"nodes": n, "edges": e, "paths": g.store_patterns(e, n.where("label = 'supplier'"), n.where("label = 'region'"))})


_REPLAY = "SELECT 'ep-' || conv_id AS episode_id, turn AS position, 'x' || turn AS id, turn * 10 AS at, 'a' || (turn % 3) AS a, 'tool-' || (turn % 2) AS tool_id FROM conversations"


@query(
    f"""WITH x AS ({_REPLAY}), e AS (SELECT * FROM x WHERE episode_id = 'ep-1'), s AS (SELECT 'step' AS kind, id, "at" FROM (SELECT * FROM e ORDER BY position, id LIMIT 4) WHERE "at" >= 10 AND "at" < 60),
o AS (SELECT 'outcome' AS kind, id, "at" FROM (SELECT * FROM e ORDER BY "at" DESC, id DESC LIMIT 4) WHERE "at" >= 10 AND "at" < 60), d AS (SELECT 'decision' AS kind, id, "at" FROM (SELECT * FROM e WHERE position % 2 = 0 ORDER BY "at" DESC, id DESC LIMIT 4) WHERE "at" >= 10 AND "at" < 60)
SELECT * FROM s UNION ALL SELECT * FROM o UNION ALL SELECT * FROM d"""
)
def full_replay(spark, sf) -> DataFrame:
    x = made(spark, sf, _REPLAY).withColumn("artifact_ids", F.array("a"))
    return facts.full_replay(x, x, x.where("position % 2 = 0"), "ep-1", 10, 60, 4).select("kind", "id", "at")


@query(f"WITH x AS ({_REPLAY}), e AS (SELECT * FROM x WHERE episode_id = 'ep-1') SELECT count(*) AS steps, (SELECT count(*) FROM e) AS outcomes, CAST(0 AS BIGINT) AS decisions, (SELECT string_agg(a, ',' ORDER BY p) FROM (SELECT a, min(position) AS p FROM e GROUP BY a)) AS artifacts, (SELECT string_agg(tool_id, ',' ORDER BY p) FROM (SELECT tool_id, min(position) AS p FROM e GROUP BY tool_id)) AS tools FROM e")
def replay_summary(spark, sf) -> DataFrame:
    x = made(spark, sf, _REPLAY).withColumn("artifact_ids", F.array("a"))
    out = facts.replay_summary(facts.full_replay(x, x, x.limit(0), "ep-1"))
    return out.select("steps", "outcomes", "decisions", F.array_join("artifacts", ",").alias("artifacts"), F.array_join("tools", ",").alias("tools"))


@query(f"WITH {_RECORDS} SELECT id, lang FROM r WHERE access_count >= 3 ORDER BY title, id LIMIT 15")
def live_panel(spark, sf) -> DataFrame:
    return views.panel(t.records(spark, sf).where("access_count >= 3"), ["title", "id"], 15).select("id", "lang")


@query(f"WITH {_RECORDS}, p AS (SELECT * FROM r WHERE contains(lower(concat_ws(chr(10), title, content, lang)), 'license') ORDER BY updated_at DESC, id LIMIT 30) SELECT id FROM p WHERE lang = 'en'")
def saved_view(spark, sf) -> DataFrame:
    requests = spark.createDataFrame([("mine", '{"query": "License", "filters": {"tags": ["en"]}, "limit": 30}')], "name string, request string")
    none = spark.createDataFrame([], "source_record_id string, target_record_id string")
    return explorer.saved(requests, "mine", t.records(spark, sf), spark.createDataFrame([], "edge_id string, src string, dst string"), none)["hits"].select("id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hidden' ELSE 'visible' END AS was, 'redacted' AS now, 'v' || doc_id AS other FROM documents")
def privacy_policies(spark, sf) -> DataFrame:
    meta = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"privacy": {"retrieval": "hidden"}, "other": "v'), "doc_id", F.lit('"}'))).otherwise(F.concat(F.lit('{"other": "v'), "doc_id", F.lit('"}')))
    d = t.table(spark, sf, "documents").select("doc_id", meta.alias("meta"))
    d = d.withColumn("after", policy.with_privacy(F.col("meta"), F.lit("redacted"), F.lit("visible")))
    return d.select("doc_id", policy.privacy_of(F.col("meta"))["retrieval_visibility"].alias("was"), F.get_json_object(F.get_json_object("after", "$.privacy"), "$.retrieval").alias("now"), F.get_json_object("after", "$.other").alias("other"))


@query("SELECT 'org_id=o' || c_nationkey || '|agent_id=a' || c_custkey || '|session_id=delegated:t1' AS namespace FROM customer")
def scratch_namespaces(spark, sf) -> DataFrame:
    c = t.table(spark, sf, "customer")
    return c.select(policy.scratch_namespace(F.concat(F.lit("org_id=o"), "c_nationkey"), F.concat(F.lit("a"), "c_custkey"), F.lit("t1")).alias("namespace"))


@query("SELECT DISTINCT 'o' || o_custkey AS target_id, o_orderstatus AS requested_by FROM orders WHERE o_orderstatus <> 'F'")
def review_requests(spark, sf) -> DataFrame:
    changes = t.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("target_id"), F.col("o_orderstatus").alias("actor"), F.when(F.col("o_orderstatus") == "F", "owner").otherwise("viewer").alias("role"))
    return policy.review_requests(changes, ["owner", "maintainer"]).select("target_id", "requested_by")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'unknown_ontology' WHEN doc_id % 2 = 0 THEN 'missing:name' ELSE 'type:size' END AS violations FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 OR doc_id % 5 = 0")
def ontology_lookups(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    props = F.map_from_entries(F.array_compact(F.array(F.when(k % 2 > 0, F.struct(F.lit("name").alias("key"), F.lit("n").alias("value"))), F.struct(F.lit("size").alias("key"), F.when((k % 5 == 0) & (k % 2 > 0), "big").otherwise("3").alias("value")))))
    rows = t.table(spark, sf, "documents").select(k.alias("id"), F.lit("o").alias("ontology_id"), F.when(k % 3 == 0, "v9").otherwise("v1").alias("version"), F.lit("thing").alias("category"), props.alias("properties"))
    ontologies = spark.createDataFrame([("o", "v1")], "ontology_id string, version string")
    types = spark.createDataFrame([("thing",)], "category string")
    properties = spark.createDataFrame([("thing", "name", "str", True), ("thing", "size", "int", False)], "category string, name string, kind string, required boolean")
    return policy.validated(rows, ontologies, types, properties).select("id", F.array_join("violations", ",").alias("violations"))


@query("WITH h AS (SELECT 'p' || (o_custkey % 40) AS path, o_orderstatus AS content_hash, o_orderkey AS w FROM orders), x AS (SELECT *, lag(content_hash) OVER (PARTITION BY path ORDER BY w) AS was FROM h) SELECT path, row_number() OVER (PARTITION BY path ORDER BY w) AS revision, content_hash FROM x WHERE was IS NULL OR was <> content_hash")
def workspace_history(spark, sf) -> DataFrame:
    h = made(spark, sf, "SELECT 'p' || (o_custkey % 40) AS path, o_orderstatus AS content_hash, o_orderkey AS at FROM orders")
    return upkeep.revisions(h, "path").select("path", "revision", "content_hash")


@query("SELECT count(DISTINCT (provider, model)) AS versions FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN 'alpha' ELSE 'beta' END AS provider, 'm' || (vec_id % 4) AS model FROM embeddings)")
def embedding_versions(spark, sf) -> DataFrame:
    return t.embeddings(spark, sf).select(upkeep.version_hash(["provider", "model"]).alias("h")).agg(F.count_distinct("h").alias("versions"))


@query("SELECT 'doc-' || doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 'type,confidence' WHEN doc_id % 2 = 0 THEN 'type' WHEN doc_id % 3 = 0 THEN 'confidence' ELSE '' END AS broken FROM documents")
def record_rules(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    rows = t.records(spark, sf).withColumns({"type": F.when(k % 2 > 0, F.col("type")), "confidence": F.when(k % 3 == 0, 1.5).otherwise(F.col("confidence"))})
    return rows.select("id", F.array_join(schemas.record_violations(), ",").alias("broken"))


@query("SELECT count(*) FILTER (event_type = 'click') AS broken, count(*) AS n FROM events")
def change_rules(spark, sf) -> DataFrame:
    rows = t.changes(spark, sf).withColumn("operation", F.when(F.col("object_type") == "link", "rename").otherwise(F.col("operation")))
    return rows.agg(F.count_if(F.size(schemas.change_violations()) > 0).alias("broken"), F.count("*").alias("n"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'link_kind' WHEN 2 THEN 'target' WHEN 3 THEN 'relation_type,resolution_status,target' ELSE '' END AS broken FROM documents")
def edge_rules(spark, sf) -> DataFrame:
    k = F.col("doc_id") % 4
    rows = t.table(spark, sf, "documents").select("doc_id", F.when(k == 3, "hates").alias("relation_type"), F.when(k == 1, "smell").otherwise("embed").alias("link_kind"), F.when(k == 2, "unresolved").when(k == 3, "odd").otherwise("resolved").alias("resolution_status"), F.lit("r").alias("target_record_id"))
    return rows.select("doc_id", F.array_join(schemas.edge_violations(), ",").alias("broken"))

"""Queries over context packages, trust, exports and integrity, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.operators import context as c
from mnemos.plans.graph_queries import _BOTH, _EDGES
from mnemos.plans.record_queries import _RECORDS
from mnemos.plans.typed_queries import made
from mnemos.sources import bundles
from mnemos.sources import tables as t

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH {_EDGES}, {_BOTH}, s(id, position) AS (VALUES ('n1', 1), ('r0', 2), ('n2', 3)),
near AS (SELECT u, v, edge, position, row_number() OVER (PARTITION BY u ORDER BY edge DESC) AS n FROM b JOIN s ON s.id = u QUALIFY n <= 30),
first AS (SELECT v, arg_min(edge, (position, n, edge)) AS via, min(position) AS p, min(CAST(position AS BIGINT) * 1000 + n) AS o FROM near WHERE v NOT IN (SELECT id FROM s) GROUP BY v),
items AS (SELECT id, 'seed' AS scope, 1.0 AS score, NULL AS via, CAST(position AS BIGINT) AS o FROM s UNION ALL SELECT v, 'neighbor', 0.5, via, 1000000 + o FROM first)
SELECT id, scope, CAST(score AS DOUBLE) AS score, via, row_number() OVER (ORDER BY o, id) <= 40 AS included FROM items"""
)
def context_local_graph(spark, sf) -> DataFrame:
    nodes = t.nodes(spark, sf).select(F.col("node_id").alias("id"))
    seeds = spark.createDataFrame([("n1", 1), ("r0", 2), ("n2", 3), ("nowhere", 4)], "id string, position int")
    edges = t.edges(spark, sf).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return c.local_context(nodes, seeds, edges, 30, 40).drop("position")


@query(
    """WITH q AS (SELECT doc_id AS position, 's' || (doc_id % 300) AS summary_id, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id) AS nth FROM documents),
x AS (SELECT position, summary_id, CASE WHEN k % 7 = 0 THEN 'not_found' WHEN nth > 1 THEN 'duplicate' WHEN k % 5 = 0 THEN 'namespace_excluded' WHEN k % 3 = 0 THEN 'invalidated' WHEN k % 11 = 0 THEN 'hidden' WHEN k % 13 = 0 THEN 'audit_only' WHEN k % 17 = 0 THEN 'denied' END AS reason FROM (SELECT *, CAST(substr(summary_id, 2) AS INT) AS k FROM q))
SELECT position, summary_id, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL ORDER BY position) > 25 THEN 'budget_exceeded' ELSE reason END AS reason FROM x"""
)
def context_summaries(spark, sf) -> DataFrame:
    d = t.table(spark, sf, "documents").select("doc_id")
    k = F.col("k")
    s = d.select((F.col("doc_id") % 300).alias("k")).distinct().where(k % 7 != 0)
    visibility = F.when(k % 11 == 0, "hidden").when(k % 13 == 0, "audit_only").otherwise("visible")
    s = s.select(F.concat(F.lit("s"), k).alias("summary_id"), (k % 5 != 0).alias("in_namespace"), (k % 3 == 0).alias("invalidated"), visibility.alias("visibility"), (k % 17 == 0).alias("denied"))
    return c.summary_context(d.select(F.col("doc_id").alias("position"), F.concat(F.lit("s"), F.col("doc_id") % 300).alias("summary_id")), s, 25)


@query(
    """WITH p AS (SELECT page_id, 'en' AS q, string_split(html, '<') AS segments FROM pages)
SELECT page_id AS projection_id, array_to_string(list_filter(range(0, len(segments)), lambda i: contains(lower(segments[i + 1]), 'the')), ',') AS segments,
CASE WHEN page_id % 7 = 0 THEN 'superseded' WHEN page_id % 5 = 0 OR page_id % 11 = 0 THEN 'source_replaced' WHEN page_id % 3 = 0 THEN 'missing_derived_text' ELSE 'current' END AS freshness FROM p WHERE len(list_filter(segments, lambda x: contains(lower(x), 'the'))) > 0"""
)
def artifact_search(spark, sf) -> DataFrame:
    k = F.col("page_id")
    pages = t.table(spark, sf, "pages").select("page_id", "html")
    projections = pages.select(k.alias("projection_id"), k.alias("artifact_id"), F.lit("h").alias("source_hash"), F.when(k % 7 == 0, "next").alias("superseded_by"), k.alias("derived_record_id"), F.split("html", "<").alias("segments"))
    artifacts = pages.where(k % 11 != 0).select(k.alias("artifact_id"), F.when(k % 5 == 0, "other").otherwise("h").alias("hash"))
    found = c.artifact_search(projections, artifacts, pages.where(k % 3 != 0).select(k.alias("id")), " The ")
    return found.select("projection_id", F.concat_ws(",", F.col("segments").cast("array<string>")).alias("segments"), "freshness")


@query()
def block_budget(spark, sf) -> DataFrame:
    """Tested against brute force; the running rules are long in SQL."""
    k = F.col("doc_id")
    b = t.table(spark, sf, "documents").select(
        F.concat(F.lit("o"), k % 40).alias("owner"),
        F.concat(F.lit("b"), k).alias("block_id"),
        F.element_at(F.array(*map(F.lit, c.BLOCK_CLASSES)), (F.floor(k / 40) % 3 + 1).cast("int")).alias("class"),
        F.timestamp_seconds(k % 100).alias("created_at"),
        F.when(k % 4 == 0, F.timestamp_seconds(k)).alias("stale_after"),
        (k % 90 + 10).alias("token_estimate"),
    )
    return c.block_budget(b, F.timestamp_seconds(F.lit(500)), 700, 20)


@query(
    f"""WITH {_RECORDS}, h AS (SELECT doc_id % 3 AS workspace, doc_id AS position, 'doc-' || (doc_id % 400) AS id, confidence AS score FROM r), f AS (SELECT id, min((workspace, position, score)) AS m FROM h GROUP BY id)
SELECT m[1] AS workspace, m[2] AS position, id, m[3] AS score FROM f ORDER BY 1, 2, 3 LIMIT 120"""
)
def federated_hits(spark, sf) -> DataFrame:
    r = t.records(spark, sf)
    return c.federated(r.select((F.col("doc_id") % 3).alias("workspace"), F.col("doc_id").alias("position"), F.concat(F.lit("doc-"), F.col("doc_id") % 400).alias("id"), F.col("confidence").alias("score")), 120)


@query()
def trust_attribution(spark, sf) -> DataFrame:
    """A fold over each memory's updates; tested against a plain loop."""
    e = t.table(spark, sf, "events")
    k = F.col("event_id")
    outcome = F.element_at(F.array(*map(F.lit, ("positive", "positive", "negative", "evidence_stale", "operator_pin", "positive", "operator_unpin", "re_review"))), (k % 8 + 1).cast("int"))
    return c.trust(e.select(F.concat(F.lit("m"), F.col("user_id")).alias("memory_id"), k.alias("position"), F.when(k % 997 == 0, "suppress").otherwise(outcome).alias("outcome"), ((k % 5 + 1) / 20).alias("weight")))


@query("SELECT 'label' AS kind, 'fact' AS name, '' AS types UNION ALL SELECT DISTINCT 'relation', o_orderpriority, '' FROM orders UNION ALL SELECT 'property', 'lang', 'str' UNION ALL SELECT 'property', 'n', 'int,str'")
def schema_description(spark, sf) -> DataFrame:
    r = t.records(spark, sf).withColumn("properties", F.create_map(F.lit("lang"), F.col("lang"), F.lit("n"), F.when(F.col("doc_id") % 2 == 0, "many").otherwise(F.col("n_chars").cast("string"))))
    relations = t.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("relation_type"))
    return c.described(r, relations).withColumn("types", F.concat_ws(",", "types"))


_LEFT = "SELECT DISTINCT CAST(c_nationkey AS VARCHAR(9)) AS tenant_id, CASE WHEN c_acctbal > 5000 THEN substr(c_mktsegment, 1, 4) END AS user_id, CAST(NULL AS VARCHAR(9)) AS project_id FROM customer"
_RIGHT = "SELECT DISTINCT CASE WHEN s_acctbal > 2000 THEN CAST(s_nationkey AS VARCHAR(9)) END AS tenant_id, CASE WHEN s_acctbal > 6000 THEN 'BUIL' WHEN s_acctbal > 3000 THEN 'AUTO' END AS user_id, CASE WHEN s_acctbal < 5000 THEN concat('p', s_nationkey) END AS project_id FROM supplier"


@query(
    f"""SELECT DISTINCT coalesce(a.tenant_id, b.tenant_id) AS tenant_id, coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.project_id, b.project_id) AS project_id FROM ({_LEFT}) a JOIN ({_RIGHT}) b
ON (a.tenant_id IS NULL OR b.tenant_id IS NULL OR a.tenant_id = b.tenant_id) AND (a.user_id IS NULL OR b.user_id IS NULL OR a.user_id = b.user_id) AND (a.project_id IS NULL OR b.project_id IS NULL OR a.project_id = b.project_id)"""
)
def namespace_intersect(spark, sf) -> DataFrame:
    return c.namespaces_intersected(made(spark, sf, _LEFT), made(spark, sf, _RIGHT), ("tenant_id", "user_id", "project_id"))


@query(f"WITH {_RECORDS}, k AS (SELECT id FROM r WHERE lang = 'en' ORDER BY id LIMIT 200), e AS (SELECT 'doc-' || doc_id AS src, 'doc-' || (doc_id * 2 % 1000) AS dst FROM documents) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def snapshot_export(spark, sf) -> DataFrame:
    r = t.records(spark, sf)
    e = r.select(F.col("id").alias("src"), F.concat(F.lit("doc-"), F.col("doc_id") * 2 % 1000).alias("dst"))
    return bundles.snapshot(r, e, F.col("lang") == "en", 200)[1]


@query("SELECT 'doc-' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'skip' ELSE 'create' END AS action FROM documents")
def import_plan(spark, sf) -> DataFrame:
    r = t.records(spark, sf)
    return bundles.import_plan(r, r.where("doc_id % 3 = 0"), "skip")


@query("SELECT * FROM (VALUES ('nation', 'ok'), ('region', 'ok'), ('supplier', 'changed')) AS x(name, status)")
def backup_verify(spark, sf) -> DataFrame:
    tables = {n: t.table(spark, sf, n) for n in ("nation", "region", "supplier")}
    now = {**tables, "supplier": tables["supplier"].withColumn("s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") == 1, 1).otherwise(0))}
    return bundles.verified(bundles.manifest(tables), bundles.manifest({k: v.repartition(3) for k, v in now.items()}))


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'tampered' ELSE 'unverified' END AS integrity, count(*) AS n FROM customer GROUP BY ALL")
def integrity_check(spark, sf) -> DataFrame:
    d = t.table(spark, sf, "customer")
    k = F.col("c_custkey") % 3
    hashed = d.withColumn("integrity_hash", F.when(k == 0, bundles.row_hash(d)).when(k == 1, F.lit("0" * 64)))
    return bundles.integrity(hashed).groupBy("integrity").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def sealed_round_trip(spark, sf) -> DataFrame:
    d = t.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return bundles.opened(bundles.sealed(d, b"0123456789abcdef", ["c_name", "c_acctbal"]), b"0123456789abcdef", "c_name string, c_acctbal double")

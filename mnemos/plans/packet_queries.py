"""Queries over context packages, communities, federations, audits and the gateway, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from mnemos.operators import audit, packages
from mnemos.operators.gateway import Gateway
from mnemos.plans.record_queries import _RECORDS
from mnemos.plans.typed_queries import made
from mnemos.sources import tables as t

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# Packages


@query(
    f"""WITH {_RECORDS}, found AS (SELECT id, doc_id, row_number() OVER (ORDER BY updated_at DESC, id) AS p FROM r WHERE lang = 'en' ORDER BY updated_at DESC, id LIMIT 50),
h AS (SELECT id, 'record' AS kind, greatest(1 - (p - 1) / 50.0, CASE WHEN doc_id % 4 = 0 THEN 0.9 ELSE 0 END) AS score, 0 AS late, p FROM found UNION ALL SELECT 'f' || doc_id, 'fact', 0.8, 1, p FROM found WHERE doc_id % 2 = 0),
f AS (SELECT 'fact-' || o_orderkey AS id, row_number() OVER (ORDER BY strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d'), 'fact-' || o_orderkey) AS p FROM orders WHERE o_custkey = 7 AND o_orderkey % 11 > 0),
g AS (SELECT 's' || r_regionkey AS id, 'summary' AS kind, r_regionkey + 1 AS p FROM region UNION ALL SELECT source, 'community', 5 + row_number() OVER (ORDER BY source) FROM (SELECT DISTINCT source FROM documents) ORDER BY p LIMIT 8),
all_ AS (SELECT 'structural_search' AS mode, id, 'record' AS kind, p, 30 AS most FROM found UNION ALL SELECT 'temporal_fact', id, 'fact', p, 5 FROM f UNION ALL SELECT 'hybrid', id, kind, row_number() OVER (ORDER BY score DESC, late, p, id), 40 FROM h UNION ALL SELECT 'global', id, kind, p, 8 FROM g)
SELECT mode, id, kind, CASE WHEN p <= most THEN p END AS position FROM all_ UNION ALL SELECT 'global', source, 'community', NULL FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN (SELECT id FROM g)"""
)
def context_packages(spark, sf) -> DataFrame:
    """Four modes in one call each: the items with their places, and those that the budget leaves out without one."""
    records = t.records(spark, sf)
    k = F.col("doc_id")
    scores = records.where(k % 4 == 0).select("id", F.lit(0.9).alias("value"))
    facts = records.where(k % 2 == 0).select(F.concat(F.lit("f"), k).alias("fact_id"), F.col("id").alias("record_id"), F.lit(0.8).alias("confidence"))
    english = {"conditions": {"tags": ["en"]}, "limit": 50}
    sources = t.table(spark, sf, "documents").select("source").distinct()
    from pyspark.sql import Window

    communities = sources.select(F.col("source").alias("id"), F.lit("community").alias("kind"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("snippet"), F.row_number().over(Window.orderBy("source")).alias("position"))  # of the sources
    regions = made(spark, sf, "SELECT 's' || r_regionkey AS summary_id, r_name AS text FROM region")
    made_ = {
        "structural_search": packages.assemble_context("structural_search", {"records": records}, english, 30),
        "temporal_fact": packages.assemble_context("temporal_fact", {"facts": t.facts(spark, sf)}, {"conditions": {"subject": "cust-7"}}, 5),
        "hybrid": packages.assemble_context("hybrid", {"records": records, "vector_scores": scores, "facts_of_records": facts}, english, 40),
        "global": packages.assemble_context("global", {"summaries": regions}, {"summaries": [f"s{i}" for i in range(5)]}, 8, communities=communities),
    }
    out = None
    for mode, p in made_.items():
        part = p.items.select(F.lit(mode).alias("mode"), "id", "kind", "position").unionByName(p.omitted.select(F.lit(mode).alias("mode"), "id", "kind", F.lit(None).cast("long").alias("position")))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_RECORDS}, shown AS (SELECT * FROM r WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars % 7 > 0)), hit AS (SELECT * FROM shown WHERE contains(lower(title || chr(10) || content), 'license')), c AS (SELECT project_id AS label, count(*) AS size FROM r GROUP BY project_id),
m AS (SELECT c.*, (SELECT count(*) FROM hit WHERE project_id = label) AS hits FROM c), found AS (SELECT label, size, hits, row_number() OVER (ORDER BY size DESC, label) AS n FROM m WHERE size >= 40 AND hits > 0)
SELECT label AS what, size AS n, hits FROM found WHERE n <= 6 UNION ALL SELECT 'limit', count(*) - 6, NULL FROM found HAVING count(*) > 6 UNION ALL SELECT 'below_minimum_size', count(*), NULL FROM m WHERE size < 40 HAVING count(*) > 0
UNION ALL SELECT 'no_match', count(*), NULL FROM m WHERE size >= 40 AND hits = 0 HAVING count(*) > 0 UNION ALL SELECT 'hidden_record', count(*), NULL FROM documents WHERE n_chars % 7 = 0 HAVING count(*) > 0"""
)
def community_query(spark, sf) -> DataFrame:
    """Sources as communities: those of at least forty documents with the word in one that may be told."""
    records = t.records(spark, sf).withColumn("source", F.col("project_id"))
    labels = records.select(F.col("id").alias("node_id"), F.col("source").alias("label"))
    communities = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("node_id").alias("seed"))
    kept, omitted = packages.community_packet(labels, communities, records, None, "License", 6, 40, records.where("n_chars % 7 = 0").select("id"))
    return kept.select(F.col("label").alias("what"), F.col("size").alias("n"), "hits").unionByName(omitted.select(F.col("reason").alias("what"), F.col("count").alias("n"), F.lit(None).cast("long").alias("hits")))


_SUMMARIES = "SELECT concat('su-', c_custkey) AS summary_id, concat('en-', c_custkey % 40) AS entity_id, c_name AS text, c_custkey AS touched_at, c_acctbal < 0 AS invalidated, CASE c_mktsegment WHEN 'BUILDING' THEN 'hidden' WHEN 'MACHINERY' THEN 'audit_only' ELSE 'visible' END AS visibility, c_nationkey = 3 AS denied, c_nationkey % 4 = 1 AS redacted FROM customer WHERE c_custkey % 40 < 22 OR c_mktsegment = 'BUILDING'"
_ENTITIES = "SELECT concat('en-', n_nationkey * 2) AS entity_id, n_nationkey AS position FROM nation"


@query(
    f"""WITH s AS ({_SUMMARIES}), q AS (SELECT * FROM ({_ENTITIES})), j AS (SELECT *, CASE WHEN invalidated THEN 'invalidated' WHEN visibility <> 'visible' THEN visibility WHEN denied THEN 'denied' END AS reason FROM s JOIN q USING (entity_id)),
good AS (SELECT entity_id, position, arg_max(summary_id, touched_at) AS summary_id, arg_max(CASE WHEN redacted THEN '-' ELSE text END, touched_at) AS text FROM j WHERE reason IS NULL GROUP BY ALL), placed AS (SELECT *, row_number() OVER (ORDER BY position, entity_id) AS n FROM good),
bad AS (SELECT entity_id, arg_max(reason, touched_at) AS reason FROM j WHERE entity_id NOT IN (SELECT entity_id FROM good) GROUP BY entity_id)
SELECT entity_id, summary_id, CASE WHEN text <> '-' THEN text END AS text, NULL AS reason FROM placed WHERE n <= 9 UNION ALL SELECT entity_id, NULL, NULL, 'budget_exceeded' FROM placed WHERE n > 9 UNION ALL SELECT entity_id, NULL, NULL, reason FROM bad
UNION ALL SELECT entity_id, NULL, NULL, 'not_found' FROM q WHERE entity_id NOT IN (SELECT entity_id FROM s)"""
)
def entity_summaries_context(spark, sf) -> DataFrame:
    good, bad = packages.entity_context(made(spark, sf, _ENTITIES), made(spark, sf, _SUMMARIES), 9)
    return good.drop("redacted").unionByName(bad, allowMissingColumns=True)


@query(
    f"""WITH {_RECORDS}, h AS (SELECT doc_id % 3 AS workspace, doc_id AS position, 'doc-' || (n_chars % 300) AS id FROM documents WHERE doc_id % 3 < 2), f AS (SELECT id, min((workspace, position)) AS m FROM h GROUP BY id), o AS (SELECT id, m[1] AS workspace, m[2] AS position, row_number() OVER (ORDER BY m[1], m[2], id) AS n FROM f)
SELECT workspace, 'in' AS reason, count(*) AS n FROM o WHERE n <= 150 GROUP BY ALL UNION ALL SELECT workspace, 'limit', count(*) FROM o WHERE n > 150 GROUP BY ALL UNION ALL SELECT workspace, 'duplicate', count(*) FROM h WHERE (workspace, position, id) NOT IN (SELECT (workspace, position, id) FROM o) GROUP BY ALL
UNION ALL SELECT 2, 'unavailable', 0 UNION ALL SELECT 3, 'empty', 0"""
)
def federated_omissions(spark, sf) -> DataFrame:
    r = t.records(spark, sf)
    hits = r.select((F.col("doc_id") % 3).alias("workspace"), F.col("doc_id").alias("position"), F.concat(F.lit("doc-"), F.col("n_chars") % 300).alias("id"), F.col("confidence").alias("score"))
    asked = spark.createDataFrame([(0, True), (1, True), (2, False), (3, True)], "workspace long, available boolean")
    kept, omitted = packages.federated_packet(hits, asked, 150)
    return kept.groupBy("workspace").agg(F.lit("in").alias("reason"), F.count("*").alias("n")).unionByName(omitted.withColumnRenamed("count", "n"))


# Audit

_LIFECYCLES = "SELECT concat('project_id=u', user_id) AS namespace, concat('rec-', event_id) AS record_id, CASE event_type WHEN 'view' THEN 'archived' WHEN 'click' THEN 'promotion_applied' WHEN 'signup' THEN 'deleted' WHEN 'purchase' THEN 'no_transition' ELSE 'exploded' END AS action, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'p1' END AS policy_id, event_type AS from_phase, 'cooling' AS to_phase, CASE WHEN event_id % 4 = 0 THEN concat('job-', user_id) END AS job_id FROM events"


@query(
    f"""WITH l AS ({_LIFECYCLES}) SELECT record_id, CASE WHEN policy_id <> '' AND action <> 'exploded' THEN 'memory.lifecycle_action' END AS event_type, CASE WHEN policy_id = '' THEN 'policy_id is required' WHEN action = 'exploded' THEN 'unknown action: exploded' END AS refusal,
CASE WHEN policy_id <> '' AND action <> 'exploded' THEN '{{"action":"' || action || '","from_phase":"' || from_phase || CASE WHEN job_id IS NULL THEN '' ELSE '","job_id":"' || job_id END || '","namespace":"' || namespace || '","policy_id":"p1","to_phase":"cooling"}}' END AS details FROM l"""
)
def audit_lifecycle(spark, sf) -> DataFrame:
    good, bad = audit.events(made(spark, sf, _LIFECYCLES), "lifecycle_action", F.lit("2024-01-01").cast("timestamp"))
    return good.select(F.col("target_id").alias("record_id"), "event_type", "details", F.lit(None).cast("string").alias("refusal")).unionByName(bad.select("record_id", "refusal"), allowMissingColumns=True)


@query(
    """SELECT 'memory.webhook_delivery_attempt' AS event_type, NULL AS refusal, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 > 0 UNION ALL SELECT NULL, 'unknown status: P', count(*) FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
UNION ALL SELECT NULL, 'attempt must be at least 1', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 = 0 UNION ALL SELECT 'memory.write_accepted', NULL, count(*) FROM part UNION ALL SELECT 'memory.retrieval', NULL, count(*) FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT NULL, 'selected_ids must be texts that aren''t empty', count(*) FROM supplier WHERE s_acctbal <= 0 HAVING count(*) > 0"""
)
def audit_kinds(spark, sf) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp")
    webhooks = made(spark, sf, "SELECT concat('w', o_custkey) AS webhook_id, concat('d', o_orderkey) AS delivery_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE o_orderstatus END AS status, o_orderkey % 5 AS attempt, 'example.org' AS target_url_host FROM orders")
    writes = made(spark, sf, "SELECT 'tenant_id=t' AS namespace, p_type AS payload_kind, p_brand AS source_owner, 'record' AS target_kind, concat('p', p_partkey) AS target_id FROM part")
    retrievals = made(spark, sf, "SELECT 'tenant_id=t' AS namespace, s_name AS source_owner, s_suppkey AS omitted_count, 'hybrid' AS retrieval_mode, s_acctbal FROM supplier").withColumn("selected_ids", F.array(F.lit("a"), F.when(F.col("s_acctbal") > 0, "b").otherwise("")))
    out = None
    for rows, kind in ((webhooks, "webhook_delivery_attempt"), (writes, "write_accepted"), (retrievals, "retrieval")):
        good, bad = audit.events(rows, kind, at)
        part = good.select("event_type", F.lit(None).cast("string").alias("refusal")).unionByName(bad.select("refusal"), allowMissingColumns=True)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("event_type", "refusal").agg(F.count("*").alias("n"))


# The gateway


def _gateway() -> Gateway:
    """May see the projects src1 to src4, and 40 rows."""
    spaces = [Row(project_id=f"src{i}") for i in range(1, 5)]
    return Gateway(Row(allowed=True, reason="allowed", namespaces=spaces, workspace_ids=[0, 1], record_types=["fact"], max_results=40, max_context_tokens=None), ("project_id",))


_SEEN = f"{_RECORDS}, seen AS (SELECT * FROM r WHERE project_id IN ('src1', 'src2', 'src3', 'src4'))"


@query(f"WITH {_SEEN} SELECT id, project_id FROM seen WHERE contains(lower(concat_ws(chr(10), title, content, lang)), 'ion') ORDER BY updated_at DESC, id LIMIT 35 OFFSET 5")
def gateway_search(spark, sf) -> DataFrame:
    return _gateway().search(t.records(spark, sf), "ION", 100, 5).select("id", "project_id")


@query(f"WITH {_SEEN}, root AS (SELECT arg_min(id, doc_id) AS id FROM seen), e AS (SELECT doc_id, 'doc-' || doc_id AS src, 'doc-' || (doc_id % 30) AS dst FROM documents) SELECT 'l-' || doc_id AS link_id FROM e, root WHERE (src = root.id OR dst = root.id) AND src IN (SELECT id FROM seen) AND dst IN (SELECT id FROM seen) ORDER BY 1 LIMIT 40")
def gateway_links(spark, sf) -> DataFrame:
    records = t.records(spark, sf)
    links = records.select(F.concat(F.lit("l-"), "doc_id").alias("link_id"), F.col("id").alias("source_record_id"), F.concat(F.lit("doc-"), F.col("doc_id") % 30).alias("target_record_id"))
    root = _gateway().seen(records).agg(F.min_by("id", "doc_id")).first()[0]
    return _gateway().links(records, links, root).select("link_id")


@query(
    f"""WITH RECURSIVE {_SEEN}, root AS (SELECT arg_min(id, doc_id) AS id FROM seen), e AS (SELECT 'doc-' || doc_id AS src, 'doc-' || (doc_id % 30) AS dst FROM documents WHERE 'doc-' || doc_id IN (SELECT id FROM seen) AND 'doc-' || (doc_id % 30) IN (SELECT id FROM seen)), b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e),
reach(id, d) AS (SELECT id, 0 FROM root UNION SELECT v, d + 1 FROM reach JOIN b ON u = id WHERE d < 4) SELECT id AS node_id, min(d) AS depth FROM reach GROUP BY id ORDER BY 2, 1 LIMIT 40"""
)
def gateway_graph(spark, sf) -> DataFrame:
    records = t.records(spark, sf)
    edges = records.select(F.concat(F.lit("l-"), "doc_id").alias("edge_id"), F.col("id").alias("src"), F.concat(F.lit("doc-"), F.col("doc_id") % 30).alias("dst"))
    root = _gateway().seen(records).agg(F.min_by("id", "doc_id")).first()[0]
    return _gateway().graph(records, edges, root, 4)[0]

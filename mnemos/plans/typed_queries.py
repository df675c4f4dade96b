"""Queries over typed lists, writes and vaults, with the SQL that gives the same rows.

The tables that these operators work on are made from the driver's tables by SQL that Spark and DuckDB both read (`made`).
What the operators do with them is written out independently in each query's SQL.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.functions import markdown
from mnemos.functions.columns import iso_time, shortened
from mnemos.operators import lists, vault, writes
from mnemos.plans.graph_queries import _EDGES
from mnemos.sources import tables as t

QUERIES, ORACLES = {}, {}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def made(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """The rows of a SELECT over the driver's tables."""
    used = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)) & set(_TABLES)
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql), **{n: t.table(spark, sf, n) for n in used})


# Typed lists

_TRANSITIONS = "SELECT 'tr-' || event_id AS transition_id, 'rec-' || (user_id % 50) AS record_id, 'project:' || event_type AS scope, ts AS transition_at FROM events"
_BLOCKS = "SELECT 'b' || conv_id || '-' || turn AS block_id, 'd' || conv_id AS document_id, 'rec-' || (conv_id % 40) AS record_id, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn END AS line_start FROM conversations"
_MEMORY = "SELECT 'mb-' || p_partkey AS block_id, CASE p_partkey % 3 WHEN 0 THEN 'agent_identity' WHEN 1 THEN 'active_mission' ELSE 'session_pin' END AS class_name, CASE p_partkey % 4 WHEN 0 THEN 'read_only' WHEN 1 THEN 'shared' WHEN 2 THEN 'odd' ELSE 'pinned' END AS mode, p_size AS created_at, CASE WHEN p_size % 5 = 0 THEN '2024-01-0' || (p_size % 9 + 1) END AS stale_after, p_name AS content, 'nobody' AS last_updated_by, 'never' AS last_updated_at FROM part"
_CANDIDATES = "SELECT 'ca-' || o_orderkey AS candidate_id, 'se-' || (o_custkey % 20) AS session_id, 'project:p' || (o_custkey % 3) AS scope, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, 'fact' AS type, 'k' || o_custkey AS key, 'Order ' || o_orderkey AS title, o_orderpriority AS content, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS updated_at, (o_orderkey % 10) / 10.0 AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'e1,e2' ELSE 'e1' END AS refs FROM orders"
_ENTITIES = "SELECT 'en-' || c_custkey AS entity_id, c_name AS canonical_name, c_mktsegment AS entity_type, CASE WHEN c_custkey % 5 = 0 THEN 'x' END AS invalidated_at, CASE WHEN c_custkey % 7 = 0 THEN 'en-1' END AS superseded_by_entity_id, 'ns' || c_nationkey AS namespace_key FROM customer"
_SUMMARIES = "SELECT 'su-' || c_custkey AS summary_id, 'en-' || (c_custkey % 30) AS entity_id, c_custkey % 90 AS created_at, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 70 + 10 END AS updated_at, CASE WHEN c_custkey % 6 = 0 THEN 'x' END AS invalidated_at FROM customer"
_EPISODES = "SELECT 'ep-' || conv_id AS episode_id, CASE conv_id % 3 WHEN 0 THEN 'done' ELSE 'open' END AS status, 'task-' || (conv_id % 8) AS task_id, 't' || (conv_id % 5) AS tool, conv_id % 60 AS started_at FROM conversations WHERE turn = 0"
_OUTCOMES = "SELECT 'ou-' || conv_id || '-' || turn AS outcome_id, 'ep-' || conv_id AS episode_id, CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, turn AS occurred_at FROM conversations"


@query(f"WITH x AS ({_TRANSITIONS}) SELECT transition_id, record_id FROM x WHERE scope IN ('project:view', 'project:click') AND record_id = 'rec-7' ORDER BY transition_at DESC, transition_id LIMIT 40")
def list_tier_transitions(spark, sf) -> DataFrame:
    return lists.listing(made(spark, sf, _TRANSITIONS), "tier_transition", limit=40, scope=["project:view", "project:click"], record_id="rec-7").select("transition_id", "record_id")


@query(f"WITH x AS ({_BLOCKS}) SELECT block_id, line_start FROM x WHERE record_id = 'rec-3' ORDER BY coalesce(line_start, 0), block_id LIMIT 25")
def list_document_blocks(spark, sf) -> DataFrame:
    return lists.listing(made(spark, sf, _BLOCKS), "document_block", limit=25, record_id="rec-3").select("block_id", "line_start")


@query(f"WITH x AS ({_MEMORY}) SELECT block_id, class_name FROM x WHERE class_name <> 'session_pin' AND (stale_after IS NULL OR stale_after > '2024-01-05') ORDER BY class_name, created_at, block_id LIMIT 60")
def list_memory_blocks(spark, sf) -> DataFrame:
    fresh = lists.fresh_blocks(made(spark, sf, _MEMORY), "2024-01-05")
    return lists.listing(fresh, "memory_block", limit=60, class_name=["agent_identity", "active_mission"]).select("block_id", "class_name")


@query(f"WITH x AS ({_CANDIDATES}) SELECT candidate_id FROM x WHERE status IN ('pending', 'approved') AND session_id = 'se-4' ORDER BY coalesce(updated_at, created_at) DESC, candidate_id LIMIT 30")
def list_candidates(spark, sf) -> DataFrame:
    return lists.listing(made(spark, sf, _CANDIDATES), "candidate", limit=30, status=["pending", "approved"], session_id="se-4").select("candidate_id")


@query(f"WITH x AS ({_ENTITIES}) SELECT entity_id, canonical_name FROM x WHERE entity_type = 'BUILDING' AND invalidated_at IS NULL AND superseded_by_entity_id IS NULL ORDER BY canonical_name, entity_id")
def list_entities(spark, sf) -> DataFrame:
    return lists.listing(made(spark, sf, _ENTITIES), "entity", entity_type="BUILDING").select("entity_id", "canonical_name")


@query(f"WITH x AS ({_SUMMARIES}) SELECT summary_id, coalesce(updated_at, created_at) AS touched FROM x WHERE invalidated_at IS NULL AND entity_id = 'en-4' ORDER BY touched DESC, summary_id LIMIT 12")
def list_entity_summaries(spark, sf) -> DataFrame:
    return lists.listing(made(spark, sf, _SUMMARIES), "entity_summary", limit=12, entity_id="en-4").select("summary_id", F.coalesce("updated_at", "created_at").alias("touched"))


@query(f"WITH x AS ({_EPISODES}) SELECT episode_id, started_at FROM x WHERE status = 'open' AND tool = 't2' AND started_at >= 5 AND started_at <= 50 ORDER BY started_at DESC, episode_id DESC LIMIT 20")
def list_episodes(spark, sf) -> DataFrame:
    rows = made(spark, sf, _EPISODES).withColumns({"tool_ids": F.array("tool"), "artifact_ids": F.array().cast("array<string>")})
    return lists.listing(rows, "episode", limit=20, status="open", tool_id="t2", after=5, before=50).select("episode_id", "started_at")


@query(f"WITH x AS ({_OUTCOMES}) SELECT outcome_id FROM x WHERE status = 'failed' ORDER BY occurred_at DESC, outcome_id DESC LIMIT 35")
def list_outcomes(spark, sf) -> DataFrame:
    return lists.listing(made(spark, sf, _OUTCOMES), "outcome", limit=35, status="failed").select("outcome_id")


@query("SELECT 'as-' || p_partkey AS artifact_id, p_type AS kind FROM part WHERE p_size = 7 ORDER BY artifact_id LIMIT 10")
def list_artifacts(spark, sf) -> DataFrame:
    rows = made(spark, sf, "SELECT 'as-' || p_partkey AS artifact_id, p_type AS kind, p_size FROM part")
    return lists.listing(rows.where("p_size = 7"), "artifact", limit=10).select("artifact_id", "kind")


@query("SELECT 'cf-' || s_suppkey AS conflict_id, CASE WHEN s_suppkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status FROM supplier WHERE s_suppkey % 2 = 0 ORDER BY conflict_id LIMIT 9")
def list_sync_conflicts(spark, sf) -> DataFrame:
    rows = made(spark, sf, "SELECT 'cf-' || s_suppkey AS conflict_id, CASE WHEN s_suppkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status, s_name AS path FROM supplier")
    return lists.listing(rows, "sync_conflict", limit=9, status="open").select("conflict_id", "status")


@query("SELECT 'space' || (vec_id % 9) AS vector_space, min('ns' || (vec_id % 2)) AS namespace_key FROM embeddings GROUP BY ALL ORDER BY namespace_key, vector_space LIMIT 7")
def list_active_model_sets(spark, sf) -> DataFrame:
    rows = made(spark, sf, "SELECT 'space' || (vec_id % 9) AS vector_space, min('ns' || (vec_id % 2)) AS namespace_key FROM embeddings GROUP BY 'space' || (vec_id % 9)")
    return lists.listing(rows, "active_model_set", limit=7)


_VECTORS = "SELECT 'x' || (vec_id % 200) AS external_vector_id, 'ns' || (vec_id % 2) AS namespace_key, vec_id AS updated_at FROM embeddings"


@query(f"WITH x AS ({_VECTORS}) SELECT external_vector_id, max(updated_at) AS last_seen_at FROM x WHERE (external_vector_id, namespace_key) NOT IN (SELECT (external_vector_id, namespace_key) FROM x WHERE updated_at % 3 = 0) GROUP BY external_vector_id, namespace_key HAVING max(updated_at) >= 100")
def list_orphan_vector_ids(spark, sf) -> DataFrame:
    rows = made(spark, sf, _VECTORS)
    return lists.orphan_vector_ids(rows, rows.where("updated_at % 3 = 0"), 100).select("external_vector_id", "last_seen_at")


# Writes

_UPSERT = "SELECT 'doc-' || doc_id AS id, 'project:' || source AS scope, 'fact' AS type, 'k' || (doc_id % 120) AS key, CAST('T' || doc_id AS VARCHAR(20)) AS title, 'working' AS tier, TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 50) * INTERVAL 1 MINUTE AS updated_at, TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS event_time FROM documents WHERE lang = 'en'"


@query(
    f"""WITH x AS ({_UPSERT}), p AS (SELECT DISTINCT scope, key FROM x WHERE length(key) = 3 UNION ALL SELECT 'project:new', 'k1'),
m AS (SELECT id FROM (SELECT x.id, row_number() OVER (PARTITION BY scope, key ORDER BY updated_at DESC, id) AS n FROM x JOIN p USING (scope, key)) WHERE n = 1)
SELECT scope, key, CASE WHEN id IN (SELECT id FROM m) THEN 'patched' ELSE title END AS title, CASE WHEN id IN (SELECT id FROM m) THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM x
UNION ALL SELECT 'project:new', 'k1', 'patched', TIMESTAMP '2025-01-01'"""
)
def upserted_records(spark, sf) -> DataFrame:
    rows = made(spark, sf, _UPSERT)
    patches = rows.where(F.length("key") == 3).select("scope", "type", "key").distinct().unionByName(spark.createDataFrame([("project:new", "fact", "k1")], "scope string, type string, key string"))
    return writes.upserted(rows, patches.withColumn("title", F.lit("patched")), F.lit("2025-01-01").cast("timestamp")).select("scope", "key", "title", "updated_at")


@query(f"WITH {_EDGES} SELECT 'new' AS kind, count(*) AS n FROM (SELECT DISTINCT src FROM e WHERE src LIKE 's%') UNION ALL SELECT 'old', count(*) FROM e WHERE src NOT LIKE 's%'")
def replaced_links(spark, sf) -> DataFrame:
    e = t.edges(spark, sf).select("edge_id", "src", "dst")
    new = e.where("src like 's%'").groupBy("src").agg(F.lit("n0").alias("dst")).select(F.concat(F.lit("new-"), "src").alias("edge_id"), "src", "dst")
    out = writes.replaced(e, new, "src")
    return out.groupBy(F.when(F.col("edge_id").startswith("new-"), "new").otherwise("old").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH x AS ({_CANDIDATES}) SELECT candidate_id, CASE WHEN CAST(substr(candidate_id, 4) AS INT) % 6 = 0 THEN 'approved' WHEN CAST(substr(candidate_id, 4) AS INT) % 6 = 3 THEN 'rejected' ELSE status END AS status, CASE WHEN CAST(substr(candidate_id, 4) AS INT) % 3 = 0 THEN 'r2' END AS reviewer FROM x")
def reviewed_candidates(spark, sf) -> DataFrame:
    rows = made(spark, sf, _CANDIDATES)
    k = F.substring("candidate_id", 4, 20).cast("long")
    last = F.when(k % 6 == 0, "approve").otherwise("reject")
    at = F.lit("2025-01-01").cast("timestamp")
    one = rows.where(k % 3 == 0).select("candidate_id", last.alias("action"), F.lit("r2").alias("reviewer"), F.lit(at).alias("decided_at"), F.lit("n").alias("note"))
    before = one.select("candidate_id", F.when(F.col("action") == "approve", "reject").otherwise("approve").alias("action"), F.lit("r1").alias("reviewer"), (at - F.expr("interval 1 day")).alias("decided_at"), "note")
    return writes.reviewed(rows, one.unionByName(before)).select("candidate_id", "status", "reviewer")


@query(f"WITH x AS ({_CANDIDATES}), y AS (SELECT *, CAST(substr(candidate_id, 4) AS INT) AS k FROM x) SELECT candidate_id, CASE WHEN status <> 'approved' THEN 'not_approved' WHEN k % 5 = 0 AND k % 2 = 1 THEN 'evidence_not_of_candidate' END AS refusal, CASE WHEN status = 'approved' AND NOT (k % 5 = 0 AND k % 2 = 1) THEN 'promoted' ELSE status END AS status FROM y UNION ALL SELECT 'ca-none', 'unknown_candidate', NULL")
def promoted_candidates(spark, sf) -> DataFrame:
    rows = made(spark, sf, _CANDIDATES).withColumn("evidence_refs", F.split("refs", ","))
    k = F.substring("candidate_id", 4, 20).cast("long")
    wanted = rows.select("candidate_id", F.lit("project:done").alias("target_scope"), F.when(k % 5 == 0, F.array(F.lit("e2"))).alias("evidence_refs"))
    wanted = wanted.unionByName(spark.createDataFrame([("ca-none", "s", None)], "candidate_id string, target_scope string, evidence_refs array<string>"))
    plan = writes.promotion_plan(rows, wanted)
    after = writes.promoted(rows, plan, F.lit("2025-01-01").cast("timestamp"))[1]
    return plan.join(after.select("candidate_id", "status"), "candidate_id", "left").select("candidate_id", "refusal", "status")


@query(f"WITH x AS ({_MEMORY}) SELECT block_id, CASE WHEN mode = 'shared' THEN 'mode_not_yet_supported' WHEN mode = 'odd' THEN 'mode_invalid' END AS refused, CASE WHEN mode = 'read_only' THEN 'read_only_block' WHEN mode = 'pinned' AND created_at % 2 = 0 THEN 'operator_action_required' END AS refusal, CASE WHEN mode = 'read_only' OR mode = 'pinned' AND created_at % 2 = 0 THEN content ELSE 'new' END AS content FROM x")
def edited_memory_blocks(spark, sf) -> DataFrame:
    rows = made(spark, sf, _MEMORY)
    edits = rows.select("block_id", F.lit("new").alias("new_content"), F.lit("me").alias("actor"), (F.col("created_at") % 2 == 1).alias("operator_action"), F.lit("2025").alias("at"))
    after, asked = writes.edited_blocks(rows, edits)
    return after.withColumn("refused", writes.block_refusal()).join(asked.select("block_id", "refusal"), "block_id").select("block_id", "refused", "refusal", "content")


@query("SELECT 'v' || vec_id AS record_id, CASE WHEN vec_id % 3 = 0 THEN 'refused' WHEN vec_id % 3 = 1 THEN 'replaced' ELSE 'kept' END AS what FROM embeddings UNION ALL SELECT 'v' || vec_id, 'kept' FROM embeddings WHERE vec_id % 3 = 0")
def put_embeddings(spark, sf) -> DataFrame:
    base = t.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("record_id"), F.lit("s").alias("vector_space"), F.lit(64).alias("dimension"), F.lit("kept").alias("what"), "vec_id")
    new = base.where("vec_id % 3 < 2").withColumns({"dimension": F.when(F.col("vec_id") % 3 == 0, 32).otherwise(64), "what": F.when(F.col("vec_id") % 3 == 0, "refused").otherwise("replaced")})
    after, refused = writes.put_embeddings(base, new)
    return after.unionByName(refused).select("record_id", "what")


@query("SELECT 'conflict' AS what, count(*) AS n FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'stands', count(*) FROM part")
def put_ontologies(spark, sf) -> DataFrame:
    base = made(spark, sf, "SELECT 'o' || (p_partkey % 50) AS ontology_id, 'v' || p_partkey AS version, p_name AS payload, p_partkey FROM part")
    table = base.where("p_partkey % 2 = 0")
    rows = base.withColumn("payload", F.when(F.col("p_partkey") % 4 == 0, "other").otherwise(F.col("payload")))
    after, conflicts = writes.put_ontologies(table, rows)
    return after.agg(F.lit("stands").alias("what"), F.count("*").alias("n")).unionByName(conflicts.agg(F.lit("conflict").alias("what"), F.count("*").alias("n")))


@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS cursor FROM orders")
def cursor_assignment(spark, sf) -> DataFrame:
    log = spark.createDataFrame([(1000,), (7,)], "cursor long")
    return writes.numbered_events(log, t.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "cursor")


# Vaults

_NOTES = """SELECT 'notes/' || CASE WHEN doc_id % 7 = 0 THEN 'sub/' ELSE '' END || 'n' || doc_id || '.md' AS path, doc_id, '---' || chr(10) || 'title: Note ' || doc_id || chr(10) || 'tags: [red, t' || (doc_id % 3) || ']' || chr(10) || '---' || chr(10) || '# Head & ' || doc_id || chr(10) || 'See [[Note ' || (doc_id % 50) || '#Part One|shown]] and ![[n' || (doc_id % 9) || ']] #tag' || (doc_id % 4) || ' (#x/y)' || chr(10) || '![pic](a.png) [site](https://x.org/a b) [other](sub/n1.md#^b1)' || chr(10) || 'A line ^id-' || doc_id AS content FROM documents WHERE doc_id % 2 = 0"""


def _files(spark, sf):
    return made(spark, sf, _NOTES).withColumns({"content_hash": F.sha2(F.col("content").cast("binary"), 256), "deleted": F.lit(False), "modified_at": F.lit("2024-01-01")})


@query(f"WITH x AS ({_NOTES}) SELECT path, 'Note ' || doc_id AS title, 'red,t' || (doc_id % 3) || ',tag' || (doc_id % 4) || ',x/y' AS tags FROM x")
def vault_notes(spark, sf) -> DataFrame:
    return vault.notes(_files(spark, sf)).select("path", "title", F.array_join("tags", ",").alias("tags"))


@query(
    f"""WITH x AS ({_NOTES}) SELECT doc_id, 'wikilink' AS link_kind, 'Note ' || (doc_id % 50) || '#Part One|shown' AS raw_target, 'part-one' AS heading, NULL AS block FROM x
UNION ALL SELECT doc_id, 'embed', 'n' || (doc_id % 9), NULL, NULL FROM x UNION ALL SELECT doc_id, 'external', 'https://x.org/a b', NULL, NULL FROM x UNION ALL SELECT doc_id, 'markdown', 'sub/n1.md#^b1', NULL, 'b1' FROM x"""
)
def vault_links(spark, sf) -> DataFrame:
    files = _files(spark, sf)
    ids = vault.notes(files).select("record_id", "path").join(files.select("path", "doc_id"), "path")
    return vault.note_links(vault.notes(files)).join(ids, F.col("source_record_id") == F.col("record_id")).select("doc_id", "link_kind", "raw_target", "heading", "block")


@query(f"WITH x AS ({_NOTES}) SELECT doc_id, 'heading' AS block_type, 1 AS line_start, 'head--' || doc_id AS anchor FROM x UNION ALL SELECT doc_id, 'block', 2, 'b1' FROM x WHERE FALSE UNION ALL SELECT doc_id, 'block', 3, 'b1' FROM x UNION ALL SELECT doc_id, 'block', 4, 'id-' || doc_id FROM x")
def vault_blocks(spark, sf) -> DataFrame:
    files = _files(spark, sf)
    n = vault.notes(files)
    return vault.note_blocks(n).join(n.select("record_id", "path"), "record_id").join(files.select("path", "doc_id"), "path").select("doc_id", "block_type", "line_start", F.regexp_replace("anchor", "head-+", "head--").alias("anchor"))


@query(
    f"""WITH x AS ({_NOTES}) SELECT path, CASE WHEN doc_id % 10 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'unchanged' END WHEN doc_id % 3 = 0 AND doc_id % 8 = 0 THEN 'update' WHEN doc_id % 3 = 0 THEN 'unchanged' ELSE 'create' END AS action FROM x
UNION ALL SELECT 'old/' || doc_id, 'stale' FROM documents WHERE doc_id % 25 = 1"""
)
def vault_import_plan(spark, sf) -> DataFrame:
    files = _files(spark, sf).withColumn("deleted", F.col("doc_id") % 10 == 0)
    had = files.where("doc_id % 3 = 0").select("path", F.concat(F.lit("r"), "doc_id").alias("record_id"), F.when(F.col("doc_id") % 8 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(False).alias("is_deleted"))
    old = made(spark, sf, "SELECT 'old/' || doc_id AS path, 'r' || doc_id AS record_id, 'h' AS content_hash, false AS is_deleted FROM documents WHERE doc_id % 25 = 1")
    return vault.import_plan(files, had.unionByName(old), True).select("path", "action")


@query(f"WITH x AS ({_NOTES}) SELECT 0 AS stale, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 8 = 0) AS updated, count(*) FILTER (doc_id % 3 <> 0) AS created, 0 AS deleted, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 8 <> 0) AS unchanged FROM x")
def vault_counts(spark, sf) -> DataFrame:
    files = _files(spark, sf)
    had = files.where("doc_id % 3 = 0").select("path", F.concat(F.lit("r"), "doc_id").alias("record_id"), F.when(F.col("doc_id") % 8 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(False).alias("is_deleted"))
    return vault.plan_counts(vault.import_plan(files, had))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'a/b.MD' WHEN 1 THEN 'x.canvas' ELSE 'p.png' END AS path, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'canvas' ELSE 'asset' END AS file_kind, count(*) AS n FROM documents GROUP BY ALL")
def vault_manifest(spark, sf) -> DataFrame:
    files = made(spark, sf, "SELECT CASE doc_id % 3 WHEN 0 THEN 'a/b.MD' WHEN 1 THEN 'x.canvas' ELSE 'p.png' END AS path, 'h' AS content_hash, false AS deleted FROM documents")
    return vault.manifest(files, files.limit(0).select("path", F.lit("r").alias("record_id"))).groupBy("path", "file_kind").agg(F.count("*").alias("n"))


@query("SELECT 'f' || (doc_id % 9) AS path, min(doc_id) AS doc_id, count(*) - 1 AS skipped FROM documents GROUP BY ALL")
def vault_first_files(spark, sf) -> DataFrame:
    files = made(spark, sf, "SELECT 'f' || (doc_id % 9) AS path, doc_id FROM documents")
    first, twice = vault.first_of_path(files, "doc_id")
    return first.join(twice, "path").select("path", "doc_id", "skipped")


@query(
    f"""WITH x AS ({_NOTES}), a AS (SELECT path, 'Note ' || doc_id AS title, CASE WHEN doc_id % 10 = 0 THEN doc_id % 3 = 0 ELSE false END AS is_deleted, CASE WHEN doc_id % 10 = 0 OR doc_id % 3 = 0 AND doc_id % 8 > 0 THEN 0 ELSE 4 END AS n_links, doc_id FROM x)
SELECT path, CASE WHEN doc_id % 3 = 0 AND (doc_id % 8 > 0 OR is_deleted) THEN 'was' ELSE title END AS title, is_deleted, n_links FROM a WHERE doc_id % 10 > 0 OR doc_id % 3 = 0"""
)
def vault_imported(spark, sf) -> DataFrame:
    """Records and how many links each has, after an import over a third of the notes, some of them older and some deleted."""
    files = _files(spark, sf).withColumn("deleted", F.col("doc_id") % 10 == 0)
    none = F.lit(None).cast("map<string,string>")
    had = files.where("doc_id % 3 = 0").select(F.concat(F.lit("r"), "doc_id").alias("record_id"), "path", F.lit("was").alias("title"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("body"), none.alias("properties"), F.when(F.col("doc_id") % 8 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(False).alias("is_deleted"))
    links, blocks = vault.note_links(vault.notes(files.limit(0))), vault.note_blocks(vault.notes(files.limit(0)))
    records, links, _ = vault.imported(files, vault.import_plan(files, had.select("path", "record_id", "content_hash", "is_deleted")), had, links, blocks)
    counts = links.groupBy(F.col("source_record_id").alias("record_id")).agg(F.count("*").alias("_n"))
    return records.join(counts, "record_id", "left").select("path", "title", "is_deleted", F.coalesce("_n", F.lit(0)).alias("n_links"))


_LINKED = "SELECT 'l' || doc_id AS link_id, CASE doc_id % 5 WHEN 0 THEN 'Notes/A' WHEN 1 THEN 'notes/a.md#Some Part' WHEN 2 THEN 'notes/a#^b7|alias' WHEN 3 THEN 'notes/b' ELSE 'elsewhere' END AS raw_target, CASE WHEN doc_id % 5 < 3 OR doc_id % 10 = 4 THEN 'notes/a.md' ELSE 'notes/b.md' END AS target_path FROM documents"


@query(f"WITH x AS ({_LINKED}) SELECT link_id, CASE raw_target WHEN 'Notes/A' THEN 'moved/z.md' WHEN 'notes/a.md#Some Part' THEN 'moved/z.md#some-part' WHEN 'notes/a#^b7|alias' THEN 'moved/z.md#^b7|alias' ELSE raw_target END AS raw_target, 'moved/z.md' AS target_path FROM x WHERE target_path = 'notes/a.md'")
def vault_rename_plan(spark, sf) -> DataFrame:
    renames = spark.createDataFrame([("notes/a.md", "moved/z.md"), ("notes/none.md", "notes/b.md")], "old_path string, new_path string")
    return vault.rename_plan(made(spark, sf, _LINKED), renames, spark.createDataFrame([("notes/b.md",)], "path string"))[0].select("link_id", "raw_target", "target_path")


#: Paths of urls as they are, with backslashes, above their root, relative, with empty parts, and blank.
_PATHS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN replace(url, '/', chr(92)) WHEN 2 THEN concat('..', chr(92), url) WHEN 3 THEN concat('/', url) WHEN 4 THEN concat('./', replace(url, '://', '/../')) ELSE CASE WHEN page_id % 4 = 1 THEN './/' ELSE concat('a..b', replace(url, ':', '')) END END AS path FROM pages"


@query(
    f"""WITH x AS ({_PATHS}), y AS (SELECT page_id, path, replace(path, chr(92), '/') AS s FROM x), z AS (SELECT *, [p FOR p IN string_split(s, '/') IF p NOT IN ('', '.')] AS parts FROM y),
n AS (SELECT *, CASE WHEN s[1] = '/' THEN '/' ELSE '' END || array_to_string(parts, '/') AS normal FROM z)
SELECT page_id, normal, CASE WHEN normal = '' THEN 'path_required' WHEN normal[1] = '/' OR list_contains(parts, '..') THEN 'path_outside' END AS refusal FROM n"""
)
def path_checks(spark, sf) -> DataFrame:
    return made(spark, sf, _PATHS).select("page_id", vault.normal_path(F.col("path")).alias("normal"), vault.path_refusal(F.col("path")).alias("refusal"))


_BUNDLE = """SELECT CASE doc_id % 5 WHEN 0 THEN 'd' || doc_id || '/index.md' WHEN 1 THEN 'd' || doc_id || '/log.md' WHEN 2 THEN 'references/r' || doc_id || '.md' ELSE 'c/n' || doc_id || '.md' END AS path, CASE WHEN doc_id % 3 = 0 THEN 'thing' END AS type, doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE '- before' || chr(10) || '## Citations' || chr(10) || '- [Lab](../x/y.md#h)' || chr(10) || 'text' || chr(10) || '* https://s.org/p' || chr(10) || '# Next' || chr(10) || '- [after](/z.md): what' END AS body FROM documents"""


@query(
    f"""WITH x AS ({_BUNDLE}) SELECT path, 'missing_type' AS code FROM x WHERE doc_id % 5 > 1 AND type IS NULL UNION ALL SELECT path, 'reserved_frontmatter_type' FROM x WHERE doc_id % 5 < 2 AND type IS NOT NULL
UNION ALL SELECT path, 'empty_body' FROM x WHERE doc_id % 11 = 0 UNION ALL SELECT path, 'unresolved_link' FROM x WHERE doc_id % 4 = 1"""
)
def bundle_findings(spark, sf) -> DataFrame:
    docs = made(spark, sf, _BUNDLE)
    links = docs.select("path", F.when(F.col("doc_id") % 4 == 0, F.col("path")).otherwise("nowhere.md#x").alias("raw_target"), F.when(F.col("doc_id") % 4 == 2, "external").otherwise("markdown").alias("link_kind"), F.when(F.col("doc_id") % 4 == 3, "resolved").otherwise("unresolved").alias("resolution_status"))
    return vault.findings(docs, links).select("path", "code")


@query(f"WITH x AS ({_BUNDLE}), y AS (SELECT * FROM x WHERE doc_id % 11 <> 0) SELECT path, 3 AS line, 'Lab' AS label, 'x/y.md' AS target, 'bundle_path' AS target_kind FROM y UNION ALL SELECT path, 5, NULL, 'https://s.org/p', 'external' FROM y")
def bundle_citations(spark, sf) -> DataFrame:
    return vault.citations(made(spark, sf, _BUNDLE))


@query(f"WITH x AS ({_BUNDLE}), y AS (SELECT * FROM x WHERE doc_id % 11 <> 0 AND doc_id % 5 = 0) SELECT path, 1 AS line, 'before' AS label, NULL AS target, NULL AS description FROM y UNION ALL SELECT path, 3, 'Lab', 'x/y.md', NULL FROM y UNION ALL SELECT path, 5, 'https://s.org/p', NULL, NULL FROM y UNION ALL SELECT path, 7, 'after', 'z.md', 'what' FROM y")
def bundle_index(spark, sf) -> DataFrame:
    return vault.index_entries(made(spark, sf, _BUNDLE))


#: Documents as a bundle: each links to the next, to one above the bundle's root and to a site; every seventh has no type.
_FILES = "SELECT concat('c/n', doc_id, '.md') AS path, concat(CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('---', chr(10), 'type: ', lang, chr(10), 'by: ', source, chr(10), '---', chr(10)) END, '# T', doc_id, chr(10), 'See [next](../c/n', doc_id + 1, '.md#p) and', chr(10), '[up](../../x.md) or [site](https://a.org/b c)', chr(10), substr(text, 1, 20)) AS content, doc_id FROM documents WHERE text IS NOT NULL"


@query(
    f"""WITH x AS ({_FILES}) SELECT path, 2 AS line, 'c/n' || (doc_id + 1) || '.md' AS target, CASE WHEN doc_id + 1 IN (SELECT doc_id FROM x) THEN 'resolved' ELSE 'unresolved' END AS resolution_status, CASE WHEN doc_id + 1 NOT IN (SELECT doc_id FROM x) THEN 'unresolved_link' END AS code FROM x
UNION ALL SELECT path, 3, NULL, 'unresolved', 'target_outside_bundle' FROM x UNION ALL SELECT path, 3, NULL, 'external', NULL FROM x UNION ALL SELECT path, NULL, NULL, NULL, 'missing_type' FROM x WHERE doc_id % 7 = 0"""
)
def bundle_imported(spark, sf) -> DataFrame:
    _, links, findings = vault.bundle_imported(made(spark, sf, _FILES))
    told = links.join(findings.where("line is not null").select("path", "line", "code").distinct(), ["path", "line"], "left")
    code = F.when(F.col("resolution_status") == "unresolved", F.col("code"))
    return told.select("path", "line", "target", "resolution_status", code.alias("code")).unionByName(findings.where("line is null").select("path", F.col("line"), "code"), allowMissingColumns=True)


@query(f"WITH x AS ({_FILES}) SELECT path, CASE WHEN doc_id % 7 = 0 THEN content ELSE replace(content, 'type: ' || regexp_extract(content, 'type: (.*)', 1) || chr(10) || 'by: ' || regexp_extract(content, 'by: (.*)', 1), 'by: ' || regexp_extract(content, 'by: (.*)', 1) || chr(10) || 'type: ' || regexp_extract(content, 'type: (.*)', 1)) END AS content FROM x")
def bundle_exported(spark, sf) -> DataFrame:
    documents, _, _ = vault.bundle_imported(made(spark, sf, _FILES))
    return vault.bundle_exported(documents).select("path", "content")


@query("SELECT 'canvas-b' || o_custkey || '-e' || o_orderkey AS relation_id, 'r' || o_custkey AS source_record_id, 'r' || (o_custkey + 1) AS target_record_id FROM orders WHERE o_orderkey % 3 > 0")
def canvas_relations(spark, sf) -> DataFrame:
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_custkey")
    edges = F.collect_list(F.struct(F.concat(F.lit("e"), "o_orderkey").alias("id"), F.lit("a").alias("from_node"), F.when(F.col("o_orderkey") % 3 == 0, "free").otherwise("b").alias("to_node")))
    nodes = F.array(*(F.struct(F.lit(i).alias("id"), r.alias("record_id")) for i, r in (("a", F.concat(F.lit("r"), k)), ("b", F.concat(F.lit("r"), k + 1)), ("free", F.lit(None).cast("string")))))
    boards = o.groupBy("o_custkey").agg(edges.alias("edges")).select(F.concat(F.lit("b"), k).alias("board_id"), nodes.alias("nodes"), "edges")
    return vault.board_relations(boards, "related_to", F.lit("2024-01-01")).select("relation_id", "source_record_id", "target_record_id")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'list' WHEN 2 THEN 'int' WHEN 3 THEN 'float' ELSE 'str' END AS kind, CASE doc_id % 5 WHEN 1 THEN 'a b,c' WHEN 4 THEN 'word' END AS said, CASE doc_id % 5 WHEN 2 THEN CAST(doc_id AS DOUBLE) WHEN 3 THEN doc_id + 0.5 END AS number FROM documents")
def frontmatter_scalars(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    raw = F.when(k % 5 == 0, " True ").when(k % 5 == 1, "['a b', \"c\"]").when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(".5"))).otherwise('"word"')
    s = t.table(spark, sf, "documents").select("doc_id", markdown.scalar(raw).alias("s"))
    return s.select("doc_id", "s.kind", F.coalesce("s.text", F.array_join("s.list", ",")).alias("said"), "s.number")


@query("SELECT doc_id, CASE WHEN 100 + doc_id % 50 <= 120 THEN text ELSE rtrim(substr(text, 1, CAST(floor(length(text) * 120 / (100 + doc_id % 50)) AS INT)), ' ') END AS short FROM documents WHERE text IS NOT NULL")
def shortened_texts(spark, sf) -> DataFrame:
    d = t.table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", shortened(F.col("text"), 100 + F.col("doc_id") % 50, F.lit(120)).alias("short"))


_SAID = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10), 'T12:30:00Z') WHEN 1 THEN concat(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10), 'T01:00:00+01:00') WHEN 2 THEN concat(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10), 'T23:59:59') WHEN 3 THEN substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10) ELSE o_orderpriority END AS said FROM orders"


@query(
    f"""SELECT o_orderkey, said, epoch_ms(o_orderdate::DATE::TIMESTAMP) // 1000 + CASE WHEN said LIKE '%Z' THEN 45000 WHEN said LIKE '%+01:00' THEN 0 WHEN length(said) = 19 THEN 86399 WHEN regexp_matches(said, '^[0-9-]{{10}}$') THEN 0 END AS seconds
FROM ({_SAID}) JOIN orders USING (o_orderkey)"""
)
def iso_times(spark, sf) -> DataFrame:
    return made(spark, sf, _SAID).select("o_orderkey", "said", F.unix_timestamp(iso_time(F.col("said"))).alias("seconds"))

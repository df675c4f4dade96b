"""Queries over views, policies, inspection and synchronisation, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.functions import markdown
from mnemos.operators import policy as p
from mnemos.operators import upkeep as u
from mnemos.operators import views as v
from mnemos.plans.record_queries import _CHANGES, _FACTS, _RECORDS
from mnemos.sources import tables as t

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _now(text="2024-01-05"):
    return F.lit(text).cast("timestamp")


# Views


@query(f"WITH {_RECORDS} SELECT id, lang, access_count FROM r WHERE access_count >= 3 AND lang IN ('en', 'de') AND NOT contains(title, '99')")
def view_filter(spark, sf) -> DataFrame:
    where = ("and", ("access_count", "gte", "3"), ("lang", "in", ["en", "de"]), ("not", ("title", "contains", "99")))
    return v.viewed(t.records(spark, sf), where, columns=["lang", "access_count"])


@query(f"WITH {_RECORDS} SELECT id, floor(doc_id / 7) AS half, doc_id - 7 * floor(doc_id / 7) AS rest, CASE WHEN confidence > 0.5 THEN 'high' ELSE 'low' END AS band FROM r WHERE lang = 'fr'")
def view_formula(spark, sf) -> DataFrame:
    n = F.col("doc_id").cast("double")
    formulas = {"half": F.floor(n / 7).cast("double"), "rest": n - 7 * F.floor(n / 7), "band": "CASE WHEN confidence > 0.5 THEN 'high' ELSE 'low' END"}
    return v.viewed(t.records(spark, sf), ("lang", "eq", "fr"), formulas, ["half", "rest", "band"])


@query(f"WITH {_RECORDS} SELECT lang, count(confidence) AS count_confidence, count(DISTINCT CAST(access_count AS VARCHAR)) AS count_distinct_access_count, CAST(sum(access_count) AS DOUBLE) AS sum_access_count, round(avg(confidence), 9) AS avg_confidence, min(access_count) AS min_access_count, max(access_count) AS max_access_count FROM r GROUP BY lang")
def view_summaries(spark, sf) -> DataFrame:
    wanted = [("count", "confidence"), ("count_distinct", "access_count"), ("sum", "access_count"), ("avg", "confidence"), ("min", "access_count"), ("max", "access_count")]
    return v.summaries(t.records(spark, sf), wanted, ["lang"]).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"WITH {_RECORDS} SELECT CAST(access_count AS VARCHAR) AS value, id, count(*) OVER (PARTITION BY access_count) AS n, min(id) OVER (PARTITION BY access_count) AS first_id FROM r WHERE tier = 'archival'")
def view_groups(spark, sf) -> DataFrame:
    members = v.groups(t.records(spark, sf).where("tier = 'archival'"), "access_count")
    return members.join(v.group_sizes(members), "value")


@query(f"WITH {_RECORDS} SELECT id, access_count FROM r ORDER BY CAST(access_count AS VARCHAR) DESC, id LIMIT 40")
def view_sort(spark, sf) -> DataFrame:
    return v.viewed(t.records(spark, sf), sort="-access_count", columns=["access_count"]).limit(40)


@query(f"WITH {_RECORDS} SELECT 'scope' AS field, scope AS value, count(*) AS count FROM r GROUP BY scope UNION ALL SELECT 'tier', tier, count(*) FROM r GROUP BY tier UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY source UNION ALL SELECT 'tags', lang, count(*) FROM r GROUP BY lang")
def facets(spark, sf) -> DataFrame:
    return v.facets(t.records(spark, sf), ["scope", "tier", "source"], ["tags"])


@query("SELECT 'c' || c_custkey AS id, count(o_orderkey) AS n, count(DISTINCT o_orderpriority) AS n_distinct, round(coalesce(sum(o_totalprice), 0.0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def relation_rollup(spark, sf) -> DataFrame:
    e = t.table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), "o_totalprice")
    ids = t.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return v.relation_rollup(ids, e, F.col("o_totalprice")).withColumn("total", F.round("total", 2))


@query(f"WITH {_CHANGES} SELECT max(cursor) AS cursor, max(cursor) > 500 AS stale FROM c WHERE object_type IN ('record', 'relation', 'link')")
def view_staleness(spark, sf) -> DataFrame:
    return v.stale_view(500, t.changes(spark, sf))


@query("SELECT event_type, value FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i FROM events) WHERE i = round_even((n - 1) * 0.95, 0)")
def percentile_rank(spark, sf) -> DataFrame:
    return v.percentile(t.table(spark, sf, "events"), "value", 0.95, ["event_type"])


# Policies


@query(
    f"""WITH {_RECORDS}, x AS (SELECT *, ['active', 'cooling', 'archived', 'superseded'][CAST(doc_id % 4 + 1 AS INT)] AS phase, epoch(TIMESTAMP '2024-01-05') - epoch(updated_at) AS age FROM r)
SELECT id, phase, CASE WHEN phase = 'active' AND age >= 345600 - 86400 THEN 'cooling' WHEN phase = 'cooling' AND access_count > 3 THEN 'active' WHEN phase = 'cooling' AND age >= 259200 + 64800 THEN 'archived' ELSE phase END AS next_phase,
CASE WHEN phase = 'active' AND age >= 259200 THEN 'ttl_active_elapsed' WHEN phase = 'cooling' AND access_count > 3 THEN 'promotion_predicate_matched' WHEN phase = 'cooling' AND age >= 324000 THEN 'ttl_cooling_elapsed' ELSE 'no_transition' END AS transition_reason,
CASE WHEN phase = 'active' AND age < 259200 THEN CAST(epoch(updated_at) AS BIGINT) + 259200 WHEN phase = 'cooling' AND access_count <= 3 AND age < 324000 THEN CAST(epoch(updated_at) AS BIGINT) + 324000 END AS next_evaluation FROM x"""
)
def lifecycle_decisions(spark, sf) -> DataFrame:
    r = t.records(spark, sf).withColumn("phase", F.element_at(F.array(*map(F.lit, ("active", "cooling", "archived", "superseded"))), (F.col("doc_id") % 4 + 1).cast("int")))
    rules = [("access_count_above_threshold", p.promotion("access_count_above_threshold", _now(), threshold=3))]
    return p.lifecycle(r, _now(), "P3D", "PT18H", rules).select("id", "phase", "next_phase", "transition_reason", "next_evaluation")


def _private(spark, sf) -> DataFrame:
    j = t.records(spark, sf).join(t.table(spark, sf, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    visibility = F.when(k % 5 == 0, "hidden").when(k % 5 == 1, "audit_only").when(k % 5 == 2, "redacted").otherwise("visible")
    return j.withColumns({"retrieval_visibility": visibility, "export_visibility": F.when(k % 3 == 0, "hidden").otherwise("visible"), "hook_denied": F.coalesce(F.col("toxic") == 1, F.lit(False))})


_PRIVATE = f"{_RECORDS}, x AS (SELECT r.*, doc_id % 5 AS k, coalesce(toxic = 1, FALSE) AS denied FROM r LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_PRIVATE} SELECT id, CASE WHEN k = 0 THEN 'hidden_by_visibility' WHEN k = 1 THEN 'audit_only' ELSE 'denied_by_policy_hook' END AS reason FROM x WHERE k < 2 OR denied")
def privacy_omissions(spark, sf) -> DataFrame:
    return p.retrieval_filtered(_private(spark, sf), ["content"])[1]


@query(f"WITH {_PRIVATE} SELECT id, CASE WHEN k = 2 THEN '[redacted]' ELSE title END AS title FROM x WHERE k >= 2 AND NOT denied")
def privacy_redaction(spark, sf) -> DataFrame:
    return p.retrieval_filtered(_private(spark, sf), ["title", "content"])[0].select("id", "title")


@query("SELECT 'doc-' || doc_id AS src, 'doc-' || (doc_id + 1) AS dst FROM documents WHERE doc_id % 3 <> 0 AND (doc_id + 1) % 3 <> 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)")
def privacy_export(spark, sf) -> DataFrame:
    r = _private(spark, sf)
    return p.exported(r, r.select(F.col("id").alias("src"), F.concat(F.lit("doc-"), F.col("doc_id") + 1).alias("dst")))[1]


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'erase' WHEN doc_id % 5 = 0 THEN 'tombstone' WHEN doc_id % 3 = 0 THEN 'redact_and_retain' WHEN doc_id % 2 = 0 THEN 'hide' ELSE 'retain' END AS outcome FROM documents")
def retention_outcomes(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    return t.records(spark, sf).withColumns({"erase": k % 7 == 0, "tombstone": k % 5 == 0, "redact": k % 3 == 0, "hide": k % 2 == 0}).select("doc_id", p.retention_outcome().alias("outcome"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'constraint_denied' WHEN doc_id % 11 = 0 THEN 'grant_required' WHEN doc_id % 7 = 0 THEN 'grant_inactive' WHEN doc_id % 5 = 0 THEN 'grant_expired' WHEN doc_id % 9 = 0 THEN 'operation_denied' WHEN doc_id % 4 = 3 THEN 'depth_exceeded' WHEN lang = 'de' THEN 'namespace_denied' ELSE 'allowed' END AS reason,
CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 9 = 0 OR doc_id % 4 = 3 OR lang = 'de' THEN NULL ELSE least(doc_id % 50, 20) END AS max_results FROM documents"""
)
def access_decisions(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    d = t.table(spark, sf, "documents").select("doc_id", "lang")
    spaces = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    requests = d.withColumns(
        {
            "mode": F.when(k % 13 == 0, "deny_all").otherwise("bounded"),
            "constraint_namespaces": F.when(k % 17 == 0, spaces()).otherwise(spaces("en", "fr", "es")),
            "grant_id": F.when(k % 11 != 0, F.lit("g")),
            "status": F.when(k % 7 == 0, "revoked").otherwise("active"),
            "starts_at": F.lit("2024-01-01").cast("timestamp"),
            "ends_at": F.when(k % 5 == 0, F.lit("2024-01-02")).otherwise("2025-01-01").cast("timestamp"),
            "actor": F.lit("a"),
            "granted_actor": F.lit("a"),
            "operation": F.when(k % 9 == 0, "export").otherwise("search"),
            "operations": spaces("search", "list"),
            "depth": k % 4,
            "max_depth": F.lit(2),
            "namespaces": F.array("lang"),
            "granted_namespaces": F.lit(None).cast("array<string>"),
            "limits": F.array(k % 50, F.lit(20).cast("long")),
        }
    )
    return p.access(requests, _now()).select("doc_id", "reason", "max_results")


@query("SELECT c_custkey AS request_id, ['owner', 'maintainer', 'viewer'][CAST(c_nationkey % 3 + 1 AS INT)] AS role, c_nationkey % 3 < 2 AS allowed FROM customer WHERE c_nationkey % 5 <> 4 UNION ALL SELECT c_custkey, NULL, FALSE FROM customer WHERE c_nationkey % 5 = 4")
def role_decisions(spark, sf) -> DataFrame:
    c = t.table(spark, sf, "customer")
    requests = c.select(F.col("c_custkey").alias("request_id"), F.lit("w").alias("workspace"), F.col("c_nationkey").cast("string").alias("actor"), F.lit("write").alias("action"))
    role = lambda n: F.element_at(F.array(*map(F.lit, ("owner", "maintainer", "viewer"))), (n % 3 + 1).cast("int"))
    n = t.table(spark, sf, "nation").where("n_nationkey % 5 <> 4")
    bindings = n.select(F.lit("w").alias("workspace"), F.col("n_nationkey").cast("string").alias("actor"), role(F.col("n_nationkey")).alias("role"), F.lit(1).alias("position")).unionByName(n.select(F.lit("w").alias("workspace"), F.col("n_nationkey").cast("string").alias("actor"), F.lit("owner").alias("role"), F.lit(2).alias("position")))
    return p.role_decision(requests, bindings, {"owner": ["read", "write"], "maintainer": ["read", "write"], "viewer": ["read"]}).select("request_id", "role", "allowed")


@query("SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_size % 10 = 0 THEN 'missing:size' WHEN p_size % 7 = 0 THEN 'type:size' END, CASE WHEN p_size % 11 = 0 THEN 'undeclared_category' END], lambda x: x IS NOT NULL), ',') AS violations FROM part WHERE (p_size % 11 = 0 OR p_size % 10 = 0 OR p_size % 7 = 0) AND p_size % 11 <> 0 UNION ALL SELECT p_partkey, 'undeclared_category' FROM part WHERE p_size % 11 = 0")
def ontology_violations(spark, sf) -> DataFrame:
    s = F.col("p_size")
    rows = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(s % 11 == 0, "gadget").otherwise("part").alias("category"), F.create_map(F.lit("size"), F.when(s % 10 == 0, F.lit(None)).when(s % 7 == 0, F.lit("big")).otherwise(s.cast("string"))).alias("properties"))
    types = spark.createDataFrame([("part",)], "category string")
    properties = spark.createDataFrame([("part", "size", "int", True)], "category string, name string, kind string, required boolean")
    return p.ontology_violations(rows, types, properties).select("id", F.concat_ws(",", "violations").alias("violations"))


@query(f"WITH {_RECORDS} SELECT id, CAST(row_number() OVER (ORDER BY title, id) AS INTEGER) AS place FROM r WHERE doc_id % 3 <> 0 ORDER BY title, id LIMIT 50")
def publish_plan(spark, sf) -> DataFrame:
    return p.publish_plan(_private(spark, sf), 50)


# Inspection and synchronisation


@query(
    f"""WITH {_RECORDS}, {_FACTS}, l AS (SELECT 'l' || doc_id AS link_id, 'doc-' || doc_id AS s, 'doc-' || (doc_id * 3) AS g, CASE WHEN doc_id % 20 = 0 THEN 'unresolved' ELSE 'resolved' END AS status FROM documents WHERE doc_id % 2 = 0)
SELECT 'unresolved_link' AS kind, link_id AS subject_id FROM l WHERE status = 'unresolved' OR g NOT IN (SELECT id FROM r)
UNION ALL SELECT 'orphan_record', id FROM r WHERE id NOT IN (SELECT s FROM l) AND id NOT IN (SELECT g FROM l)
UNION ALL SELECT 'duplicate_alias', a FROM (SELECT 'alias-' || (doc_id % 700) AS a FROM r) GROUP BY a HAVING count(*) > 1
UNION ALL SELECT 'stale_fact', fact_id FROM f WHERE invalidated_at IS NOT NULL OR valid_to IS NOT NULL
UNION ALL SELECT 'broken_source_reference', id FROM r WHERE project_id NOT IN ('src1', 'src2', 'src3')
UNION ALL SELECT 'open_conflict', 'conf-' || c_custkey FROM customer WHERE c_custkey % 50 = 0"""
)
def inspection_findings(spark, sf) -> DataFrame:
    r = t.records(spark, sf).select("id", "doc_id", F.array(F.concat(F.lit("alias-"), F.col("doc_id") % 700)).alias("aliases"), F.col("project_id").alias("source_id"))
    links = r.where("doc_id % 2 = 0").select(F.concat(F.lit("l"), "doc_id").alias("link_id"), F.col("id").alias("source_record_id"), F.concat(F.lit("doc-"), F.col("doc_id") * 3).alias("target_record_id"), F.when(F.col("doc_id") % 20 == 0, "unresolved").otherwise("resolved").alias("resolution_status"))
    known = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source_id string")
    conflicts = t.table(spark, sf, "customer").select(F.concat(F.lit("conf-"), "c_custkey").alias("conflict_id"), F.when(F.col("c_custkey") % 50 == 0, "open").otherwise("resolved").alias("status"))
    return u.inspection(r, links, t.facts(spark, sf), known, conflicts)


@query(
    """SELECT 's' || doc_id AS source_id, CASE WHEN doc_id % 29 = 0 THEN 'rebuild_required' WHEN doc_id % 3 = 0 THEN 'ingest_changed' WHEN doc_id % 5 = 0 THEN 'retry_failed' WHEN doc_id % 7 = 0 OR doc_id % 4 = 1 THEN 'skip_unchanged' ELSE 'ingest_changed' END AS decision FROM documents"""
)
def freshness_replay(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    d = t.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("s"), "doc_id").alias("source_id"))
    incoming = d.select("source_id", F.lit("c1").alias("cursor"), F.lit("h1").alias("hash"), (k % 29 == 0).alias("rebuild"))
    ledger = d.where(k % 3 != 0).select("source_id", F.when(k % 7 == 0, "c1").otherwise("c0").alias("cursor"), F.when(k % 4 == 1, "h1").otherwise("h0").alias("hash"), F.when(k % 5 == 0, "failed").otherwise("ok").alias("status"))
    return u.replay_decisions(incoming, ledger).select("source_id", "decision")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing_file' WHEN doc_id % 7 = 0 THEN 'missing_record' WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'conflict' WHEN doc_id % 2 = 0 THEN 'file_changed' WHEN doc_id % 3 = 0 THEN 'record_changed' ELSE 'unchanged' END AS status FROM documents"""
)
def sync_conflicts(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    d = t.table(spark, sf, "documents").select(
        "doc_id", F.when(k % 11 != 0, F.when(k % 2 == 0, "f2").otherwise("f1")).alias("file_hash"), F.lit("f1").alias("file_was"), F.when(k % 7 != 0, F.when(k % 3 == 0, "r2").otherwise("r1")).alias("record_hash"), F.lit("r1").alias("record_was")
    )
    return d.select("doc_id", u.sync_status().alias("status"))


@query(
    """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new/' ELSE 'doc/' END || doc_id AS path, 'h' || doc_id || CASE WHEN doc_id % 7 = 1 THEN 'x' ELSE '' END AS h FROM documents WHERE doc_id % 13 <> 0),
l AS (SELECT doc_id, 'doc/' || doc_id AS path, 'h' || doc_id AS h, CASE WHEN doc_id % 17 = 0 THEN 'h' || doc_id || 'r' ELSE 'h' || doc_id END AS r FROM documents)
SELECT f.path, l.path AS previous_path, 'renamed' AS kind FROM f JOIN l USING (doc_id) WHERE f.path <> l.path AND f.h = l.h AND l.r = l.h
UNION ALL SELECT f.path, NULL, 'created' FROM f JOIN l USING (doc_id) WHERE f.path <> l.path AND NOT (f.h = l.h AND l.r = l.h)
UNION ALL SELECT l.path, NULL, CASE WHEN l.r <> l.h THEN 'conflict' ELSE 'deleted' END FROM l WHERE l.path NOT IN (SELECT path FROM f) AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = l.doc_id AND f.path <> l.path AND f.h = l.h AND l.r = l.h)
UNION ALL SELECT l.path, NULL, CASE WHEN l.r <> l.h THEN 'conflict' ELSE 'modified' END FROM f JOIN l ON f.path = l.path WHERE f.h <> l.h OR l.r <> l.h"""
)
def workspace_scan(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    d = t.table(spark, sf, "documents").select("doc_id")
    h = F.concat(F.lit("h"), k.cast("string"))
    files = d.where(k % 13 != 0).select(F.concat(F.when(k % 10 == 0, "new/").otherwise("doc/"), k).alias("path"), F.concat(h, F.when(k % 7 == 1, "x").otherwise("")).alias("hash"))
    ledger = d.select(F.concat(F.lit("doc/"), k).alias("path"), h.alias("hash"), k.cast("string").alias("record_id"))
    records = d.select(k.cast("string").alias("record_id"), F.when(k % 17 == 0, F.concat(h, F.lit("r"))).otherwise(h).alias("hash"))
    return u.workspace_scan(files, ledger, records)


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'b' WHEN doc_id % 2 = 0 THEN 'l' WHEN doc_id % 3 = 0 THEN 'r' ELSE 'b' END AS value, doc_id % 6 = 0 AS conflict FROM documents")
def three_way_merge(spark, sf) -> DataFrame:
    d = t.table(spark, sf, "documents").select("doc_id")
    value = lambda by, new: d.select("doc_id", F.when(F.col("doc_id") % by == 0, new).otherwise("b").alias("value"))
    return u.three_way(d.select("doc_id", F.lit("b").alias("value")), value(2, "l"), value(3, "r"), ["doc_id"])


@query("SELECT 'd' || doc_id AS object_id, CASE WHEN doc_id % 3 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'added' ELSE 'unchanged' END AS change FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 = 0)")
def revision_diff(spark, sf) -> DataFrame:
    d = t.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("object_id"), "doc_id")
    return u.set_diff(d.where("doc_id % 5 <> 0"), d.where("doc_id % 3 <> 0"))


@query(
    f"""WITH {_CHANGES}, l AS (SELECT object_type, object_id, 'h' || max(cursor) AS h, arg_max(operation, cursor) AS op FROM c GROUP BY ALL), a AS (SELECT * FROM l WHERE op <> 'delete'),
g AS (SELECT object_type, object_id, CASE WHEN length(object_id) % 2 = 0 THEN h ELSE h || 'x' END AS h FROM l WHERE object_type <> 'link')
SELECT coalesce(a.object_type, g.object_type) AS object_kind, coalesce(a.object_id, g.object_id) AS object_id, CASE WHEN g.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'orphan' ELSE 'stale' END AS finding, CASE WHEN a.h IS NULL THEN 'delete' ELSE 'upsert' END AS action
FROM a FULL JOIN g ON a.object_type = g.object_type AND a.object_id = g.object_id WHERE a.h IS DISTINCT FROM g.h"""
)
def reconcile_inventory(spark, sf) -> DataFrame:
    log = t.changes(spark, sf)
    last = log.groupBy(F.col("object_type").alias("object_kind"), "object_id").agg(F.max("cursor").alias("c"), F.max_by("operation", "cursor").alias("op"))
    h = F.concat(F.lit("h"), "c")
    target = last.where("object_kind <> 'link'").select("object_kind", "object_id", F.when(F.length("object_id") % 2 == 0, h).otherwise(F.concat(h, F.lit("x"))).alias("hash"))
    return u.reconciliation(last.where("op <> 'delete'").select("object_kind", "object_id", h.alias("hash")), target)


_EMBED = """e AS (SELECT 'doc-' || vec_id AS record_id, vec_id, 'label-' || label AS vector_space, CASE WHEN vec_id % 3 = 0 THEN 'alpha' ELSE 'beta' END AS provider, 'm' || vec_id % 4 AS model FROM embeddings),
s AS (SELECT record_id, vector_space, vec_id, list_filter([CASE WHEN vec_id * 60 > vec_id * 50 + 300 AND vec_id IN (SELECT doc_id FROM documents) THEN 'RECORD_UPDATED_AFTER_EMBEDDING' END, CASE WHEN provider = 'beta' THEN 'PROVIDER_NOT_IN_ACTIVE_SET' WHEN model NOT IN ('m0', 'm1') THEN 'MODEL_NOT_IN_ACTIVE_SET' WHEN model = 'm1' THEN 'DIMENSION_MISMATCH' END], lambda x: x IS NOT NULL) AS reasons FROM e)"""


def _stale(spark, sf) -> DataFrame:
    active = spark.createDataFrame([("alpha", "m0", 64), ("alpha", "m1", 32)], "provider string, model string, dimension int")
    return u.stale_embeddings(t.embeddings(spark, sf), t.records(spark, sf), active)


@query(f"WITH {_EMBED} SELECT record_id, vector_space, array_to_string(reasons, ',') AS reasons FROM s WHERE len(reasons) > 0")
def stale_embeddings(spark, sf) -> DataFrame:
    return _stale(spark, sf).withColumn("reasons", F.concat_ws(",", "reasons"))


@query(f"WITH {_EMBED} SELECT record_id, vector_space, CAST(floor((row_number() OVER (ORDER BY record_id, vector_space) - 1) / 16) AS INTEGER) AS batch FROM s WHERE len(reasons) > 0")
def reembed_batches(spark, sf) -> DataFrame:
    return u.batches(_stale(spark, sf).select("record_id", "vector_space"), ["record_id", "vector_space"], 16)


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages""")
def page_links(spark, sf) -> DataFrame:
    return t.table(spark, sf, "pages").select("page_id", F.explode(markdown.hrefs(F.col("html"))).alias("url"))


@query(
    f"""WITH {_RECORDS}, l AS (SELECT 'l' || doc_id AS link_id, CASE doc_id % 4 WHEN 0 THEN 'DOCUMENT ' || doc_id WHEN 1 THEN 'alias ' || doc_id % 10 WHEN 2 THEN 'https://x.org/' || doc_id ELSE 'nothing' END AS raw FROM documents)
SELECT link_id, CASE WHEN raw LIKE 'https:%' THEN 'external' WHEN raw LIKE 'DOC%' THEN 'resolved' WHEN raw LIKE 'alias%' THEN 'ambiguous' ELSE 'unresolved' END AS resolution_status, CASE WHEN raw LIKE 'DOC%' THEN 'doc-' || substr(link_id, 2) END AS target_record_id FROM l"""
)
def link_resolution(spark, sf) -> DataFrame:
    r = t.records(spark, sf).select("id", "title", F.concat(F.lit("notes/"), "id", F.lit(".md")).alias("path"), F.array(F.concat(F.lit("Alias "), F.col("doc_id") % 10)).alias("aliases"), "doc_id")
    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit("DOCUMENT "), k)).when(k % 4 == 1, F.concat(F.lit("alias "), k % 10)).when(k % 4 == 2, F.concat(F.lit("https://x.org/"), k)).otherwise("nothing")
    links = r.select(F.concat(F.lit("l"), k).alias("link_id"), raw.alias("raw_target"))
    return markdown.resolved(links, r).select("link_id", "resolution_status", "target_record_id")


@query(f"WITH {_CHANGES} SELECT max(cursor) AS head, CAST(400 AS BIGINT) AS checkpoint, greatest(0, max(cursor) - 400) AS lag, (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 1) AS retries, (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 0) AS dead_letters FROM c")
def projection_health(spark, sf) -> DataFrame:
    from mnemos.streaming.changes import health

    failures = t.table(spark, sf, "events").where("event_type = 'error'").select((F.col("event_id") % 2 == 0).alias("dead_letter"))
    return health(t.changes(spark, sf), 400, failures)


@query(f"WITH {_CHANGES} SELECT cursor, object_id, CASE operation WHEN 'delete' THEN 'delete' ELSE 'upsert' END AS action, CASE object_type WHEN 'record' THEN 'node' ELSE 'edge' END AS kind FROM c WHERE object_type <> 'entity'")
def graph_projection(spark, sf) -> DataFrame:
    from mnemos.streaming.changes import graph_changes

    return graph_changes(t.changes(spark, sf))

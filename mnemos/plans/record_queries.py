"""Queries over records, facts, episodes and change events, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.functions.columns import in_any_namespace, namespace_key, scope_namespace, uuid5
from mnemos.operators import facts as fact_ops
from mnemos.operators import records as ops
from mnemos.sources import tables as t

QUERIES, ORACLES = {}, {}

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_RECORDS = """r AS (SELECT 'doc-' || doc_id AS id, doc_id, 'project:' || source AS scope, text AS content, 'Document ' || doc_id AS title, lang, source AS project_id,
 ['user_said', 'tool_output', 'agent_inferred', 'validated', 'imported'][CAST(doc_id % 5 + 1 AS INT)] AS source, (doc_id % 10) / 10 AS confidence,
 ['working', 'archival'][CAST(doc_id % 2 + 1 AS INT)] AS tier, doc_id % 7 AS access_count, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at FROM documents)"""
_ORDERS = """o AS (SELECT 'ord-' || o_orderkey AS id, o_orderkey, 'cust-' || o_custkey AS key, o_orderstatus, o_totalprice AS price, o_orderdate AS started,
 lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""
_FACTS = f"""f AS (SELECT 'fact-' || o_orderkey AS fact_id, 'cust-' || o_custkey AS subject_entity_id, o_orderstatus AS object_literal, o_orderkey,
 {_ISO.format("o_orderdate")} AS valid_from, {_ISO.format("lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")} AS valid_to,
 {_ISO.format("o_orderdate + INTERVAL 1 DAY")} AS observed_at, CASE WHEN o_orderkey % 11 = 0 THEN {_ISO.format("o_orderdate")} END AS invalidated_at FROM orders)"""
_CHANGES = """c AS (SELECT event_id + 1 AS cursor, 'ev-' || event_id AS event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'record' WHEN event_type = 'view' THEN 'relation' WHEN event_type = 'click' THEN 'link' ELSE 'entity' END AS object_type,
 'obj-' || event_id % 997 AS object_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS operation, ts AS changed_at, CAST(user_id AS VARCHAR) AS user_id,
 CASE WHEN event_id % 5 = 0 THEN 'key-' || event_id % 400 END AS idempotency_key FROM events)"""


def query(sql: str | None = None):
    """Registers a function(spark, sf_dir) as a query, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _at(text: str):
    return F.lit(text).cast("timestamp")


@query(f"WITH {_ORDERS} SELECT id, key, price FROM o WHERE started <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR TIMESTAMP '1996-06-30' < valid_to)")
def records_valid_at(spark, sf) -> DataFrame:
    return ops.list_records(t.order_records(spark, sf).withColumn("tier", F.lit("working")), at=_at("1996-06-30")).select("id", "key", "price")


@query(f"WITH {_ORDERS} SELECT id, key FROM o WHERE started <= TIMESTAMP '1995-01-15' AND (valid_to IS NULL OR TIMESTAMP '1995-01-15' < valid_to)")
def records_believed_at(spark, sf) -> DataFrame:
    return ops.list_records(t.order_records(spark, sf), believed=_at("1995-01-15")).select("id", "key")


@query(f"WITH {_ORDERS} SELECT id, key FROM o WHERE (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01') AND started < TIMESTAMP '1997-02-01'")
def records_effective_during(spark, sf) -> DataFrame:
    return ops.list_records(t.order_records(spark, sf), during=(_at("1997-01-01"), _at("1997-02-01"))).select("id", "key")


@query(f"WITH {_ORDERS} SELECT id, key, price FROM o WHERE valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01' ORDER BY started DESC, id LIMIT 500")
def records_current(spark, sf) -> DataFrame:
    return ops.list_records(t.order_records(spark, sf), now=_at("1998-01-01"), limit=500).select("id", "key", "price")


@query(f"WITH {_ORDERS} SELECT key, id, price FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY started DESC, id) = 1")
def records_latest_by_key(spark, sf) -> DataFrame:
    return ops.latest(t.order_records(spark, sf), ["key"], [-F.unix_micros(F.col("updated_at").cast("timestamp")), F.col("id")]).select("key", "id", "price")


@query(f"WITH {_ORDERS} SELECT id, price FROM o WHERE key = 'cust-7'")
def records_history(spark, sf) -> DataFrame:
    return ops.listed(t.order_records(spark, sf), [F.desc("updated_at"), "id"], equal={"key": "cust-7"}).select("id", "price")


@query(f"WITH {_RECORDS} SELECT id, scope, tier FROM r WHERE scope IN ('project:src1', 'project:src2') AND tier = 'working' ORDER BY updated_at DESC, id LIMIT 50 OFFSET 10")
def records_page(spark, sf) -> DataFrame:
    return ops.list_records(t.records(spark, sf), scopes=["project:src1", "project:src2"], tiers=["working"], limit=50, offset=10).select("id", "scope", "tier")


@query(f"WITH {_RECORDS} SELECT id, scope FROM r WHERE contains(lower(title || chr(10) || content || chr(10) || lang), 'license')")
def search_keyword(spark, sf) -> DataFrame:
    return ops.search_records(t.records(spark, sf), " License ").select("id", "scope")


@query(f"WITH {_RECORDS} SELECT id, confidence FROM r WHERE contains(lower(title || ' ' || content), 'the') AND contains(lower(title || ' ' || content), 'ing') AND lang = 'en' AND contains(lower(content), 'with') ORDER BY title, id LIMIT 200")
def search_structural(spark, sf) -> DataFrame:
    return ops.structural_search(t.records(spark, sf), terms=["the", "ing"], tags=["#en"], content="with", sort="title", limit=200).select("id", "confidence")


@query(
    f"""WITH {_RECORDS}, l AS (SELECT 'doc-' || doc_id AS s, 'src' || (doc_id % 20) AS raw, 'doc-' || (doc_id * 7 % 1000) AS dst FROM documents)
SELECT id FROM r WHERE EXISTS (SELECT 1 FROM l WHERE l.s = r.id AND l.raw = 'src3') OR FALSE"""
)
def search_link_to(spark, sf) -> DataFrame:
    r = t.records(spark, sf)
    links = r.select(F.col("id").alias("source_record_id"), F.concat(F.lit("src"), F.col("doc_id") % 20).alias("raw_target"), F.concat(F.lit("doc-"), F.col("doc_id") * 7 % 1000).alias("target_record_id"))
    return ops.structural_search(r, links, link_to="src3").select("id")


@query(f"WITH {_RECORDS} SELECT id, 'project_id=' || project_id AS namespace FROM r WHERE project_id IN ('src1', 'src4')")
def namespace_filter(spark, sf) -> DataFrame:
    r = t.records(spark, sf)
    return r.where(in_any_namespace([{"project_id": "src1"}, {"project_id": "src4"}])).select("id", namespace_key(("project_id",)).alias("namespace"))


@query(f"WITH {_RECORDS} SELECT id, project_id FROM r")
def namespace_of_scope(spark, sf) -> DataFrame:
    return t.records(spark, sf).select("id", scope_namespace(F.col("scope"))["project_id"].alias("project_id"))


@query(f"WITH {_RECORDS} SELECT id, confidence, source FROM r WHERE confidence >= 0.5 AND source IN ('validated', 'imported') ORDER BY updated_at DESC, id DESC LIMIT 100")
def candidate_queue(spark, sf) -> DataFrame:
    c = t.records(spark, sf).select(F.col("id").alias("candidate_id"), "confidence", "source", "updated_at", "created_at", F.lit("proposed").alias("status"), F.array("id").alias("evidence"))
    return ops.candidate_queue(c, ["proposed"], 0.5, ["validated", "imported"], True, 100).select(F.col("candidate_id").alias("id"), "confidence", "source")


@query(f"WITH {_ORDERS}, n AS (SELECT id, 'new-' || o_orderkey AS new_id, started + INTERVAL 1 HOUR AS at FROM o WHERE o_orderkey % 9 = 0) SELECT o.id, n.new_id AS superseded_by_id, {_ISO.format('coalesce(n.at, o.valid_to)')} AS valid_to FROM o LEFT JOIN n ON o.id = n.id")
def records_superseded(spark, sf) -> DataFrame:
    r = t.order_records(spark, sf)
    key = F.substring("id", 5, 20).cast("long")
    new = r.where(key % 9 == 0).select(F.col("id").alias("old_id"), F.concat(F.lit("new-"), key).alias("new_id"), (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    return ops.superseded(r, new).select("id", "superseded_by_id", F.date_format("valid_to", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_to"))


@query(
    f"""WITH {_RECORDS}, gone AS (SELECT id FROM r WHERE doc_id % 13 = 0), e AS (SELECT 'doc-' || doc_id AS src, 'doc-' || (doc_id + 1) AS dst FROM documents)
SELECT 'closed' AS what, count(*) AS n FROM gone UNION ALL SELECT 'edges', count(*) FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)"""
)
def cascade_erasure(spark, sf) -> DataFrame:
    r = t.records(spark, sf)
    e = r.select(F.col("id").alias("src"), F.concat(F.lit("doc-"), F.col("doc_id") + 1).alias("dst"))
    closed, kept = ops.erased(r, {"edges": (e, ["src", "dst"])}, r.where("doc_id % 13 = 0"), _at("2025-01-01"))
    return closed.where("valid_to is not null").agg(F.lit("closed").alias("what"), F.count("*").alias("n")).unionByName(kept["edges"].agg(F.lit("edges").alias("what"), F.count("*").alias("n")))


@query(f"WITH {_FACTS} SELECT fact_id, subject_entity_id, object_literal FROM f WHERE invalidated_at IS NULL")
def facts_active(spark, sf) -> DataFrame:
    return fact_ops.list_facts(t.facts(spark, sf)).select("fact_id", "subject_entity_id", "object_literal")


@query(f"WITH {_FACTS} SELECT fact_id, invalidated_at FROM f WHERE invalidated_at IS NOT NULL")
def facts_historical(spark, sf) -> DataFrame:
    return fact_ops.list_facts(t.facts(spark, sf), state="historical").select("fact_id", "invalidated_at")


@query(f"WITH {_FACTS} SELECT fact_id, subject_entity_id FROM f WHERE invalidated_at IS NULL AND valid_from <= '1996-01-01T00:00:00Z' AND (valid_to IS NULL OR valid_to > '1996-01-01T00:00:00Z')")
def facts_valid_at(spark, sf) -> DataFrame:
    return fact_ops.list_facts(t.facts(spark, sf), valid_at="1996-01-01T00:00:00Z").select("fact_id", "subject_entity_id")


@query(f"WITH {_FACTS} SELECT fact_id, observed_at FROM f WHERE observed_at <= '1997-07-01T00:00:00Z' AND o_orderkey % 50 = 3")
def facts_learned_at(spark, sf) -> DataFrame:
    return fact_ops.list_facts(t.facts(spark, sf), state="all", learned_at="1997-07-01T00:00:00Z", episode="ep-3").select("fact_id", "observed_at")


@query(
    f"""WITH {_FACTS}, g AS (SELECT fact_id, subject_entity_id, object_literal, valid_from, CASE WHEN o_orderkey % 3 > 0 THEN valid_to END AS valid_to FROM f WHERE invalidated_at IS NULL),
p AS (SELECT 'cust-' || c_custkey AS subject_entity_id, '1996-0' || (c_custkey % 9 + 1) || '-01T00:00:00Z' AS "at" FROM customer),
x AS (SELECT p.*, g.fact_id, g.object_literal, row_number() OVER (PARTITION BY p.subject_entity_id, p."at" ORDER BY g.valid_from DESC, g.fact_id DESC) AS n
      FROM p LEFT JOIN g ON g.subject_entity_id = p.subject_entity_id AND g.valid_from <= p."at" AND (g.valid_to IS NULL OR p."at" < g.valid_to))
SELECT subject_entity_id, "at", fact_id, object_literal FROM x WHERE n = 1"""
)
def facts_as_of_join(spark, sf) -> DataFrame:
    """A third of the facts are never closed, so facts overlap."""
    p = t.table(spark, sf, "customer").select(F.concat(F.lit("cust-"), "c_custkey").alias("subject_entity_id"), F.concat(F.lit("1996-0"), F.col("c_custkey") % 9 + 1, F.lit("-01T00:00:00Z")).alias("at"))
    facts = t.facts(spark, sf).withColumn("valid_to", F.when(F.substring_index("fact_id", "-", -1).cast("long") % 3 > 0, F.col("valid_to")))
    return fact_ops.facts_as_of(p, facts)


@query(
    f"""WITH {_FACTS}, d AS (SELECT 'fact-' || (o_orderkey + 1) AS s, 'fact-' || o_orderkey AS g, CASE o_orderkey % 3 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'invalidates_target' ELSE 'both_valid' END AS decision FROM orders WHERE o_orderkey % 4 = 0)
SELECT f.fact_id, CASE WHEN decision <> 'both_valid' THEN '2000-01-01T00:00:00Z' ELSE invalidated_at END AS invalidated_at, CASE WHEN decision = 'supersedes' THEN s END AS superseded_by_fact_id
FROM f LEFT JOIN d ON d.g = f.fact_id AND d.s IN (SELECT fact_id FROM f)"""
)
def contradictions_apply(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    d = t.table(spark, sf, "orders").where(k % 4 == 0).select(F.concat(F.lit("fact-"), k + 1).alias("source_fact_id"), F.concat(F.lit("fact-"), k).alias("target_fact_id"), F.when(k % 3 == 0, "supersedes").when(k % 3 == 1, "invalidates_target").otherwise("both_valid").alias("decision"), F.lit("2000-01-01T00:00:00Z").alias("decided_at"))
    return fact_ops.apply_contradictions(t.facts(spark, sf), d).select("fact_id", "invalidated_at", "superseded_by_fact_id")


@query(
    """WITH s AS (SELECT 'ep-' || conv_id AS episode_id, turn, CASE WHEN role = 'user' THEN 'user_input' ELSE 'tool_result' END AS kind, 'tool-' || turn % 3 AS tool FROM conversations WHERE turn >= 1 AND turn < 5),
f AS (SELECT episode_id, tool, min(turn) AS turn FROM s GROUP BY ALL)
SELECT e.episode_id, n_steps, kinds, tools FROM (SELECT episode_id, CAST(count(*) AS INTEGER) AS n_steps, string_agg(kind, ',' ORDER BY turn, kind) AS kinds FROM s GROUP BY episode_id) e JOIN (SELECT episode_id, string_agg(tool, ',' ORDER BY turn) AS tools FROM f GROUP BY episode_id) g USING (episode_id)"""
)
def episode_replay(spark, sf) -> DataFrame:
    return fact_ops.episode_replay(t.steps(spark, sf), 1, 5).select("episode_id", "n_steps", F.array_join(F.transform("steps", lambda x: x["kind"]), ",").alias("kinds"), F.array_join("tools", ",").alias("tools"))


@query(f"WITH {_CHANGES} SELECT cursor, event_id, object_type, operation FROM c WHERE cursor > 100 AND user_id = '7' ORDER BY cursor LIMIT 1000")
def changes_since(spark, sf) -> DataFrame:
    return ops.listed(t.changes(spark, sf), ["cursor"], equal={"user_id": "7"}, where=F.col("cursor") > 100, limit=1000).select("cursor", "event_id", "object_type", "operation")


@query(f"WITH {_CHANGES} SELECT object_type, object_id, cursor, user_id FROM (SELECT *, row_number() OVER (PARTITION BY object_type, object_id ORDER BY cursor DESC) AS n FROM c) WHERE n = 1 AND operation <> 'delete'")
def live_objects(spark, sf) -> DataFrame:
    return ops.live(t.changes(spark, sf)).select("object_type", "object_id", "cursor", "user_id")


@query(f"WITH {_CHANGES} SELECT cursor, event_id FROM c QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY cursor) = 1")
def delta_dedupe(spark, sf) -> DataFrame:
    from mnemos.streaming.changes import deduplicated

    return deduplicated(t.changes(spark, sf)).select("cursor", "event_id")


@query(f"WITH {_CHANGES} SELECT object_type, operation, count(*) AS n, max(cursor) AS head FROM c GROUP BY ALL")
def change_counts(spark, sf) -> DataFrame:
    return t.changes(spark, sf).groupBy("object_type", "operation").agg(F.count("*").alias("n"), F.max("cursor").alias("head"))


@query()
def stable_ids(spark, sf) -> DataFrame:
    """UUIDs of record ids; SQL has no version 5."""
    return t.records(spark, sf).select("id", uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("id")).alias("uuid"))

"""Queries over access decisions, digests, kept-up views, projection turns, workspaces and bundles, with the SQL that gives the same rows."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.functions.shared import shared_folder
from mnemos.operators import access, range_digests, view_upkeep
from mnemos.plans.typed_queries import made
from mnemos.sources import bundle_source
from mnemos.sources import tables as t
from mnemos.streaming import worker, workspace

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# Access

#: Customers as those who ask, with what their orders say about their grant.
_ASKED = """SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, n, first_at, last_at, prices, urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at,
max(o_totalprice) AS prices, count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) AS urgent FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey"""


@query(
    f"""WITH a AS ({_ASKED}), b AS (SELECT *, c_mktsegment <> 'HOUSEHOLD' AS delegated, c_nationkey % 5 AS region, CASE WHEN c_acctbal > 0 THEN ['a', 'b'] END AS of_constraint, CASE WHEN n % 3 = 0 THEN ['b', 'c'] WHEN n % 3 = 1 THEN ['c'] END AS of_grant FROM a),
c AS (SELECT *, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'constraint_denied' WHEN NOT delegated THEN 'trusted_local' WHEN n IS NULL THEN 'grant_required' WHEN prices < 100000 THEN 'grant_inactive'
WHEN first_at > TIMESTAMP '1997-01-01' THEN 'grant_not_yet_active' WHEN last_at <= TIMESTAMP '1997-01-01' THEN 'grant_expired' WHEN c_custkey % 50 = 7 THEN 'grant_mismatch' WHEN urgent = 0 THEN 'operation_denied' WHEN n > 20 THEN 'depth_exceeded'
WHEN c_acctbal > 8000 AND n % 2 = 0 THEN 'reshare_denied' WHEN region = 4 AND c_nationkey > 10 THEN 'selector_denied' WHEN of_grant = ['c'] AND of_constraint IS NOT NULL THEN 'record_type_denied' ELSE 'allowed' END AS reason FROM b)
SELECT c_custkey AS request_id, reason, CASE WHEN reason = 'allowed' THEN 't' || c_nationkey || CASE WHEN region = 4 THEN '/u4' ELSE '/' END WHEN reason = 'trusted_local' THEN 't' || c_nationkey || '/' END AS selectors,
CASE WHEN reason = 'allowed' THEN CASE WHEN of_constraint IS NULL AND of_grant IS NULL THEN 'b,c' WHEN of_grant IS NULL THEN 'b' WHEN of_constraint IS NULL AND n % 3 = 0 THEN 'b,c' WHEN of_constraint IS NULL THEN 'c' ELSE 'b' END
     WHEN reason = 'trusted_local' THEN CASE WHEN of_constraint IS NULL THEN 'b,c' ELSE 'b' END END AS types,
CASE WHEN reason = 'allowed' THEN least(n, 9) WHEN reason = 'trusted_local' THEN 9 END AS max_results FROM c"""
)
def access_decisions(spark, sf) -> DataFrame:
    """Every customer asks to read under a constraint of its nation, by a grant that its orders stand for."""
    ids = ("tenant_id", "user_id")
    constraint_type, grant_type = access.schemas(ids)
    c = {k: F.col(k) for k in ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "n", "first_at", "last_at", "prices", "urgent")}
    tenant, region = F.concat(F.lit("t"), c["c_nationkey"]), c["c_nationkey"] % 5
    selector = lambda x, y=None: F.struct(x.alias("tenant_id"), (F.lit(None).cast("string") if y is None else y).alias("user_id"))
    none, lists = F.lit(None), ("namespaces", "workspace_ids", "record_types", "operations", "max_results", "max_context_tokens")

    def constraint(mode: str, **given):
        kinds = dict(zip(lists, ("array<struct<tenant_id: string, user_id: string>>", *["array<string>"] * 3, "int", "int"), strict=True))
        return F.struct(F.lit(mode).alias("mode"), *(given.get(k, none).cast(v).alias(k) for k, v in kinds.items()))

    own = constraint("bounded", namespaces=F.array(selector(tenant)), record_types=F.when(c["c_acctbal"] > 0, F.array(F.lit("a"), F.lit("b"))))
    more = F.when(c["c_mktsegment"] == "MACHINERY", constraint("deny_all")).when(c["c_mktsegment"] == "BUILDING", constraint("unconstrained_trusted"))
    given = F.when(region == 4, F.array(F.when(c["c_nationkey"] > 10, selector(F.lit("none"))).otherwise(selector(F.lit(None).cast("string"), F.lit("u4"))))).otherwise(F.array(selector(tenant)))
    state = F.when(c["prices"] < 100000, "revoked").otherwise("active")
    types = F.when(c["n"] % 3 == 0, F.array(F.lit("b"), F.lit("c"))).when(c["n"] % 3 == 1, F.array(F.lit("c")))
    operations = F.when(c["urgent"] > 0, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("write")))
    bound = {b: F.lit("x") for b in access.BINDINGS}
    fields = {"grant_id": F.lit("g"), "state": state, "issued_at": c["first_at"], "expires_at": c["last_at"], **bound, "max_depth": F.lit(20), "can_reshare": c["n"] % 2 == 1, "namespaces": given, "workspace_ids": none, "record_types": types, "operations": operations, "max_results": c["n"], "max_context_tokens": none}
    grant = F.when(c["n"].isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())).cast(grant_type))
    requests = made(spark, sf, _ASKED).select(
        c["c_custkey"].alias("request_id"), F.array_compact(F.array(own, more)).cast(constraint_type).alias("constraints"), grant.alias("grant"), (c["c_mktsegment"] != "HOUSEHOLD").alias("delegated"),
        F.lit(9).alias("host_max_results"), F.lit(None).cast("int").alias("host_max_context_tokens"), *(v.alias(b) for b, v in bound.items()), F.lit("read").alias("operation"), F.lit(None).cast("array<struct<tenant_id: string, user_id: string>>").alias("namespaces"),
        F.lit(None).cast("array<string>").alias("workspace_ids"), F.array(F.lit("b"), F.lit("c")).alias("record_types"), c["n"].cast("int").alias("depth"), (c["c_acctbal"] > 8000).alias("reshare"), F.when(c["c_custkey"] % 50 == 7, "h").otherwise("g").alias("grant_id"), F.lit(50).alias("max_results"), F.lit(None).cast("int").alias("max_context_tokens"),
    )
    out = access.decided(requests, F.lit("1997-01-01").cast("timestamp"), ids)
    selectors = F.array_join(F.transform("namespaces", lambda s: F.concat(F.coalesce(s["tenant_id"], F.lit("")), F.lit("/"), F.coalesce(s["user_id"], F.lit("")))), ",")
    return out.select("request_id", "reason", selectors.alias("selectors"), F.array_join("record_types", ",").alias("types"), "max_results")


# Digests

_CANONICAL = "SELECT o_orderstatus AS object_kind, CAST(o_orderkey AS VARCHAR(20)) AS object_id, CAST(o_custkey AS VARCHAR(20)) AS hash FROM orders WHERE o_totalprice > 3000"
#: Orders as their lines know them: those without a returned line are as they should be but for a few; two lines of the first supplier are of orders that nobody knows.
_TARGET = """SELECT CASE WHEN parts > 6 THEN 'F' ELSE o_orderstatus END AS object_kind, CAST(o_orderkey AS VARCHAR(20)) AS object_id, CASE WHEN tax > 0.07 AND parts = 7 THEN NULL WHEN tax > 0.07 AND parts = 1 THEN 'other' ELSE CAST(o_custkey AS VARCHAR(20)) END AS hash
FROM orders JOIN (SELECT l_orderkey, count(*) AS parts, max(l_tax) AS tax FROM lineitem GROUP BY l_orderkey HAVING max(l_discount) > 0.01) l ON o_orderkey = l_orderkey"""
_FOUND = f"""WITH c AS ({_CANONICAL}), t AS ({_TARGET}), j AS (SELECT coalesce(c.object_kind, t.object_kind) AS object_kind, coalesce(c.object_id, t.object_id) AS object_id, c.hash AS canonical_hash, t.hash AS target_hash, c.object_id IS NOT NULL AS a, t.object_id IS NOT NULL AS b FROM c FULL JOIN t ON c.object_kind = t.object_kind AND c.object_id = t.object_id),
f AS (SELECT CASE WHEN NOT b THEN 'missing' WHEN NOT a THEN 'orphan' WHEN target_hash IS NULL THEN 'unverifiable' WHEN canonical_hash <> target_hash THEN 'stale' END AS finding, * FROM j)"""


def _findings(spark, sf) -> DataFrame:
    return range_digests.findings(made(spark, sf, _CANONICAL), made(spark, sf, _TARGET), "graph", 41, "40")


@query(f"{_FOUND} SELECT finding, object_kind, object_id, canonical_hash, target_hash FROM f WHERE finding IS NOT NULL UNION ALL SELECT 'watermark_mismatch', 'target', 'graph', '41', '40'")
def digest_findings(spark, sf) -> DataFrame:
    return _findings(spark, sf)


@query(f"{_FOUND} SELECT object_kind, object_id, CASE WHEN finding = 'unverifiable' THEN NULL ELSE canonical_hash END AS hash FROM f WHERE a")
def digest_repairs(spark, sf) -> DataFrame:
    return range_digests.repaired(made(spark, sf, _TARGET), range_digests.repairs(_findings(spark, sf)), 41, 41)


# Views


@query(
    """WITH e AS (SELECT l_orderkey AS k, arg_max(l_returnflag, (l_linenumber, l_extendedprice)) AS flag, arg_max(l_linestatus, (l_linenumber, l_extendedprice)) AS status, arg_max(l_extendedprice, (l_linenumber, l_extendedprice)) AS price FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT k FROM e) UNION ALL SELECT k, status, price FROM e WHERE flag <> 'R' AND price > 5000)
SELECT status, count(*) AS n, count(price) AS n_price, round(sum(price), 2) AS sum_price, min(price) AS min_price, max(price) AS max_price FROM r GROUP BY status"""
)
def view_kept_up(spark, sf) -> DataFrame:
    """Groups of orders after each of their lines came as an event: a returned one deletes the order, any other sets its status and price."""
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("object_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    lines = t.table(spark, sf, "lineitem")
    payload = F.to_json(F.struct(F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price")))
    events = lines.select((F.col("l_linenumber").cast("long") * 10**9 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cursor"), F.col("l_orderkey").cast("string").alias("object_id"), F.when(F.col("l_returnflag") == "R", "delete").otherwise("put").alias("operation"), payload.alias("payload"))
    new = lambda e: e.select("object_id", F.from_json("payload", "status string, price double").alias("p")).select("object_id", "p.*").where("price > 5000")
    _, groups, _ = view_upkeep.maintained(orders, view_upkeep.summarised(orders, "status", ["price"]), events, new, "status", ["price"], 0)
    return groups.withColumn("sum_price", F.round(F.col("sum_price").cast("double"), 2))


# Projection


def _turn_sql(number: int, now: str, most: int, before: str) -> str:
    """A turn of the worker: `tried`, what goes wrong first, and the ledger after it."""
    n = number
    return f"""a{n} AS (SELECT e.*, l.bad AS had, l.attempts AS tries FROM e LEFT JOIN {before} l USING (target) WHERE cursor > coalesce(l.checkpoint, 0) AND (l.bad IS NULL OR (NOT l.dead AND l.due <= TIMESTAMP '{now}')) QUALIFY row_number() OVER (PARTITION BY target ORDER BY cursor) <= {most}),
b{n} AS (SELECT target, min(cursor) FILTER (heals > TIMESTAMP '{now}') AS bad, max(had) AS had, max(tries) AS tries, max(cursor) AS last FROM a{n} GROUP BY target),
l{n} AS (SELECT b.target, coalesce((SELECT max(cursor) FROM a{n} x WHERE x.target = b.target AND (b.bad IS NULL OR x.cursor < b.bad)), (SELECT checkpoint FROM {before} y WHERE y.target = b.target), 0) AS checkpoint, b.bad,
         CASE WHEN b.bad IS NOT NULL THEN CASE WHEN b.bad = b.had THEN b.tries + 1 ELSE 1 END END AS attempts FROM b{n} b),
d{n} AS (SELECT target, checkpoint, bad, attempts, attempts >= 3 AS dead, TIMESTAMP '{now}' + least(300, 2 ** (attempts - 1)) * INTERVAL 1 SECOND AS due FROM l{n}
         UNION ALL SELECT target, checkpoint, bad, attempts, dead, due FROM {before} WHERE target NOT IN (SELECT target FROM b{n}))"""


_TIMES = ("2024-01-20 00:00:00", "2024-01-20 00:00:01", "2024-01-20 00:00:02", "2024-01-20 00:10:00")


@query(
    f"""WITH e AS (SELECT 't' || (user_id % 6) AS target, event_id + 1 AS cursor, CASE WHEN event_type = 'error' THEN CASE WHEN value > 15 THEN TIMESTAMP '2100-01-01' ELSE TIMESTAMP '2024-01-20 00:00:01' END ELSE ts END AS heals FROM events),
d0 AS (SELECT '' AS target, CAST(0 AS BIGINT) AS checkpoint, CAST(NULL AS BIGINT) AS bad, CAST(NULL AS INTEGER) AS attempts, false AS dead, TIMESTAMP '2024-01-01' AS due WHERE false), {", ".join(_turn_sql(i + 1, now, 40, f"d{i}") for i, now in enumerate(_TIMES))}
SELECT target AS target_id, checkpoint, 'ev-' || (bad - 1) AS event_id, CAST(attempts AS INTEGER) AS attempts, CASE WHEN bad IS NOT NULL THEN dead END AS dead_letter FROM d{len(_TIMES)}"""
)
def projection_turns(spark, sf) -> DataFrame:
    """The ledger of six targets after four turns over the change log; errors fail, some of them for a second, some for good."""
    e = t.table(spark, sf, "events")
    heals = F.when(F.col("event_type") == "error", F.when(F.col("value") > 15, F.lit("2100-01-01")).otherwise("2024-01-20 00:00:01").cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
    events = e.select(F.concat(F.lit("t"), F.col("user_id") % 6).alias("target_id"), (F.col("event_id") + 1).alias("cursor"), F.concat(F.lit("ev-"), "event_id").alias("event_id"), heals.alias("heals"))
    ledger = spark.createDataFrame([], worker.LEDGER)
    for text in _TIMES:
        now = F.lit(text).cast("timestamp")
        _, ledger = worker.turn(events, ledger, now, lambda x: x.withColumns({"ok": F.col("heals") <= now, "reason": F.lit("target_write_failed")}), 40, 3)
        ledger = worker.settled(ledger)
    return ledger.select("target_id", "checkpoint", "event_id", "attempts", "dead_letter")


# A workspace

_FILES = "SELECT concat(source, '/', doc_id, '.md') AS path, text AS content, CAST(sha2_of AS VARCHAR(64)) AS hash FROM (SELECT *, {} AS sha2_of FROM documents) d WHERE lang <> 'fr' AND text IS NOT NULL"
_HAD = "SELECT concat(source, '/', doc_id, '.md') AS path, CASE WHEN n_chars % 3 = 0 THEN 'old' ELSE {} END AS hash, concat('r', doc_id) AS record_id, 'fresh' AS status, CAST(NULL AS VARCHAR(9)) AS superseded_by, n_chars FROM documents WHERE lang IN ('en', 'fr') AND text IS NOT NULL"
_SHA = ("sha256(text)", "sha2(text, 256)")


@query(
    f"""WITH f AS ({_FILES.format(_SHA[0])}), l AS ({_HAD.format(_SHA[0])}), r AS (SELECT record_id, CASE WHEN n_chars % 5 = 0 THEN 'edited' ELSE hash END AS hash FROM l WHERE n_chars % 11 > 0),
j AS (SELECT coalesce(f.path, l.path) AS path, f.hash AS f, l.hash AS l, l.path IS NOT NULL AS known, r.hash IS NOT NULL AND r.hash <> l.hash AS differs, r.record_id IS NULL AS lost FROM f FULL JOIN l ON f.path = l.path LEFT JOIN r ON r.record_id = l.record_id),
k AS (SELECT path, f, l, CASE WHEN NOT known THEN 'created' WHEN f IS NULL AND differs THEN 'conflict' WHEN f IS NULL THEN 'deleted' WHEN lost THEN 'modified' WHEN f = l AND NOT differs THEN NULL WHEN differs THEN 'conflict' ELSE 'modified' END AS kind FROM j),
c AS (SELECT path, f AS h, row_number() OVER (PARTITION BY f ORDER BY path) AS n FROM k WHERE kind = 'created'), g AS (SELECT path, l AS h, row_number() OVER (PARTITION BY l ORDER BY path) AS n FROM k WHERE kind = 'deleted'),
m AS (SELECT c.path, g.path AS old_path FROM c JOIN g ON c.h = g.h AND c.n = g.n)
SELECT path, CASE WHEN kind = 'deleted' THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN kind IN ('deleted') OR kind IS NULL OR kind = 'conflict' THEN l ELSE f END AS hash, (SELECT m.path FROM m WHERE m.old_path = k.path) AS superseded_by FROM k WHERE kind IS NULL OR kind <> 'conflict' OR l IS NOT NULL"""
)
def workspace_ledger(spark, sf) -> DataFrame:
    """The ledger after a sync of documents as files: French ones are gone, German and Spanish ones new, others older than their file or edited as records."""
    files = made(spark, sf, _FILES.format(_SHA[1]))
    had = made(spark, sf, _HAD.format(_SHA[1]))
    at = F.lit("2024-01-02").cast("timestamp")
    records = had.where("n_chars % 11 > 0").select("record_id", "path", F.lit("").alias("content"), F.when(F.col("n_chars") % 5 == 0, "edited").otherwise(F.col("hash")).alias("hash"), at.alias("updated_at"))
    ledger = had.drop("n_chars").withColumn("updated_at", at)
    plan = workspace.planned(files, ledger, records)
    after, _, _ = workspace.applied(files, ledger, records, spark.createDataFrame([], workspace.CONFLICTS), plan, at)
    return after.select("path", "status", "hash", "superseded_by")


# Bundles


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def sealed_bundle(spark, sf) -> DataFrame:
    """Customers written as a bundle and read again, every part verified."""
    spark.dataSource.register(bundle_source.BundleSource)
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    t.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").write.format("sealed_bundle").mode("overwrite").save(path)
    return spark.read.format("sealed_bundle").load(path)

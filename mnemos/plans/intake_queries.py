"""Queries over connectors, ingestion, erasures, templates, sealed payloads and schemas, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.operators import context, explorer, intake, policy
from mnemos.plans.typed_queries import made
from mnemos.sources import bundles
from mnemos.sources import tables as t

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_ENTRIES = "SELECT concat('s', s_suppkey) AS source_id, CASE s_nationkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'api' WHEN 2 THEN 'webhook' ELSE 'fax' END AS source_type, 'tenant_id=t' AS namespace, s_name AS display_name, CASE WHEN s_acctbal > 6000 THEN 'read_write' WHEN s_acctbal > 0 THEN 'read_only' ELSE 'metadata_only' END AS permission_scope, CAST(NULL AS VARCHAR(9)) AS cursor, CAST(NULL AS VARCHAR(9)) AS content_hash FROM supplier"
_BROUGHT = "SELECT concat('s', l_suppkey) AS source_id, 'tenant_id=t' AS namespace, CASE l_returnflag WHEN 'A' THEN 'document' WHEN 'R' THEN 'record' ELSE CASE WHEN l_linenumber = 3 THEN 'song' ELSE 'link' END END AS payload_kind, CASE WHEN l_quantity < 3 THEN CAST(NULL AS VARCHAR(9)) ELSE 'said' END AS payload, concat(l_orderkey, '-', l_partkey, '-', l_linenumber) AS cursor, CAST(NULL AS VARCHAR(9)) AS content_hash, CASE WHEN l_linestatus = 'F' THEN 'read_write' ELSE 'read_only' END AS permission_scope FROM lineitem"


def _registry(spark, sf) -> tuple[DataFrame, DataFrame]:
    at = F.lit("2024-01-02").cast("timestamp")
    entries = made(spark, sf, _ENTRIES)
    old = entries.where("source_type = 'api'").withColumns({"display_name": F.lit("old"), "created_at": F.lit("2023-01-01").cast("timestamp"), "updated_at": F.lit("2023-01-01").cast("timestamp")})
    return intake.registered(entries, old, at)


@query(f"WITH e AS ({_ENTRIES}) SELECT source_id, display_name, CASE WHEN source_type = 'fax' THEN 'invalid source_type' END AS refusal, CASE source_type WHEN 'api' THEN '2023' WHEN 'fax' THEN NULL ELSE '2024' END AS since FROM e")
def connector_registry(spark, sf) -> DataFrame:
    registry, refused = _registry(spark, sf)
    return registry.select("source_id", "display_name", F.lit(None).cast("string").alias("refusal"), F.date_format("created_at", "yyyy").alias("since")).unionByName(refused.select("source_id", "display_name", "refusal"), allowMissingColumns=True)


@query(
    f"""WITH e AS (SELECT * FROM ({_ENTRIES}) WHERE source_type <> 'fax'), b AS ({_BROUGHT}), j AS (SELECT b.*, e.permission_scope AS may FROM b LEFT JOIN e USING (source_id)),
k AS (SELECT CASE WHEN may IS NULL THEN 'unknown source' WHEN payload_kind = 'song' THEN 'invalid payload_kind' WHEN payload IS NULL THEN 'payload is required' WHEN may <> 'read_write' AND permission_scope = 'read_write' OR may = 'metadata_only' THEN 'permission exceeded' END AS refusal, source_id, cursor FROM j)
SELECT refusal, count(*) AS n, count(DISTINCT source_id || ':' || cursor) AS ids FROM k GROUP BY refusal"""
)
def connector_envelopes(spark, sf) -> DataFrame:
    good, bad = intake.enveloped(made(spark, sf, _BROUGHT), _registry(spark, sf)[0])
    named = F.concat_ws(":", "source_id", "cursor")
    return good.agg(F.lit(None).cast("string").alias("refusal"), F.count("*").alias("n"), F.count_distinct("ingest_id").alias("ids")).unionByName(bad.groupBy("refusal").agg(F.count("*").alias("n"), F.count_distinct(named).alias("ids")))


_BATCH = "SELECT concat('i', event_id) AS ingest_id, event_id AS position, event_type <> 'view' AS accepted, CASE WHEN event_type = 'error' AND value > 20 THEN 'E: broken' END AS error, event_id FROM events"


@query(
    f"""WITH b AS ({_BATCH}), a AS (SELECT * FROM b WHERE event_id % 3 > 0 ORDER BY position LIMIT 400), stop AS (SELECT min(position) AS p FROM a WHERE error IS NOT NULL), r AS (SELECT a.* FROM a, stop WHERE p IS NULL OR position <= p),
done AS (SELECT ingest_id FROM b WHERE event_id % 3 = 0 UNION SELECT ingest_id FROM r WHERE error IS NULL), x AS (SELECT b.* FROM b WHERE ingest_id NOT IN (SELECT ingest_id FROM done) ORDER BY position LIMIT 300)
SELECT ingest_id, 'first' AS run, CASE WHEN error IS NOT NULL THEN 'failed' WHEN accepted THEN 'accepted' ELSE 'skipped' END AS status FROM r UNION ALL SELECT ingest_id, 'second', CASE WHEN error IS NOT NULL THEN 'failed' WHEN accepted THEN 'accepted' ELSE 'skipped' END FROM x"""
)
def ingest_batch(spark, sf) -> DataFrame:
    """A batch that a third of is done of: it stops at its first error, and goes on over errors from the checkpoint that it left."""
    b = made(spark, sf, _BATCH)
    outcome = lambda d: d.join(b.select("ingest_id", "accepted", "error"), "ingest_id")
    envelopes = b.select("ingest_id", "position")
    first, done, _ = intake.ingested(envelopes, b.where("event_id % 3 = 0").select("ingest_id"), outcome, 400)
    second, _, _ = intake.ingested(envelopes, done, outcome, 300, True)
    return first.select("ingest_id", F.lit("first").alias("run"), "status").unionByName(second.select("ingest_id", F.lit("second").alias("run"), "status"))


@query(
    """WITH RECURSIVE r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey // 2 END AS parent FROM customer), gone(id, cascaded) AS (SELECT id, false FROM r WHERE id % 97 = 5 UNION SELECT r.id, true FROM r JOIN gone g ON r.parent = g.id),
g AS (SELECT id, bool_and(cascaded) AS cascaded FROM gone GROUP BY id) SELECT 'record' AS what, CAST(id AS VARCHAR) AS id, cascaded FROM g UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_custkey IN (SELECT id FROM g) OR o_custkey + 1 IN (SELECT id FROM g)"""
)
def erasure_audit(spark, sf) -> DataFrame:
    """Customers that are erased with those below them, and the orders that name them or the one before."""
    records = made(spark, sf, "SELECT CAST(c_custkey AS VARCHAR(20)) AS id, 'tenant_id=t' AS namespace, CASE WHEN c_custkey % 3 > 0 THEN CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS VARCHAR(20)) END AS parent_id FROM customer")
    orders = t.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("a"), (F.col("o_custkey") + 1).cast("string").alias("b"))
    removed, entries = intake.erasure_audit(records, {"order": (orders, ["a", "b"], "o_orderkey")}, records.where("id % 97 = 5"), "asked", F.lit("2024-01-01").cast("timestamp"))
    return removed.select(F.col("table").alias("what"), F.col("removed_id").alias("id"), F.lit(None).cast("boolean").alias("cascaded")).unionByName(entries.select(F.lit("record").alias("what"), F.col("record_id").alias("id"), "cascaded"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'missing:name' WHEN p_size % 5 = 1 THEN 'choice:color' ELSE '' END AS problems, CASE WHEN p_size % 5 > 1 THEN p_name END AS title,
CASE WHEN p_size % 5 = 2 THEN 'blue' WHEN p_size % 5 > 2 THEN 'red' END AS color FROM part"""
)
def template_records(spark, sf) -> DataFrame:
    """Parts as filled forms: some without a name, some of an odd color, some without one, which then is the default."""
    p = t.table(spark, sf, "part")
    k = F.col("p_size") % 5
    fields = spark.createDataFrame([("t", "name", True, None), ("t", "color", False, ["red", "blue"]), ("t", "title", False, None)], "template string, name string, required boolean, choices array<string>")
    entry = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
    values = F.map_from_entries(F.array(entry("name", F.when(k > 0, F.col("p_name"))), entry("title", F.col("p_name")), entry("color", F.when(k == 1, "pink").when(k > 2, "red"))))
    forms = p.select(F.col("p_partkey").alias("form_id"), F.lit("t").alias("template"), values.alias("values"))
    records, plan = policy.template_applied(forms, fields, {"color": "blue", "other": "x"}, F.lit("2024-01-01").cast("timestamp"))
    ids = forms.select("form_id", F.sha2(F.concat_ws("|", "template", F.col("form_id").cast("string")).cast("binary"), 256).alias("id"))
    good = records.join(ids, "id").select(F.col("form_id").alias("p_partkey"), F.lit("").alias("problems"), "title", F.col("properties")["color"].alias("color"))
    return good.unionByName(plan.select(F.col("form_id").alias("p_partkey"), F.array_join("problems", ",").alias("problems")), allowMissingColumns=True)


@query("SELECT c_custkey, c_nationkey, c_name, c_acctbal FROM customer")
def sealed_and_bound(spark, sf) -> DataFrame:
    """Customers' names and balances sealed, bound to their key and nation, and opened again."""
    c = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal")
    key = bytes(range(32))
    return bundles.opened(bundles.sealed(c, key, ["c_name", "c_acctbal"], ["c_custkey", "c_nationkey"]), key, "c_name string, c_acctbal double", ["c_custkey", "c_nationkey"])


@query("SELECT 'size' AS property, 'int,str' AS types UNION ALL SELECT 'brand', 'bool,str' FROM (SELECT count(*) AS n FROM part WHERE p_brand IS NULL OR p_size = 7) WHERE n > 0")
def schema_conflicts(spark, sf) -> DataFrame:
    """Properties of parts that have several types: sizes as numbers and texts, brands as texts and flags."""
    p = t.table(spark, sf, "part")
    size = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("n"), "p_size")).otherwise(F.col("p_size").cast("string"))
    brand = F.when(F.col("p_size") == 7, "true").otherwise(F.col("p_brand"))
    records = p.select(F.lit("part").alias("type"), F.create_map(F.lit("size"), size, F.lit("brand"), brand, F.lit("name"), F.col("p_name")).alias("properties"))
    relations = spark.createDataFrame([], "relation_type string")
    return context.schema_conflicts(context.described(records, relations)).select("property", F.array_join("types", ",").alias("types"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'doc' ELSE p_brand END AS brand, CASE WHEN p_size % 3 = 0 THEN 'own' WHEN p_size % 2 = 0 THEN 'doc' ELSE p_type END AS kind, p_size % 3 = 0 AS is_own, p_size % 2 = 0 AS has_tag, p_size % 5 > 0 AS not_seven FROM part"""
)
def property_patterns(spark, sf) -> DataFrame:
    """Properties from three maps, and tests of them: a list that contains, one of several, not equal."""
    p = t.table(spark, sf, "part")
    k = F.col("p_size")
    fields = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    document = F.when(k % 2 == 0, F.create_map(F.lit("brand"), F.lit("doc"), F.lit("kind"), F.lit("doc")))
    own = F.when(k % 3 == 0, F.create_map(F.lit("kind"), F.lit("own")))
    lists = F.create_map(F.lit("tags"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("ab"))))
    merged = p.select("p_partkey", explorer.explorer_properties(fields, document, own).alias("m"), lists.alias("l"), F.create_map(F.lit("five"), (k % 5).cast("string")).alias("f"))
    test = explorer.predicate
    return merged.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["kind"].alias("kind"), test(F.col("m"), "kind", "in", ["own", "none"]).alias("is_own"), test(F.col("m"), "tags", "contains", "b", F.col("l")).alias("has_tag"), test(F.col("f"), "five", "ne", 0).alias("not_seven"))

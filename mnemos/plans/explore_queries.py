"""Queries over exploration, retrieval, context modes, communities, governance, imports and projections, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.operators import context as c
from mnemos.operators import explorer as x
from mnemos.operators import graph as g
from mnemos.operators import policy, upkeep
from mnemos.operators import retrieval as r
from mnemos.plans.graph_queries import _BOTH, _EDGES, _KEYWORD, _NODES, _RECENT, _TRUSTED, _VECTOR, _first, _fusion
from mnemos.plans.record_queries import _CHANGES, _RECORDS
from mnemos.plans.typed_queries import made
from mnemos.sources import bundles
from mnemos.sources import tables as t
from mnemos.streaming import changes as ch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Exploration


@query(f"WITH {_RECORDS} SELECT id, 1 + 0.25 * (CAST(contains(lower(title), 'document 1') AS INT) + CAST(contains(lower(content), 'document 1') AS INT)) AS score, CASE WHEN contains(lower(title), 'document 1') THEN 'title' ELSE '' END || CASE WHEN contains(lower(title), 'document 1') AND contains(lower(content), 'document 1') THEN ',' ELSE '' END || CASE WHEN contains(lower(content), 'document 1') THEN 'content' ELSE '' END AS fields FROM r")
def explorer_hits(spark, sf) -> DataFrame:
    return x.hits(t.records(spark, sf), "Document 1").select("id", F.col("score").cast("double").alias("score"), F.array_join("matched_fields", ",").alias("fields"))


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE source IN (SELECT source FROM r WHERE doc_id % 5 = 1) AND lang IN ('en', 'fr') AND doc_id % 3 = 0")
def explorer_filters(spark, sf) -> DataFrame:
    records = t.records(spark, sf)
    source = records.where("doc_id % 5 = 1").first()["source"]
    props = records.withColumn("properties", F.create_map(F.lit("third"), (F.col("doc_id") % 3 == 0).cast("string")))
    return x.filtered(props, [source], ["#EN", "fr"], {"third": "true"}).select("id")


@query(f"WITH {_RECORDS}, e AS (SELECT 'doc-' || doc_id AS src, 'doc-' || (doc_id * 2) AS dst FROM documents WHERE doc_id % 3 = 0), ok AS (SELECT * FROM e WHERE dst IN (SELECT id FROM r)) SELECT id FROM r WHERE id IN (SELECT src FROM ok) OR id IN (SELECT dst FROM ok)")
def explorer_connected(spark, sf) -> DataFrame:
    records = t.records(spark, sf)
    edges = records.where("doc_id % 3 = 0").select(F.concat(F.lit("e"), "doc_id").alias("edge_id"), F.col("id").alias("src"), F.concat(F.lit("doc-"), F.col("doc_id") * 2).alias("dst"))
    return x.connected_only(records, edges).select("id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'p' WHEN doc_id % 2 = 0 THEN 'd' ELSE 'f' END AS viewed, CASE WHEN doc_id % 5 > 0 THEN 'f' WHEN doc_id % 2 = 0 THEN 'd' WHEN doc_id % 3 = 0 THEN 'p' END AS matched, doc_id % 5 > 0 AND doc_id % 2 > 0 AND doc_id % 3 > 0 OR doc_id % 5 > 0 AS is_f FROM documents")
def property_precedence(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    one = lambda v, when: F.when(when, F.create_map(F.lit("a"), F.lit(v)))
    d = t.table(spark, sf, "documents").select("doc_id", one("f", k >= 0).alias("always"), one("f", k % 5 > 0).alias("f"), one("d", k % 2 == 0).alias("d"), one("p", k % 3 == 0).alias("p"))
    pattern = x.pattern_properties(F.col("f"), F.col("d"), F.col("p"))
    return d.select("doc_id", x.view_properties(F.col("always"), F.col("d"), F.col("p"))["a"].alias("viewed"), pattern["a"].alias("matched"), x.predicate(pattern, "a", "in", ["f"]).alias("is_f"))


@query(
    f"""WITH {_RECORDS}, n AS (SELECT id AS target_id, lower(title) AS low, title FROM r WHERE doc_id < 40 UNION ALL SELECT id, lower(lang || ' Alias'), lang || ' Alias' FROM r WHERE doc_id < 4)
SELECT r.id AS source_id, n.target_id, title AS matched_text FROM (SELECT id, doc_id, content || ' about document ' || (doc_id % 60) || ', EN alias' AS body FROM r) r JOIN n ON contains(lower(r.body), n.low) AND r.id <> n.target_id WHERE NOT (r.doc_id % 10 = 0 AND n.target_id = 'doc-0')"""
)
def unlinked_mentions(spark, sf) -> DataFrame:
    records = t.records(spark, sf)
    k = F.col("doc_id")
    bodies = records.withColumn("content", F.concat("content", F.lit(" about document "), (k % 60).cast("string"), F.lit(", EN alias")))
    names = records.where("doc_id < 40").select("id", "title", F.when(k < 4, F.array(F.concat("lang", F.lit(" Alias")))).alias("aliases"))
    links = records.where("doc_id % 10 = 0").select(F.col("id").alias("source_record_id"), F.lit("doc-0").alias("target_record_id"))
    return x.unlinked_mentions(bodies, x.mention_targets(names), links).select("source_id", "target_id", "matched_text")


@query(f"WITH {_RECORDS} SELECT id FROM r ORDER BY updated_at DESC, id LIMIT 40 OFFSET 40")
def explorer_second_page(spark, sf) -> DataFrame:
    request = {"query": "", "limit": 40, "cursor": None}
    order = [F.desc("updated_at"), F.asc("id")]
    _, cursor = x.page(t.records(spark, sf).select("id", "updated_at"), order, request, 40)
    return x.page(t.records(spark, sf).select("id", "updated_at"), order, request | {"cursor": cursor}, 40)[0].select("id")


#: A page of 60 records with the word, those of it in English, the newest of these, and its links: each document links to the next.
_PAGE = f"""{_RECORDS}, p AS (SELECT * FROM r WHERE contains(lower(concat_ws(chr(10), title, content, lang)), 'license') ORDER BY updated_at DESC, id LIMIT 60), k AS (SELECT * FROM p WHERE lang = 'en'), root AS (SELECT max(doc_id) AS d FROM k),
x AS (SELECT d AS x, 'out' AS way FROM root WHERE d IS NOT NULL UNION ALL SELECT d - 1, 'in' FROM root WHERE d - 1 IN (SELECT doc_id FROM r))"""


def _packet(spark, sf) -> dict:
    records = t.records(spark, sf)
    k = F.col("doc_id")
    links = records.select(F.concat(F.lit("l-"), k).alias("link_id"), F.col("id").alias("source_record_id"), F.concat(F.lit("doc-"), k + 1).alias("target_record_id"), F.when(k % 2 == 0, "wikilink").otherwise("embed").alias("link_kind"), F.when(k % 3 == 0, "related_to").alias("relation_type"), F.concat(F.lit("to "), k + 1).alias("raw_target"))
    edges = links.select(F.col("link_id").alias("edge_id"), F.col("source_record_id").alias("src"), F.col("target_record_id").alias("dst"))
    labels = records.select(F.col("id").alias("node_id"), F.col("source").alias("label"))
    return x.packet(records, edges, links, "License", {"tags": ["en"]}, 60, labels=labels)


@query(
    f"""WITH {_PAGE} SELECT 'source' AS field, source AS value, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'tag', lang, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'scope', scope, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'tier', tier, count(*) FROM k GROUP BY ALL
UNION ALL SELECT 'type', 'fact', count(*) FROM k HAVING count(*) > 0 UNION ALL SELECT 'orphan', 'false', count(*) + 1 FROM x HAVING count(*) > 0 UNION ALL SELECT 'link_kind', CASE WHEN x % 2 = 0 THEN 'wikilink' ELSE 'embed' END, count(*) FROM x GROUP BY ALL
UNION ALL SELECT 'relation_type', 'related_to', count(*) FROM x WHERE x % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'community', source, count(*) FROM r WHERE source IN (SELECT source FROM k) GROUP BY ALL"""
)
def explorer_packet(spark, sf) -> DataFrame:
    return _packet(spark, sf)["facets"]


@query(
    f"""WITH {_PAGE}, a AS (SELECT 'open_root' AS action, d AS id FROM root WHERE d IS NOT NULL UNION ALL SELECT 'open_hit', doc_id FROM k UNION ALL SELECT 'follow_backlink', x FROM x WHERE way = 'in' UNION ALL SELECT 'follow_outgoing_link', x + 1 FROM x WHERE way = 'out'
UNION ALL SELECT 'inspect_path', doc_id FROM k, root WHERE abs(doc_id - d) = 1 UNION ALL SELECT c, s FROM (SELECT 'doc-' AS c, 0 AS s WHERE FALSE)), c AS (SELECT source, min(id) AS seed FROM r WHERE source IN (SELECT source FROM k) GROUP BY source)
SELECT action, 'doc-' || id AS id FROM a UNION ALL SELECT 'open_community', seed FROM c UNION ALL SELECT 'filter_community', seed FROM c"""
)
def explorer_navigation(spark, sf) -> DataFrame:
    return _packet(spark, sf)["navigation"].select("action", "id")


# Retrieval and context


@query(
    f"""WITH {_RECORDS}, {_KEYWORD}, {_VECTOR.replace("FROM embeddings ORDER", "FROM embeddings WHERE 'doc-' || vec_id IN (SELECT id FROM r) ORDER")}, cand AS (SELECT id FROM kw UNION SELECT id FROM vs), {_RECENT}, {_TRUSTED}, {_fusion({'keyword': 'kw', 'vector': 'vs', 'recency': 'rec', 'trust': 'tr'})}
SELECT id, round(sum(s), 9) AS score, string_agg(kind, ',' ORDER BY kind) AS kinds FROM ranked GROUP BY id ORDER BY sum(s) DESC, id LIMIT 40"""
)
def retrieval_pipeline(spark, sf) -> DataFrame:
    hits, _ = r.assembled(t.records(spark, sf), query="license", limit=40, keyword_limit=40, embeddings=t.embeddings(spark, sf), vector=_first(spark, sf), vector_limit=20, now=F.lit("2024-01-02").cast("timestamp"), half_life_days=7, trust={"validated": 1.0, "user_said": 0.8}, default_trust=0.5)
    return hits.select("id", F.round("score", 9).alias("score"), F.array_join(F.transform("components", lambda k: k["kind"]), ",").alias("kinds"))


@query(f"WITH {_RECORDS}, k AS (SELECT * FROM r WHERE contains(lower(title || chr(10) || content || chr(10) || lang), 'license')) SELECT id, 'in' AS what FROM (SELECT id FROM k WHERE doc_id % 2 = 1 ORDER BY updated_at DESC, id LIMIT 15) UNION ALL SELECT id, 'keyword:odd_only' FROM k WHERE doc_id % 2 = 0")
def retrieval_eligibility(spark, sf) -> DataFrame:
    """Ineligible records take no places."""
    hits, omitted = r.assembled(t.records(spark, sf), query="license", limit=15, rules={"keyword": F.when(F.col("doc_id") % 2 == 0, "odd_only")})
    return hits.select("id", F.lit("in").alias("what")).unionByName(omitted.select("id", F.concat_ws(":", "stage", "reason").alias("what")))


_FOUND = f"{_RECORDS}, found AS (SELECT id, content, row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS position, doc_id FROM r WHERE lang = 'en' ORDER BY updated_at DESC, id LIMIT 50)"


def _found(spark, sf):
    from pyspark.sql import Window

    top = t.records(spark, sf).where("lang = 'en'").orderBy(F.desc("updated_at"), "id").limit(50)
    return top.select("id", "content", (F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")) - 1).alias("position"), "doc_id")  # of 50 rows


@query(f"WITH {_FOUND} SELECT id, round(1 - position / 50.0, 9) AS score, left(content, 20) AS snippet, position < 30 AS included FROM found")
def context_search(spark, sf) -> DataFrame:
    return c.search_context(_found(spark, sf), 50, 30, 20).select("id", F.round("score", 9).alias("score"), "snippet", "included")


@query("SELECT 'fact-' || o_orderkey AS id, (o_orderkey % 100) / 100.0 AS score, row_number() OVER (ORDER BY strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d'), 'fact-' || o_orderkey) <= 25 AS included FROM orders WHERE o_custkey = 7")
def context_facts(spark, sf) -> DataFrame:
    return c.fact_context(t.facts(spark, sf).where("subject_entity_id = 'cust-7'"), 25).select("id", "score", "included")


@query(
    f"""WITH {_FOUND}, i AS (SELECT id, 'record' AS kind, greatest(1 - position / 50.0, CASE WHEN doc_id % 4 = 0 THEN 0.9 ELSE 0 END) AS score, 0 AS late, position FROM found
UNION ALL SELECT 'f' || doc_id, 'fact', CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.8 END, 1, position FROM found WHERE doc_id % 2 = 0)
SELECT id, kind, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, late, position, id) <= 40 AS included FROM i"""
)
def context_hybrid(spark, sf) -> DataFrame:
    f = _found(spark, sf)
    k = F.col("doc_id")
    facts = f.where(k % 2 == 0).select(F.concat(F.lit("f"), k).alias("fact_id"), F.col("id").alias("record_id"), F.when(k % 3 > 0, 0.8).alias("confidence"))
    return c.hybrid_context(f, f.where(k % 4 == 0).select("id", F.lit(0.9).alias("value")), facts, 50, 40, 20).select("id", "kind", F.round("score", 9).alias("score"), "included")


@query(
    """WITH s AS (SELECT 's' || r_regionkey AS id, r_name AS text, r_regionkey AS k FROM region), st AS (SELECT c_custkey AS step, CASE WHEN c_custkey % 2 = 0 THEN 'summary' ELSE 'record' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN 's' || (c_custkey % 8) ELSE 'doc-' || (c_custkey % 30) END AS id FROM customer WHERE c_custkey <= 60),
a AS (SELECT 'summary' AS kind, 's3' AS id, -1000000 AS p UNION ALL SELECT kind, id, step FROM st), f AS (SELECT kind, id, min(p) AS p FROM a GROUP BY ALL), i AS (SELECT f.*, text AS snippet FROM f JOIN s USING (id) WHERE kind = 'summary' UNION ALL SELECT f.*, text FROM f JOIN documents d ON f.id = 'doc-' || doc_id WHERE kind = 'record')
SELECT id, kind, snippet, row_number() OVER (ORDER BY p, id) <= 12 AS included FROM i"""
)
def context_drift(spark, sf) -> DataFrame:
    steps = made(spark, sf, "SELECT c_custkey AS step, CASE WHEN c_custkey % 2 = 0 THEN 'summary' ELSE 'record' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN 's' || (c_custkey % 8) ELSE 'doc-' || (c_custkey % 30) END AS id FROM customer WHERE c_custkey <= 60")
    summaries = made(spark, sf, "SELECT 's' || r_regionkey AS summary_id, r_name AS text FROM region")
    return c.drift_context(steps, spark.createDataFrame([(0, "s3")], "position int, summary_id string"), summaries, t.records(spark, sf), 12).select("id", "kind", "snippet", "included")


@query(
    """WITH w(position, id) AS (VALUES (1, 's2'), (2, 's9'), (3, 's0'), (4, 's4')), i AS (SELECT 's' || r_regionkey AS id, r_name AS snippet, position FROM region JOIN w ON id = 's' || r_regionkey)
SELECT id, kind, snippet, n <= 3 AS included FROM (SELECT id, 'summary' AS kind, snippet, row_number() OVER (ORDER BY position) AS n FROM i WHERE position <= 3 OR position = 4 AND FALSE UNION ALL SELECT 'c1', 'community', 'of s2', 3 UNION ALL SELECT 'c2', 'community', 'of s0', 4)"""
)
def context_with_communities(spark, sf) -> DataFrame:
    wanted = spark.createDataFrame([(1, "s2"), (2, "s9"), (3, "s0"), (4, "s4")], "position int, summary_id string")
    summaries = made(spark, sf, "SELECT 's' || r_regionkey AS summary_id, r_name AS text FROM region")
    more = spark.createDataFrame([("c1", "community", 0.9, "of s2", 1), ("c2", "community", 0.8, "of s0", 2)], "id string, kind string, score double, snippet string, position int")
    return c.with_communities(c.summary_references(wanted, summaries, 2), more, 3).select("id", "kind", "snippet", "included")


@query("SELECT 'm' || doc_id AS memory_id, CASE doc_id % 4 WHEN 0 THEN 'trusted_retrieval' WHEN 1 THEN 'narrow_retrieval' END AS reason, CASE doc_id % 4 WHEN 2 THEN 'trust_state_candidate' WHEN 3 THEN 'trust_state_suppressed' END AS omitted_reason, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 0 END AS n FROM documents")
def memory_packets(spark, sf) -> DataFrame:
    states = F.element_at(F.array(*map(F.lit, ("trusted", "provisional", "candidate", "suppressed"))), (F.col("doc_id") % 4 + 1).cast("int"))
    m = t.table(spark, sf, "documents").select(F.concat(F.lit("m"), "doc_id").alias("memory_id"), states.alias("trust_state"), F.array(F.col("doc_id").cast("string")).alias("refs"))
    return c.memory_packets(m, True).select("memory_id", "reason", "omitted_reason", F.size("refs").alias("n"))


@query("SELECT turn, count(*) AS n, CASE turn % 5 WHEN 0 THEN 'unknown_kind' WHEN 1 THEN 'claim_required' WHEN 2 THEN 'polarity_required' WHEN 3 THEN 'polarities_agree' END AS refusal FROM conversations GROUP BY ALL")
def block_disagreements(spark, sf) -> DataFrame:
    k = F.col("turn") % 5
    s = t.table(spark, sf, "conversations").select("turn", F.when(k == 0, "other").otherwise("claim_key_polarity").alias("kind"), F.lit("b").alias("block_id"), F.lit("r").alias("record_id"), F.when(k > 1, "c").alias("claim_key"), F.when(k > 2, "yes").alias("block_polarity"), F.when(k == 3, "yes").otherwise("no").alias("retrieval_polarity"))
    return c.disagreements(s).groupBy("turn", "refusal").agg(F.count("*").alias("n"))


# Graphs and communities


@query(
    f"""WITH RECURSIVE {_EDGES}, {_BOTH}, reach(id, d) AS (SELECT 'n1', 0 UNION SELECT v, d + 1 FROM reach JOIN b ON u = id WHERE d < 2), near AS (SELECT id, min(d) AS d FROM reach GROUP BY id ORDER BY 2, 1 LIMIT 90),
met AS (SELECT edge, min(d) AS d FROM b JOIN near ON u = id WHERE d < 2 GROUP BY edge), kept AS (SELECT src, dst FROM e JOIN met ON edge = src || '>' || dst ORDER BY met.d, edge LIMIT 60)
SELECT id AS node_id, d AS depth, CAST((SELECT count(*) FROM kept WHERE dst = id) AS BIGINT) AS in_degree, CAST((SELECT count(*) FROM kept WHERE src = id) AS BIGINT) AS out_degree FROM near"""
)
def local_snapshot(spark, sf) -> DataFrame:
    return g.local_snapshot(t.edges(spark, sf), "n1", 2, 90, 60)[0]


@query(f"WITH {_NODES}, {_EDGES}, d AS (SELECT src, CASE WHEN dst = 'n3' THEN NULL ELSE dst END AS dst, src || '>' || dst AS edge FROM e), k AS (SELECT id FROM n ORDER BY id LIMIT 400), kept AS (SELECT * FROM d WHERE src IN (SELECT id FROM k) AND (dst IS NULL OR dst IN (SELECT id FROM k)) ORDER BY edge LIMIT 250), x AS (SELECT id, CAST((SELECT count(*) FROM kept WHERE dst = id) AS BIGINT) AS in_degree, CAST((SELECT count(*) FROM kept WHERE src = id AND dst IS NOT NULL) AS BIGINT) AS out_degree FROM k) SELECT id AS node_id, in_degree, out_degree FROM x WHERE in_degree + out_degree > 0")
def snapshot_with_dangling(spark, sf) -> DataFrame:
    e = t.edges(spark, sf).withColumn("dst", F.when(F.col("dst") != "n3", F.col("dst")))
    return g.snapshot(t.nodes(spark, sf), e, 400, 250, True, False)[0].select("node_id", "in_degree", "out_degree")


_LABELS = "l AS (SELECT id, 'x' || (length(id) % 3) AS label FROM (SELECT src AS id FROM e UNION SELECT dst FROM e))"


def _labels(spark, sf):
    e = t.edges(spark, sf)
    ends = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    return ends.withColumn("label", F.concat(F.lit("x"), F.length("node_id") % 3))


@query(f"WITH {_EDGES}, {_LABELS}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT label, CAST(count(*) AS INTEGER) AS size, arg_min(id, (-n, id)) AS seed FROM l JOIN d USING (id) GROUP BY label HAVING count(*) >= 2")
def community_seeds(spark, sf) -> DataFrame:
    return g.communities(_labels(spark, sf), t.edges(spark, sf)).select("label", "size", "seed")


@query(f"WITH {_CHANGES}, s AS (SELECT * FROM c WHERE cursor > 300 AND object_type IN ('record', 'relation', 'link')) SELECT count(*) > 0 AS stale, max(cursor) AS latest_cursor, string_agg(DISTINCT object_type, ',' ORDER BY object_type) AS reasons FROM s")
def community_status(spark, sf) -> DataFrame:
    return g.community_status(t.changes(spark, sf), 300).select("stale", "latest_cursor", F.array_join("stale_reasons", ",").alias("reasons"))


@query(f"WITH {_EDGES}, {_LABELS}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT id, label, CAST(n + CASE WHEN id LIKE 'n%' THEN 0.1 ELSE 0 END AS DOUBLE) AS score FROM l JOIN d USING (id) WHERE label IN ('x2', 'x0') ORDER BY id LIMIT 80")
def community_hits(spark, sf) -> DataFrame:
    records = t.nodes(spark, sf).select(F.col("node_id").alias("id"), F.when(F.col("label") == "nation", "s1").alias("source_id"), F.lit(1).alias("updated_at"))
    return g.community_hits(_labels(spark, sf), records, t.edges(spark, sf), ["x2", "x0"], 80)


@query(
    f"""WITH RECURSIVE {_EDGES}, {_BOTH}, {_LABELS}, s(label, seed) AS (VALUES ('x2', 'n1'), ('x0', 's10')), ask AS (SELECT seed AS source, id AS target FROM l JOIN s USING (label) WHERE id <> seed),
p(source, id, hops) AS (SELECT seed, seed, CAST([] AS STRUCT(node VARCHAR, edge VARCHAR)[]) FROM s UNION ALL SELECT source, v, list_append(hops, {{'node': v, 'edge': edge}}) FROM p JOIN b ON u = id WHERE len(hops) < 2 AND v <> source AND NOT list_contains(list_transform(hops, lambda x: x.node), v)),
first AS (SELECT source, id, hops, row_number() OVER (PARTITION BY source, id ORDER BY hops[1:len(hops) - 1], hops[len(hops)].edge DESC) AS n FROM p WHERE len(hops) > 0)
SELECT first.source, id AS target, array_to_string(list_transform(hops, lambda x: x.node), ',') AS path FROM first JOIN ask ON ask.source = first.source AND target = id WHERE n = 1"""
)
def community_paths(spark, sf) -> DataFrame:
    seeds = spark.createDataFrame([("x2", "n1"), ("x0", "s10")], "label string, seed string")
    return g.community_paths(_labels(spark, sf), seeds, t.edges(spark, sf)).select("source", "target", F.concat_ws(",", F.transform("hops", lambda h: h["node"])).alias("path"))


@query(f"WITH {_EDGES}, {_LABELS}, {_NODES} SELECT n.id AS node_id, label, CAST((SELECT count(*) FROM e WHERE src = n.id) + (SELECT count(*) FROM e WHERE dst = n.id) AS DOUBLE) AS weight FROM n LEFT JOIN l USING (id)")
def layout_hints(spark, sf) -> DataFrame:
    return g.layout(_labels(spark, sf), t.nodes(spark, sf), t.edges(spark, sf)).select("node_id", "label", "weight")


@query("SELECT CAST(count(*) AS BIGINT) AS orphans FROM part WHERE 'p' || p_partkey NOT IN (SELECT 'p' || l_partkey FROM lineitem)")
def orphan_cluster(spark, sf) -> DataFrame:
    nodes = t.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"))
    return g.orphans(nodes, t.supply_edges(spark, sf)).agg(F.count("*").alias("orphans"))


# Governance


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'deny' WHEN doc_id % 5 = 0 THEN 'deny' ELSE 'allow' END AS action, CASE WHEN doc_id % 3 = 0 THEN 'first' WHEN doc_id % 5 = 0 THEN 'second' ELSE '<aggregate>' END AS policy_id, CASE WHEN doc_id % 3 = 0 THEN 'threes' WHEN doc_id % 5 = 0 THEN 'fives' END AS reason_code FROM documents")
def policy_hooks(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    return policy.hook_decision(t.table(spark, sf, "documents").select("doc_id"), [("first", F.when(k % 3 == 0, "threes")), ("second", F.when(k % 5 == 0, "fives"))])


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE project_id IN ('src1', 'src2') ORDER BY id LIMIT 70")
def gateway_records(spark, sf) -> DataFrame:
    schema = "actor string, operation string, allowed boolean, reason string, namespaces array<string>, max_results int"
    decisions = spark.createDataFrame([("a", "list", True, None, ["src1", "src2"], 70), ("a", "list", False, "grant_expired", None, None), ("b", "list", True, None, None, None)], schema)
    return policy.behind_gateway(t.records(spark, sf).withColumn("namespace", F.col("project_id")), decisions, "a", "list", F.lit("2024-01-01").cast("timestamp"))[0].select("id")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'memory.done' ELSE 'memory.open' END AS event_type, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY ALL")
def audit_events(spark, sf) -> DataFrame:
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    events = policy.audit_events(o, F.when(F.col("o_orderstatus") == "F", "memory.done").otherwise("memory.open"), F.col("o_orderkey").cast("string"), F.lit("2024-01-01").cast("timestamp"), ["o_orderpriority"])
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN '[redacted]' ELSE lang END AS lang, doc_id % 3 = 0 AS closed, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 AND doc_id % 7 = 0 THEN 'hidden' ELSE 'visible' END AS visibility FROM documents WHERE doc_id % 2 > 0")
def retention_applied(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    d = t.table(spark, sf, "documents").select("doc_id", "lang", (k % 2 == 0).alias("erase"), (k % 3 == 0).alias("tombstone"), (k % 5 == 0).alias("redact"), (k % 7 == 0).alias("hide"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("visible").alias("retrieval_visibility"))
    out = policy.retained(d, F.lit("2024-01-01").cast("timestamp"), ["lang"])
    return out.select("doc_id", "lang", F.col("valid_to").isNotNull().alias("closed"), F.col("retrieval_visibility").alias("visibility"))


_FIELDS = "SELECT DISTINCT p_brand AS field FROM part WHERE p_size < 20"
_MAPPINGS = "SELECT p_brand AS source_field, concat('to-', p_brand) AS target_field, min(p_retailprice) < 950 AS lossy, max(p_size) > 45 AS required FROM part WHERE p_retailprice > 940 AND p_partkey % 3 = 0 GROUP BY p_brand"


@query(
    f"""WITH f AS ({_FIELDS}), m AS ({_MAPPINGS})
SELECT field, (SELECT target_field FROM m WHERE source_field = field) AS target, CASE WHEN field NOT IN (SELECT source_field FROM m) THEN 'unknown_field' WHEN field IN (SELECT source_field FROM m WHERE lossy) THEN 'lossy_field' END AS diagnostic FROM f
UNION ALL SELECT source_field, NULL, 'required_missing' FROM m WHERE required AND source_field NOT IN (SELECT field FROM f)"""
)
def profile_mapping(spark, sf) -> DataFrame:
    return policy.profile_plan(made(spark, sf, _FIELDS), made(spark, sf, _MAPPINGS))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing:name' WHEN doc_id % 4 = 1 THEN 'choice:color' WHEN doc_id % 4 = 2 THEN 'unknown:more' ELSE '' END AS problems FROM documents")
def template_forms(spark, sf) -> DataFrame:
    fields = spark.createDataFrame([("t", "name", True, None), ("t", "color", False, ["red", "blue"])], "template string, name string, required boolean, choices array<string>")
    k = F.col("doc_id") % 4
    entry = lambda key, v: F.struct(F.lit(key).alias("key"), F.lit(v).alias("value"))
    values = F.map_from_entries(F.array_compact(F.array(F.when(k != 0, entry("name", "n")), entry("color", "red").withField("value", F.when(k == 1, "pink").otherwise("red")), F.when(k == 2, entry("more", "x")))))
    return policy.template_plan(t.table(spark, sf, "documents").select(F.col("doc_id").alias("form_id"), F.lit("t").alias("template"), values.alias("values")), fields).select(F.col("form_id").alias("doc_id"), F.array_join("problems", ",").alias("problems"))


# Upkeep, imports and projections


@query("SELECT 'b' || s_suppkey AS block_id, CASE WHEN s_suppkey % 4 = 0 THEN 'stale' WHEN s_suppkey % 7 = 0 THEN 'stale' ELSE 'fresh' END AS status FROM supplier")
def shared_mirrors(spark, sf) -> DataFrame:
    b = made(spark, sf, "SELECT 'b' || s_suppkey AS block_id, 'h' || s_suppkey AS hash, s_suppkey FROM supplier")
    m = b.select("block_id", F.when(F.col("s_suppkey") % 4 == 0, "old").otherwise(F.col("hash")).alias("mirror_hash"))
    return upkeep.mirrored(m, b.where("s_suppkey % 7 > 0")).select("block_id", "status")


@query("SELECT 'b' || s_suppkey AS block_id FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0")
def shared_conflicts(spark, sf) -> DataFrame:
    b = made(spark, sf, "SELECT 'b' || s_suppkey AS block_id, 'h' || s_suppkey AS hash, s_suppkey FROM supplier")
    k = F.col("s_suppkey")
    edits = b.select("block_id", F.lit("me").alias("attempted_by"), F.when(k % 3 == 0, "older").otherwise(F.col("hash")).alias("base_hash"), F.when(k % 2 == 0, "new").otherwise(F.col("hash")).alias("proposed_hash"))
    return upkeep.shared_conflicts(edits, b).select("block_id")


@query("SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'create' WHEN p_partkey % 5 = 1 THEN 'delete' ELSE 'update' END AS action FROM part WHERE p_partkey % 5 < 3")
def workspace_restore(spark, sf) -> DataFrame:
    p = made(spark, sf, "SELECT 'p' || p_partkey AS path, 'h' || p_partkey AS content_hash, p_partkey FROM part")
    k = F.col("p_partkey") % 5
    return upkeep.restored(p.where(k != 0), p.where(k != 1).withColumn("content_hash", F.when(k == 2, "x").otherwise(F.col("content_hash"))), "path")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'active_to_cooling' ELSE 'cooling_to_archived' END AS transition, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def consolidation_summary(spark, sf) -> DataFrame:
    s = F.col("o_orderstatus")
    d = t.table(spark, sf, "orders").select(F.when(s == "F", "active").otherwise("cooling").alias("phase"), F.when(s == "F", "cooling").when(s == "O", "archived").otherwise("cooling").alias("next_phase"))
    return upkeep.consolidation_summary(d)


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 3 > 0 AND page_id % 5 > 0 THEN 'skip' ELSE 'accept' END AS decision FROM pages")
def connector_decisions(spark, sf) -> DataFrame:
    k = F.col("page_id")
    items = t.table(spark, sf, "pages").select("page_id", F.concat(F.lit("s"), k).alias("source_id"), F.lit("h").alias("content_hash"))
    ledger = items.where(k % 2 == 0).select("source_id", F.when(k % 3 == 0, "other").otherwise("h").alias("content_hash"), F.when(k % 5 == 0, "failed").otherwise("ok").alias("status"))
    return upkeep.accepted(items, ledger).select("page_id", "decision")


@query("SELECT DISTINCT 'i' || (event_id % 700) AS item_id FROM events WHERE event_id % 700 >= 200")
def ingest_rest(spark, sf) -> DataFrame:
    items = made(spark, sf, "SELECT 'i' || (event_id % 700) AS item_id FROM events")
    return upkeep.to_ingest(items, spark.range(200).select(F.concat(F.lit("i"), "id").alias("item_id")))


@query(f"WITH {_RECORDS} SELECT id, CASE WHEN project_id = 'src3' THEN 'outside' WHEN doc_id % 3 = 0 THEN 'skip' ELSE 'create' END AS action, CASE WHEN scope = 'project:src1' THEN 'project:new' ELSE scope END AS scope FROM r")
def snapshot_import(spark, sf) -> DataFrame:
    rows = t.records(spark, sf).select("id", "scope", "project_id", "doc_id")
    named = [{"project_id": r["project_id"]} for r in rows.select("project_id").distinct().where("project_id <> 'src3'").collect()]
    _, plan = bundles.imported(rows.where("doc_id % 3 = 0"), rows, {"project:src1": "project:new"}, named)
    return plan.join(rows.select("id", F.when(F.col("scope") == "project:src1", "project:new").otherwise(F.col("scope")).alias("scope")), "id")


@query("SELECT 'r' || k AS id, v FROM (SELECT event_id % 300 AS k, arg_max(event_id, event_id) AS v FROM events WHERE event_id >= 500 GROUP BY 1) WHERE v % 4 > 0 UNION ALL SELECT 'old' || r_regionkey, r_regionkey FROM region")
def delta_import(spark, sf) -> DataFrame:
    e = made(spark, sf, "SELECT event_id AS cursor, 'r' || (event_id % 300) AS object_id, CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'put' END AS operation, event_id AS v FROM events WHERE event_id >= 500")
    events = e.select("cursor", "object_id", "operation", F.to_json(F.struct("v")).alias("payload"))
    had = made(spark, sf, "SELECT 'old' || r_regionkey AS id, CAST(r_regionkey AS BIGINT) AS v FROM region").unionByName(e.select(F.col("object_id").alias("id"), F.lit(-1).cast("long").alias("v")).distinct())
    return bundles.delta_applied(had, events, "v long")


@query("SELECT 'nation' AS section, CAST(count(*) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS warnings FROM nation UNION ALL SELECT 'records', count(*), count(*) FILTER (doc_id % 4 > 0) FROM documents")
def bundle_review(spark, sf) -> DataFrame:
    records = t.records(spark, sf).select("id", "doc_id", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("e"))).alias("evidence_refs"))
    return bundles.review({"records": records, "nation": t.table(spark, sf, "nation")}).select("section", "row_count", "warnings")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def row_codec(spark, sf) -> DataFrame:
    d = t.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return bundles.decoded(bundles.encoded(d, "c_custkey"), "c_custkey long, c_name string, c_acctbal double")


@query("SELECT 'ns' AS namespace_key, 'before' AS name, 'region' AS \"table\", CAST(count(*) AS BIGINT) AS row_count FROM region UNION ALL SELECT 'ns', 'before', 'nation', count(*) FROM nation")
def retention_snapshots(spark, sf) -> DataFrame:
    none = spark.createDataFrame([("ns", "other")], "namespace_key string, name string")
    return bundles.retention_snapshot({n: t.table(spark, sf, n) for n in ("region", "nation")}, "ns", "before", none, F.lit("2024-01-01").cast("timestamp")).select("namespace_key", "name", "table", "row_count")


@query("SELECT 'p' || (vec_id % 90) AS point_id, CASE WHEN max(vec_id) % 5 = 0 THEN 'delete' WHEN max(vec_id) % 3 = 0 THEN 'unavailable' ELSE 'upsert' END AS action, max(vec_id) AS cursor FROM embeddings GROUP BY 1")
def vector_projection(spark, sf) -> DataFrame:
    e = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("cursor"), F.concat(F.lit("p"), F.col("vec_id") % 90).alias("object_id"), F.when(F.col("vec_id") % 5 == 0, "delete").otherwise("put").alias("operation"), F.lit("embedding").alias("object_type"), F.concat(F.lit("doc-"), "vec_id").alias("record_id"), F.lit("s").alias("vector_space"))
    vectors = t.embeddings(spark, sf).where("vec_id % 3 > 0").select("record_id", F.lit("s").alias("vector_space"), "vector")
    return ch.vector_changes(e, vectors).select("point_id", "action", "cursor")


@query(f"WITH {_CHANGES} SELECT cursor FROM c WHERE cursor <= 20 OR cursor % 50 = 0")
def projection_order(spark, sf) -> DataFrame:
    c_ = t.changes(spark, sf).select("cursor")
    return ch.out_of_order(c_.unionByName(c_.where("cursor % 50 = 0")), 20)


@query(f"WITH {_CHANGES} SELECT cursor, event_id, CASE WHEN cursor = 130 THEN 'dead_letter' WHEN cursor = 150 THEN 'wait' WHEN cursor > 150 THEN 'blocked' ELSE 'apply' END AS decision FROM c WHERE cursor > 100 ORDER BY cursor LIMIT 80")
def projection_batch(spark, sf) -> DataFrame:
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    failures = spark.createDataFrame([("ev-129", 8, "2024-01-01 00:00:00"), ("ev-119", 2, "2024-01-01 00:09:00"), ("ev-149", 6, "2024-01-01 00:09:50")], "event_id string, failed_attempts int, at string")
    return ch.batch_plan(t.changes(spark, sf), failures.select("event_id", "failed_attempts", F.col("at").cast("timestamp").alias("failed_at")), 100, 80, now)


@query(f"WITH {_CHANGES} SELECT 149 AS checkpoint, count(*) FILTER (cursor <> 130) AS applied, CAST(1 AS BIGINT) AS dead_letters FROM c WHERE cursor > 100 AND cursor < 150")
def projection_after_batch(spark, sf) -> DataFrame:
    return ch.after_batch(projection_batch(spark, sf), 100).select(F.col("checkpoint").cast("int").alias("checkpoint"), "applied", "dead_letters")

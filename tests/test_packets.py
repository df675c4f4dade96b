"""Packages, the gateway, intake, seals and numbers in ranges: what queries over the given tables don't reach."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemos.operators import audit, graph, intake, packages, ranges
from mnemos.operators.gateway import AccessDenied, Gateway
from mnemos.sources import bundles


def decision(**given):
    return Row(**({"allowed": True, "reason": "allowed", "namespaces": [Row(project_id="p")], "workspace_ids": None, "record_types": None, "max_results": 2, "max_context_tokens": None} | given))


@pytest.fixture(scope="module")
def records(spark):
    rows = [("a", "p", "fact", "one"), ("b", "p", "note", "two"), ("c", "q", "fact", "three"), ("d", "p", "fact", "four"), ("e", None, "fact", "five")]
    return spark.createDataFrame(rows, "id string, project_id string, type string, content string").withColumns({"scope": F.lit("s"), "tier": F.lit("t"), "title": F.col("id"), "key": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "entities": F.array().cast("array<string>"), "updated_at": F.lit("2024-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})


def test_a_gateway_narrows_before_it_counts(spark, records):
    ids = ("project_id",)
    see = lambda **d: Gateway(decision(**d), ids)
    names = lambda df: [r.id for r in df.collect()]
    assert names(see().list(records)) == ["a", "b"] and names(see().list(records, limit=5, offset=1)) == ["b"] and names(see().list(records, offset=2)) == []
    assert names(see(record_types=["fact"]).list(records)) == ["a", "d"] and names(see(record_types=[]).list(records)) == [] and names(see(namespaces=[], max_results=None).list(records)) == []
    assert sorted(names(see(namespaces=None, max_results=None).list(records))) == ["a", "b", "c", "d", "e"]
    assert names(see().get(records, "c")) == [] and names(see().get(records, "a")) == ["a"] and names(see(allowed=False).get(records, "a")) == []
    for call in (lambda g: g.list(records), lambda g: g.search(records, "x"), lambda g: g.put(records, records)):
        with pytest.raises(AccessDenied, match="grant_expired"):
            call(see(allowed=False, reason="grant_expired"))
    with pytest.raises(AccessDenied, match="selector_denied"):
        see().put(records, records.where("id = 'c'"))
    changed = see().put(records, records.where("id = 'a'").withColumn("content", F.lit("new")))
    assert {r.id: r.content for r in changed.collect()}["a"] == "new" and changed.count() == 5
    links = spark.createDataFrame([("l1", "a", "b"), ("l2", "a", "c"), ("l3", "d", "a"), ("l4", "a", None), ("l5", "c", "a")], "link_id string, source_record_id string, target_record_id string")
    got = lambda d, **o: [r.link_id for r in see(**o).links(records, links, "a", d).collect()]
    assert got("both", max_results=None) == ["l1", "l3", "l4"] and got("in", max_results=None) == ["l3"] and got("both") == ["l1", "l3"]
    assert see().links(records, links, "c").count() == 0
    edges = links.select(F.col("link_id").alias("edge_id"), F.col("source_record_id").alias("src"), F.col("target_record_id").alias("dst")).where("dst is not null")
    near, kept = see(max_results=None).graph(records, edges, "a", 2)
    assert sorted(r.node_id for r in near.collect()) == ["a", "b", "d"] and [r.edge_id for r in kept.collect()] == ["l1", "l3"]
    hits = spark.createDataFrame([("w1", 1, "a", 0.5), ("w2", 1, "b", 0.5)], "workspace string, position int, id string, score double")
    assert names(see(workspace_ids=["w2"]).federated(hits, 5)) == ["b"]
    with pytest.raises(AccessDenied, match="workspace_denied"):
        see(workspace_ids=["w3"]).federated(hits, 5)


def test_a_seal_is_bound_to_other_columns(spark):
    key = bytes(range(32))
    d = spark.createDataFrame([(1, "n1", "secret")], "id int, space string, said string")
    shut = bundles.sealed(d, key, ["said"], ["id", "space"])
    assert bundles.opened(shut, key, "said string", ["id", "space"]).first().said == "secret"
    with pytest.raises(Exception, match="AES|decrypt|Tag|tag"):
        bundles.opened(shut.withColumn("space", F.lit("n2")), key, "said string", ["id", "space"]).collect()


def test_batches_stop_or_go_on(spark):
    e = spark.createDataFrame([(f"i{k}", k) for k in range(8)], "ingest_id string, position int")
    outcome = lambda d: d.withColumns({"accepted": F.col("position") % 2 == 0, "error": F.when(F.col("position").isin(3, 5), "E")})
    none = e.limit(0).select("ingest_id")
    said = lambda r: sorted((x.position, x.status) for x in r.collect())
    first, done, whole = intake.ingested(e, none, outcome)
    assert said(first) == [(0, "accepted"), (1, "skipped"), (2, "accepted"), (3, "failed")] and sorted(x.ingest_id for x in done.collect()) == ["i0", "i1", "i2"] and not whole
    second, done, whole = intake.ingested(e, done, outcome, continue_on_error=True)
    assert [p for p, s in said(second) if s == "failed"] == [3, 5] and done.count() == 6 and not whole
    third, done, whole = intake.ingested(e, done, lambda d: d.withColumns({"accepted": F.lit(True), "error": F.lit(None).cast("string")}), 5)
    assert said(third) == [(3, "accepted"), (5, "accepted")] and whole


def test_numbers_in_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["x", "y", None]), r.randrange(20), i) for i in range(300)]
    got = ranges.numbered(spark.createDataFrame(rows, "g string, v int, id int").repartition(5), ["g"], [F.desc("v"), F.asc("id")], "n", 7).collect()
    want = {}
    for g in {x[0] for x in rows}:
        for n, (_, _, i) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))):
            want[i] = n + 1
    assert {x.id: x.n for x in got} == want and len(got) == 300


def test_searches_for_targets_go_no_further(spark):
    edges = spark.createDataFrame([(f"e{i:02d}", f"v{i:02d}", f"v{i + 1:02d}") for i in range(12)] + [("x1", "v01", "dead"), ("x2", "dead", "end")], "edge_id string, src string, dst string")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node_id string")
    got = graph.shortest_paths(edges, nodes("v00", "v02"), nodes("v03", "end"), None, "out")
    assert sorted((r.source, r.target, len(r.hops)) for r in got.collect()) == [("v00", "end", 3), ("v00", "v03", 3), ("v02", "v03", 1)]
    assert sorted((r.source, r.target) for r in graph.shortest_paths(edges, nodes("v00"), nodes("v03", "end"), 2, "out").collect()) == []
    assert [(r.source, r.target, len(r.hops)) for r in graph.shortest_paths(edges, nodes("v05"), nodes("v05", "v03"), 4).orderBy("target").collect()] == [("v05", "v03", 2), ("v05", "v05", 0)]


def test_packages_and_events_of_no_kind(spark, records):
    with pytest.raises(ValueError, match="unknown mode"):
        packages.assemble_context("other", {}, {}, 3)
    with pytest.raises(ValueError, match="unknown kind"):
        audit.events(records, "other", F.lit("2024-01-01").cast("timestamp"))
    edges = spark.createDataFrame([("e1", "a", "b", "t1", "2024-01-01"), ("e2", "d", "a", "t2", "2024-01-02"), ("e3", "b", "c", "t1", "2024-01-03")], "edge_id string, src string, dst string, relation_type string, created_at string")
    p = packages.assemble_context("local_graph", {"records": records, "edges": edges}, {"seeds": ["a", "nowhere"]}, 2)
    assert [(x.id, x.position, x.score) for x in p.items.orderBy("position").collect()] == [("a", 1, 1.0), ("d", 2, 0.5)]
    assert [(x.id, x.reason) for x in p.omitted.collect()] == [("b", "budget_exceeded")] and p.provenance["mode"] == "local_graph"
    p = packages.assemble_context("local_graph", {"records": records, "edges": edges}, {"seeds": ["a"], "relation_types": ["t1"]}, 9, community_omissions=spark.createDataFrame([("limit", 3)], "reason string, count int"))
    assert sorted(x.id for x in p.items.collect()) == ["a", "b"] and [(x.id, x.reason) for x in p.omitted.collect()] == [("community:limit", "adapter_omitted")]


def test_an_event_says_the_same_again(spark):
    rows = spark.createDataFrame([("ns", "r1", "retrieval_used", "me", "s1", {"signal_kind": "other", "why": "x"}), ("ns", "r1", "retrieval_used", "me", "s1", None), ("ns", "", "nothing", "me", None, None), (None, "r", "retrieval_used", "me", None, None)], "namespace string, record_id string, signal_kind string, source_owner string, session_id string, more_details map<string,string>")
    at = F.lit("2024-01-01").cast("timestamp")
    good, bad = audit.events(rows.unionByName(rows), "quality_eval_signal", at)
    assert sorted(x.details for x in good.collect()) == ['{"namespace":"ns","signal_kind":"other","source_owner":"me","why":"x"}', '{"namespace":"ns","signal_kind":"retrieval_used","source_owner":"me"}']
    assert {x.refusal for x in bad.collect()} == {"record_id is required", "namespace is required"}

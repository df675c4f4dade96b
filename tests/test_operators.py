"""Operators that SQL can't express, against plain loops; and small hand-made cases."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from mnemos.functions import columns, markdown
from mnemos.operators import context, explorer, facts, graph, lists, policy, records, upkeep, vault, views, writes
from mnemos.sources import bundles
from mnemos.streaming import changes


def multigraph(seed, n=7, m=10):
    r = random.Random(seed)
    return [(f"e{i:02d}", f"v{r.randrange(n)}", f"v{r.randrange(n)}") for i in range(m)]


def near(edges):
    out = {}
    for e, a, b in edges:
        out.setdefault(a, []).append((b, e))
        out.setdefault(b, []).append((a, e))
    return {k: sorted(v) for k, v in out.items()}


def frame(spark, edges):
    return spark.createDataFrame(edges, "edge_id string, src string, dst string")


def depth_first(adjacent, source, target, depth):
    """Paths in the order in which a stack of partial paths finds them."""
    found, stack = [], [(source, [])]
    while stack:
        node, path = stack.pop()
        if node == target and path:
            found.append(path)
            continue
        if len(path) < depth:
            seen = {source, *(n for n, _ in path)}
            for hop in reversed(adjacent.get(node, [])):
                if hop[0] not in seen:
                    stack.append((hop[0], [*path, hop]))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_paths(spark, seed):
    edges = multigraph(seed)
    e, adjacent = frame(spark, edges), near(edges)
    got = [[(h.node, h.edge) for h in r.hops] for r in graph.simple_paths(e, "v0", "v3", 3).collect()]
    want = depth_first(adjacent, "v0", "v3", 3)
    assert sorted(got) == sorted(want) and got == sorted(got, key=lambda p: (len(p), [n for n, _ in p], [x for _, x in p]))
    short = {r.target: [(h.node, h.edge) for h in r.hops] for r in graph.shortest_paths(e, spark.createDataFrame([("v0",)], "node_id string")).collect()}
    level, best = {"v0": []}, {"v0": []}
    while level:
        step = {}
        for n, p in level.items():
            for b, x in adjacent.get(n, []):
                if b not in best:
                    step[b] = min(step.get(b, [*p, (b, x)]), [*p, (b, x)])
        best.update(step)
        level = step
    assert short == best


@pytest.mark.parametrize("seed", range(3))
def test_label_propagation(spark, seed):
    """Sweeps in which all nodes look at the labels before, their own among them."""
    edges = multigraph(seed, 12, 14)
    nodes = [f"v{i}" for i in range(13)]
    adjacent, label = near(edges), {n: n for n in nodes}
    for _ in range(25):
        before = dict(label)
        for n in nodes:
            votes = {before[n]: 1}
            for m, _ in adjacent.get(n, []):
                votes[before[m]] = votes.get(before[m], 0) + 1
            label[n] = min(votes, key=lambda k: (-votes[k], k))
        if label == before:
            break
    got = graph.label_propagation(spark.createDataFrame([(n,) for n in nodes], "node_id string"), frame(spark, edges))
    assert {r.node_id: r.label for r in got.collect()} == label


def test_deep_paths(spark):
    chain = [(f"e{i:02d}", f"v{i:02d}", f"v{i + 1:02d}") for i in range(24)]
    got = graph.simple_paths(frame(spark, chain), "v00", "v09", 9).collect()
    assert len(got) == 1 and len(got[0].hops) == 9
    assert graph.shortest_paths(frame(spark, chain), spark.createDataFrame([("v00",)], "node_id string")).where("size(hops) = 24").count() == 1


def test_communities_are_named_by_their_members(spark):
    edges = frame(spark, [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "d", "e")])
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("f", 3)], "node_id string, label int")
    got = {r.label: r for r in graph.communities(labels, edges).collect()}
    assert {k: (r.size, r.seed, r.internal_edges, r.score) for k, r in got.items()} == {1: (3, "b", 2, 1.0), 2: (2, "d", 1, 1.0)}
    again = {r.label: r.community_id for r in graph.communities(labels.withColumn("label", F.col("label") + 10).repartition(3), edges).collect()}
    assert again == {k + 10: r.community_id for k, r in got.items()} and uuid.UUID(got[1].community_id).version == 5
    fewer = {r.label: r.community_id for r in graph.communities(labels.where("node_id <> 'a'"), edges).collect()}
    assert fewer[1] != got[1].community_id and fewer[2] == got[2].community_id


@pytest.mark.parametrize("seed", range(4))
def test_facts_as_of_with_overlaps(spark, seed):
    r = random.Random(seed)
    day = lambda k: f"2024-01-{k:02d}T{r.randrange(3):02d}:00:00Z"
    rows = []
    for i in range(40):
        start = r.randrange(1, 25)
        rows.append((f"f{i:02d}", f"s{r.randrange(3)}", day(start) if r.random() > 0.1 else None, day(start + r.randrange(0, 6)) if r.random() > 0.3 else None, "x" if r.random() < 0.15 else None))
    probes = [(f"s{r.randrange(4)}", day(r.randrange(1, 31))) for _ in range(30)] + [("s0", None), (None, day(3))] + [("s1", "2024-01-05T00:00:00Z")] * 2
    facts_ = spark.createDataFrame([(*x, None, x[0].upper()) for x in rows], "fact_id string, subject_entity_id string, valid_from string, valid_to string, invalidated_at string, superseded_by_fact_id string, object_literal string")
    got = facts.facts_as_of(spark.createDataFrame(probes, "subject_entity_id string, at string"), facts_).collect()
    want = []
    for s, at in probes:
        ok = [(b or "", i) for i, of, b, e, gone in rows if of == s and at is not None and not gone and (b or "") <= at and (e is None or at < e) and (e is None or (b is None or e > b))]
        want.append((s, at, max(ok)[1] if ok else None))
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(((x.subject_entity_id, x["at"], x.fact_id) for x in got), key=key) == sorted(want, key=key)


def test_dyadic_runs_cover_each_stretch_once(spark):
    pairs = [(a, b) for a in range(0, 20, 3) for b in range(0, 22, 4)] + [(5, 1 << 10)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", facts.dyadic(F.col("a"), F.col("b"), 10).alias("r")).collect()
    for x in got:
        covered = [k for y in x.r for k in range(y.run << y.level, min((y.run + 1) << y.level, 64))]
        assert sorted(covered) == list(range(x.a, min(x.b, 64)))


def budget(blocks, ceiling, floor):
    """Tokens left of each block, by plain rules."""
    order = sorted(blocks, key=lambda b: (context.BLOCK_CLASSES.index(b[1]), b[2], b[0]))
    cost = {b[0]: b[3] for b in order}
    for name in reversed(context.BLOCK_CLASSES):
        ids = [b[0] for b in order if b[1] == name]
        for i in ids if name == "agent_identity" else reversed(ids):
            over = sum(cost.values()) - ceiling
            if over > 0:
                cost[i] = min(cost[i], max(floor, cost[i] - over)) if name == "agent_identity" else max(0, cost[i] - over)
    return cost


@pytest.mark.parametrize("ceiling", [40, 120, 300, 5000])
def test_block_budget(spark, ceiling):
    r = random.Random(ceiling)
    blocks = [(f"b{i}", r.choice(context.BLOCK_CLASSES), i % 4, r.randrange(5, 60)) for i in range(14)]
    df = spark.createDataFrame([(*b, "o") for b in blocks], "block_id string, class string, at int, token_estimate int, owner string")
    df = df.withColumns({"created_at": F.timestamp_seconds("at"), "stale_after": F.lit(None).cast("timestamp")})
    got = {x.block_id: x.tokens for x in context.block_budget(df, F.current_timestamp(), ceiling, 8).collect()}
    assert got == budget(blocks, ceiling, 8)


def test_trust_follows_updates(spark):
    rows = [("a", 1, "positive", 0.2), ("a", 2, "positive", 0.2), ("a", 3, "negative", 0.05), ("b", 2, "positive", 0.5), ("b", 1, "suppress", 0.1), ("c", 1, "operator_pin", 0.0), ("c", 2, "evidence_stale", 0.3)]
    got = {r.memory_id: (r.trust_state, round(r.trust_score, 6)) for r in context.trust(spark.createDataFrame(rows, "memory_id string, position int, outcome string, weight double")).collect()}
    assert got == {"a": ("provisional", 0.85), "b": ("suppressed", 0.0), "c": ("provisional", 0.7)}


def test_durations():
    assert columns.duration_seconds("P1Y2M3W4DT5H6M7S") == 365 * 86400 + 60 * 86400 + 25 * 86400 + 5 * 3600 + 6 * 60 + 7
    for bad in ("", "P", "PT", "P0D", "1D", "P1S", "PT1D", "P1D2Y", "P-1D"):
        with pytest.raises(ValueError):
            columns.duration_seconds(bad)


def test_uuid5_and_slug(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    r = spark.createDataFrame([("a",), ("é|x",), ("",)], "x string").select("x", columns.uuid5(ns, F.col("x")).alias("u")).collect()
    assert all(x.u == str(uuid.uuid5(uuid.UUID(ns), x.x)) for x in r)
    assert spark.range(1).select(columns.slug(F.lit("  Hello,  World! A-b "))).first()[0] == "hello-world-a-b"
    assert [spark.range(1).select(columns.slug(F.lit(x))).first()[0] for x in ("Notes &", "\U0001f389 Party")] == ["notes", "party"]


def test_similarity(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    one = spark.range(1).select(columns.similarity(v(1, 2, 3), v(4, 5, 6), "dot"), columns.similarity(v(1, 0), v(0, 1), "l2"), columns.similarity(v(1, 0), v(1, 0.1), "cosine")).first()
    assert one[0] == 32 and one[1] == pytest.approx(-(2**0.5)) and one[2] == pytest.approx(1 / 1.01**0.5)
    for bad in (columns.similarity(v(0, 0), v(1, 1), "cosine"), columns.similarity(v(1), v(1, 2), "dot")):
        with pytest.raises(Exception):
            spark.range(1).select(bad).collect()


def test_bitemporal_bounds_are_half_open(spark):
    rows = [("a", None, "2024-01-01", "2024-02-01"), ("b", "2024-01-15", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "id string, e string, c string, v string").select("id", F.col("e").cast("timestamp").alias("event_time"), F.col("c").cast("timestamp").alias("created_at"), F.col("v").cast("timestamp").alias("valid_to"))
    at = lambda s: F.lit(s).cast("timestamp")
    ids = lambda test: sorted(r.id for r in df.where(test).collect())
    assert ids(columns.valid_at(at("2024-01-01"))) == ["a"] and ids(columns.valid_at(at("2024-02-01"))) == ["b"]
    assert ids(columns.believed_at(at("2024-01-10"))) == ["a", "b"]
    assert ids(columns.effective_during(at("2024-02-01"), at("2024-02-02"))) == ["b"] and ids(columns.effective_during(at("2024-02-02"), at("2024-02-02"))) == []


def test_view_comparisons(spark):
    df = spark.createDataFrame([("10",), ("9",), ("x",), (None,)], "v string")
    ids = lambda *spec: sorted(str(r.v) for r in df.where(views.condition(spec)).collect())
    assert ids("v", "gt", "9.5") == ["10", "x"] and ids("v", "ne", "9") == ["10", "None", "x"] and ids("v", "exists", False) == ["None"]
    assert ids("or", ("v", "eq", 9), ("v", "in", ["x"])) == ["9", "x"] and ids("not", ("v", "contains", "1")) == ["9", "None", "x"]


def test_access_fails_closed(spark):
    row = dict(mode="bounded", constraint_namespaces=["a"], grant_id="g", status="active", starts_at=None, ends_at=None, actor="x", granted_actor="x", operation="list", operations=["list"], depth=0, max_depth=1, namespaces=["b"], granted_namespaces=None, limits=[5])
    schema = "mode string, constraint_namespaces array<string>, grant_id string, status string, starts_at timestamp, ends_at timestamp, actor string, granted_actor string, operation string, operations array<string>, depth int, max_depth int, namespaces array<string>, granted_namespaces array<string>, limits array<int>"
    cases = [{}, {"constraint_namespaces": []}, {"namespaces": None}, {"operations": None}, {"max_depth": None}]
    df = spark.createDataFrame([{**row, **c} for c in cases], schema)
    assert [r.reason for r in policy.access(df, F.lit("2024-01-01").cast("timestamp")).collect()] == ["namespace_denied", "constraint_denied", "allowed", "operation_denied", "depth_exceeded"]


def test_markdown(spark):
    text = "---\ntitle: A note\ntags: x\n---\n# Head One\nSee [[Other Note#Part 2|that]] and ![[img#^b1]] and [site](http://x.y/z) #tag/one\n## Two\n"
    r = spark.createDataFrame([(text,)], "t string").select(
        markdown.frontmatter(F.col("t")).alias("f"), markdown.wikilinks(F.col("t")).alias("w"), markdown.links(F.col("t")).alias("l"), markdown.tags(markdown.without_frontmatter(F.col("t"))).alias("g"), markdown.headings(markdown.without_frontmatter(F.col("t"))).alias("h")
    ).first()
    assert r.f == {"title": "A note", "tags": "x"} and r.g == ["tag/one"]
    assert [(w.target, w.display, w.heading, w.block) for w in r.w] == [("Other Note", "that", "part-2", None), ("img", None, None, "b1")]
    assert [(x.display, x.raw, x.kind) for x in r.l] == [("site", "http://x.y/z", "external")] and [(h.level, h.title, h.anchor) for h in r.h] == [(1, "Head One", "head-one"), (2, "Two", "two")]


def test_links_of_rich_notes(spark):
    text = "![pic](a.png) [two words](my note.md#A b) (#tag) x#no [[A | shown]] ![[B]]\nline ^b-1\n- [Lab](t.md): why\n"
    t_ = F.col("t")
    r = spark.createDataFrame([(text,)], "t string").select(markdown.links(t_).alias("l"), markdown.tags(t_).alias("g"), markdown.wikilinks(t_).alias("w"), markdown.block_ids(t_).alias("b"), markdown.list_items(t_).alias("i")).first()
    assert [(x.display, x.raw, x.heading) for x in r.l] == [("two words", "my note.md#A b", "a-b"), ("Lab", "t.md", None)] and r.g == ["tag"]
    assert [(w.kind, w.raw, w.target, w.display) for w in r.w] == [("wikilink", "A | shown", "A", "shown"), ("embed", "B", "B", None)] and "two words" in r.w[0].before
    assert [(b.line, b.block) for b in r.b] == [(2, "b-1")] and [(i.line, i.label, i.target, i.rest) for i in r.i] == [(3, "Lab", "t.md", "why")]


def test_links_are_resolved_by_path_or_by_name(spark):
    notes = spark.createDataFrame([("r1", "dir/Note.md", "First  one", ["alias"]), ("r2", "b.md", "Second", ["alias", "x/y"]), ("r3", "second.md", "third", None)], "id string, path string, title string, aliases array<string>")
    links = [("a", "Dir/note#Part"), ("b", "first one"), ("c", "ALIAS"), ("d", "second"), ("e", "second.md"), ("f", "x/y"), ("g", "https://a/b"), ("h", "mailto:me"), ("i", "nowhere"), ("j", "b")]
    got = {r.link_id: (r.resolution_status, r.target_record_id) for r in markdown.resolved(spark.createDataFrame(links, "link_id string, raw_target string"), notes).collect()}
    assert got["a"] == got["b"] == ("resolved", "r1") and got["c"] == ("ambiguous", None) and got["d"] == ("resolved", "r2") and got["e"] == ("resolved", "r3")
    assert got["f"] == got["i"] == got["j"] == got["h"] == ("unresolved", None) and got["g"] == ("external", None)


def test_a_colon_in_a_title_makes_no_external_link_and_namespaces_are_kept_apart(spark):
    notes = spark.createDataFrame([("r1", None, "Project: Alpha", None, "a"), ("r2", None, "Same", None, "a"), ("r3", None, "Same", None, "b"), ("r4", None, "Free", None, None)], "id string, path string, title string, aliases array<string>, project_id string")
    links = spark.createDataFrame([("a", "project: alpha|shown", "a"), ("b", "Same", "b"), ("c", "Same", "c"), ("d", "free", "c"), ("e", "Project: Alpha", "b")], "link_id string, raw_target string, project_id string")
    got = {r.link_id: (r.resolution_status, r.target_record_id) for r in markdown.resolved(links, notes, ("project_id",)).collect()}
    assert got == {"a": ("resolved", "r1"), "b": ("resolved", "r3"), "c": ("unresolved", None), "d": ("resolved", "r4"), "e": ("unresolved", None)}


def test_links_have_the_places_of_a_regular_expression(spark):
    import re

    text = "é😀 [[A]] x [[A]] ![[B|b]] [t](u v) ![no](x) [[C#h]] " * 30 + "[[A]]"
    got = spark.createDataFrame([(text,)], "t string").select(markdown.wikilinks(F.col("t"), 5).alias("w"), markdown.links(F.col("t"), 5).alias("l")).first()
    for found, pattern in ((got.w, r"(!)?\[\[([^\]]+)\]\]"), (got.l, r"(?<!!)\[([^\]]*)\]\(([^)]+)\)")):
        want = [(m.start(), m.end(), m[0], text[max(0, m.start() - 5) : m.start()], text[m.end() : m.end() + 5]) for m in re.finditer(pattern, text)]
        assert [(x.start, x.end, x.original, x.before, x.after) for x in found] == want and len(want) >= 30


def test_frontmatter_keeps_every_key_and_the_last_of_equals(spark):
    text = "---\ntitle: A\n# no: comment\ncreated at: x:y\n  indented :  v  \nempty:\ntitle: B\nno colon\n---\nbody"
    r = spark.createDataFrame([(text,), ("plain",), ("---\n\n---\nx",)], "t string").select(markdown.frontmatter(F.col("t")).alias("f"), markdown.without_frontmatter(F.col("t")).alias("b")).collect()
    assert r[0].f == {"created at": "x:y", "indented": "v", "empty": "", "title": "B"} and r[0].b == "body" and r[1].f is None and r[2].f == {} and r[2].b == "x"


def test_paths_that_go_above_their_root(spark):
    cases = [("a/b.md", "../../../x.md", None), ("a/b.md", "../x.md", "x.md"), ("a/b.md", "..\\c/./d.md", "c/d.md"), ("b.md", "/../x.md", None), ("b.md", "/x//y.md#h|s", "x/y.md")]
    got = spark.createDataFrame(cases, "p string, r string, w string").select("w", vault.bundle_target(F.col("p"), F.col("r")).alias("g")).collect()
    assert all(x.g == x.w for x in got)
    paths = spark.createDataFrame([("a\\b.md", "a/b.md", None), ("..\\x", "../x", "path_outside"), ("/a", "/a", "path_outside"), (".//", "", "path_required")], "p string, n string, r string")
    assert all(x.n == x.g and x.r == x.f for x in paths.select("n", "r", vault.normal_path(F.col("p")).alias("g"), vault.path_refusal(F.col("p")).alias("f")).collect())


def test_one_row_a_key_after_puts_and_patches(spark):
    table = spark.createDataFrame([("a", None, 1), ("b", "k", 2)], "x string, y string, v int")
    rows = spark.createDataFrame([("a", None, 5, 2), ("a", None, 9, 1), ("c", "k", 3, 1), ("c", "k", 4, 2)], "x string, y string, v int, n int")
    assert sorted(map(str, writes.put(table, rows, ["x", "y"], "n").collect())) == sorted(["Row(x='a', y=None, v=5)", "Row(x='b', y='k', v=2)", "Row(x='c', y='k', v=4)"])
    had = spark.createDataFrame([("i1", "s", "t", "k", "old", "c0", "2024-01-01", "2024-01-01"), ("i2", "s", "t", None, "n", "c1", "2024-01-01", "2024-01-01")], "id string, scope string, type string, key string, title string, content string, created_at string, updated_at string")
    patches = spark.createDataFrame([(1, "s", "t", "k", "one", "c2"), (2, "s", "t", "k", "two", None), (3, "s", "t", None, None, "c3"), (4, "s", "t", "new", "x", None), (5, "s", "t", "new", "y", "z")], "n int, scope string, type string, key string, title string, content string")
    got = writes.upserted(had, patches, F.lit("2024-02-02"), "n").collect()
    assert sorted((r.key or "", r.title, r.content, r.updated_at) for r in got) == [("", "n", "c3", "2024-02-02"), ("k", "two", "c2", "2024-02-02"), ("new", "y", "z", "2024-02-02")]


def test_notes_are_written_and_read_again(spark):
    files = spark.createDataFrame([("a.md", "---\nk: v\n---\nbody"), ("b.md", "plain")], "path string, content string").withColumns({"content_hash": F.sha2(F.col("content").cast("binary"), 256), "deleted": F.lit(False)})
    out = vault.exported(vault.notes(files)).join(files.select("path", F.col("content").alias("was")), "path").collect()
    assert all(r.content == r.was for r in out)


def test_rename_conflicts(spark):
    renames = spark.createDataFrame([("a.md", "b.md"), ("c.md", "d.md")], "old_path string, new_path string")
    none = spark.createDataFrame([], "link_id string, raw_target string, target_path string")
    touched, conflicts = vault.rename_plan(none, renames, spark.createDataFrame([("b.md",), ("b.md",)], "path string"))
    assert touched.count() == 0 and [r.path for r in conflicts.collect()] == ["b.md"]


def test_cursors_belong_to_their_request():
    request = {"query": "x", "limit": 3, "cursor": None}
    cursor = explorer.next_cursor(request, 3)
    assert explorer.cursor_offset(request | {"cursor": cursor}) == 3 and explorer.cursor_offset(request) == 0
    for bad in (request | {"query": "y", "cursor": cursor}, request | {"cursor": "??"}):
        with pytest.raises(ValueError):
            explorer.cursor_offset(bad)


def test_lists_refuse_unknown_filters(spark):
    with pytest.raises(ValueError):
        lists.listing(spark.createDataFrame([], "decision_id string"), "decision", color="red")


def test_context_bounds(spark):
    at, n = F.lit(4), F.lit(2)
    r = spark.range(1).select(*explorer.around(F.lit("abcdefgh"), 2, 2, at, n), *explorer.around(F.lit("abcdefgh"), 0, 0, at, n), explorer.bounded(F.lit("ab\ncdefgh"), at, n, 4)).first()
    assert tuple(r) == ("bc", "fg", "", "", "\ncde".replace("\n", " "))


def test_backup_and_restore(spark, tmp_path):
    t1 = spark.range(5).withColumn("x", F.col("id") * 2)
    was = bundles.backed_up({"t": t1}, str(tmp_path))
    assert bundles.restored(spark, str(tmp_path), was, ["t"])["t"].exceptAll(t1).count() == 0
    with pytest.raises(ValueError):
        bundles.restored(spark, str(tmp_path), bundles.manifest({"t": t1.limit(2)}), ["t"])


def test_snapshot_names_are_taken_once(spark):
    had = spark.createDataFrame([("ns", "a")], "namespace_key string, name string")
    with pytest.raises(ValueError):
        bundles.retention_snapshot({"t": spark.range(2)}, "ns", "a", had, F.current_timestamp())
    assert bundles.retention_snapshot({"t": spark.range(2)}, "ns", "a", had, F.current_timestamp(), True).count() == 1


def test_bundle_round_trip(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/nation.parquet")
    bundles.write_bundle({"nation": d}, str(tmp_path / "b"))
    schemas = {"nation": "n_nationkey int, n_name string, n_regionkey int"}
    assert bundles.read_bundle(spark, str(tmp_path / "b"), schemas)["nation"].exceptAll(d).count() == 0
    d.limit(3).write.mode("overwrite").json(str(tmp_path / "b" / "nation"))
    with pytest.raises(ValueError):
        bundles.read_bundle(spark, str(tmp_path / "b"), schemas)


def test_notes_are_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# A\n")
    (tmp_path / "b.txt").write_text("no")
    got = bundles.notes(spark, str(tmp_path)).collect()
    assert [(r.path.endswith("sub/a.md"), r.text) for r in got] == [(True, "# A\n")]


def log(spark, rows):
    return spark.createDataFrame([(c, f"ev{c}", "record", o, op, None, p, "u", None) for c, o, op, p in rows], "cursor long, event_id string, object_type string, object_id string, operation string, changed_at timestamp, payload string, user_id string, idempotency_key string")


def test_projection_survives_replays(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("log", "target", "state"))
    log(spark, [(1, "a", "put", "1"), (2, "b", "put", "1"), (3, "a", "put", "2")]).write.parquet(source)
    changes.project(changes.read_log(spark, source), target, state).awaitTermination()
    assert {(r.object_id, r.payload) for r in changes.projected(spark, target).collect()} == {("a", "2"), ("b", "1")}
    log(spark, [(4, "b", "delete", None), (5, "c", "put", "9")]).write.mode("append").parquet(source)
    for _ in range(2):
        changes.project(changes.read_log(spark, source), target, state).awaitTermination()
    assert {(r.object_id, r.payload) for r in changes.projected(spark, target).collect()} == {("a", "2"), ("c", "9")}
    changes.project(changes.read_log(spark, source), target, str(tmp_path / "fresh")).awaitTermination()
    assert {(r.object_id, r.payload) for r in changes.projected(spark, target).collect()} == {("a", "2"), ("c", "9")}


def test_replays_are_dropped(spark):
    events = log(spark, [(1, "a", "put", "1"), (2, "b", "put", "1")])
    assert [r.cursor for r in changes.deduplicated(events.union(events), events.where("cursor = 1")).collect()] == [2]
    r = spark.range(1).select(*(F.unix_timestamp(changes.retry_at(F.timestamp_seconds(F.lit(0)), F.lit(n))) for n in (1, 4, 20))).first()
    assert list(r) == [1, 8, 300]


def test_batches_resume(spark):
    df = spark.createDataFrame([(f"r{i:03d}", "s") for i in range(25)], "record_id string, vector_space string").repartition(5)
    got = {r.record_id: r.batch for r in upkeep.batches(df, ["record_id", "vector_space"], 10).collect()}
    assert all(got[f"r{i:03d}"] == i // 10 for i in range(25))
    assert upkeep.batches(df, ["record_id", "vector_space"], 10, ("r019", "s")).count() == 5


def test_superseded_latest_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "key string, n int")
    assert {(r.key, r.n) for r in records.latest(df, ["key"], [-F.col("n")]).collect()} == {("a", 2), ("b", 1)}
    old = spark.createDataFrame([("a", None, None), ("b", None, None)], "id string, valid_to string, superseded_by_id string")
    twice = spark.createDataFrame([("a", "x", "2024"), ("a", "y", "2025")], "old_id string, new_id string, created_at string")
    assert [(r.id, r.valid_to, r.superseded_by_id) for r in records.superseded(old, twice).orderBy("id").collect()] == [("a", "2025", "y"), ("b", None, None)]
    assert records.live(log(spark, [])).count() == 0
    assert graph.components(spark.createDataFrame([("x",)], "node_id string"), frame(spark, [])).first().component == "x"

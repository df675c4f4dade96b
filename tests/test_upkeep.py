"""Decisions, digests, kept-up views, projection turns, workspace polls and bundles against plain loops."""

import datetime
import decimal
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemos.operators import access, context, range_digests, view_upkeep
from mnemos.sources import bundle_source
from mnemos.streaming import worker, workspace

IDS = ("tenant_id", "user_id")


# Access


def meet(a, b):
    """Two lists of selectors or of names, None for all."""
    if a is None or b is None:
        return b if a is None else a
    if not (a or b) or not isinstance((a or b)[0], tuple):
        return sorted(set(a) & set(b))
    found = {tuple(y if x is None else x for x, y in zip(p, q)) for p in a for q in b if all(x is None or y is None or x == y for x, y in zip(p, q))}
    return sorted(found, key=lambda s: [(x is not None, x or "") for x in s])


def decided_by_loop(r, now):
    lists = ("namespaces", "workspace_ids", "record_types", "operations")
    have, limits = dict.fromkeys(lists), {"max_results": [r["max_results"], r["host_max_results"]], "max_context_tokens": [r["max_context_tokens"], r["host_max_context_tokens"]]}
    no = lambda reason: (False, reason, None, None, None, None, None)
    for c in r["constraints"]:
        if c["mode"] == "deny_all":
            return no("constraint_denied")
        if c["mode"] == "unconstrained_trusted":
            continue
        if not c["namespaces"]:
            return no("constraint_denied")
        for k in lists:
            have[k] = meet(have[k], c[k])
            if have[k] == []:
                return no("constraint_denied")
        for k in limits:
            limits[k].append(c[k])
    g = r["grant"]
    if r["delegated"]:
        if g is None:
            return no("grant_required")
        if g["state"] != "active":
            return no("grant_inactive")
        if now < g["issued_at"]:
            return no("grant_not_yet_active")
        if now >= g["expires_at"]:
            return no("grant_expired")
        if r["grant_id"] != g["grant_id"] or any(r[b] is None or r[b] != g[b] for b in access.BINDINGS):
            return no("grant_mismatch")
        if r["operation"] not in (g["operations"] or []):
            return no("operation_denied")
        if r["depth"] > g["max_depth"]:
            return no("depth_exceeded")
        if r["reshare"] and not g["can_reshare"]:
            return no("reshare_denied")
        for k in lists:
            have[k] = meet(have[k], g[k])
        for k in limits:
            limits[k].append(g[k])
    for k, reason in (("namespaces", "selector_denied"), ("workspace_ids", "workspace_denied"), ("record_types", "record_type_denied")):
        asked = r[k]
        have[k] = meet(have[k], asked)
        if r["delegated"] and not have[k] and (k == "namespaces" or asked is not None):
            return no(reason)
    if have["operations"] is not None and r["operation"] not in have["operations"]:
        return no("operation_denied")
    least = {k: min(x for x in v if x is not None) for k, v in limits.items()}
    return (True, "allowed" if r["delegated"] else "trusted_local", have["namespaces"], have["workspace_ids"], have["record_types"], least["max_results"], least["max_context_tokens"])


def test_access_is_decided_as_by_a_loop(spark):
    r = random.Random(7)
    some = lambda values, none=0.3, empty=0.04: None if r.random() < none else [] if r.random() < empty else r.sample(values, r.randrange(1, len(values) + 1))
    spaces = list(itertools.product([None, "t1", "t2"], [None, "u1", "u2"]))
    day = lambda n: datetime.datetime(2024, 1, n)
    limits = lambda: {"max_results": r.choice([None, 5, 9]), "max_context_tokens": r.choice([None, 100])}
    lists = lambda: {"namespaces": some(spaces, 0.05), "workspace_ids": some(["w1", "w2"], 0.5), "record_types": some(["a", "b", "c"], 0.5), "operations": some(["read", "write"], 0.4)}
    requests = []
    for i in range(1500):
        bound = {b: "x" for b in access.BINDINGS}
        grant = None if r.random() < 0.05 else {"grant_id": "g", "state": r.choice(["active"] * 12 + ["revoked"]), "issued_at": day(r.choice([1] * 9 + [20])), "expires_at": day(r.choice([30] * 9 + [5])), **bound, "max_depth": 3, "can_reshare": r.random() < 0.5, **lists(), **limits()}
        constraints = [{"mode": r.choice(["bounded"] * 20 + ["unconstrained_trusted"] * 4 + ["deny_all"]), **lists(), **limits()} for _ in range(r.choice([0, 0, 1, 1, 2, 3]))]
        asked = {"namespaces": some(spaces, 0.5), "workspace_ids": some(["w1", "w2"], 0.6), "record_types": some(["a", "b", "c"], 0.6)}
        if r.random() < 0.08:
            bound[r.choice(access.BINDINGS)] = r.choice([None, "y"])
        requests.append({"request_id": i, "constraints": constraints, "grant": grant, "delegated": r.random() < 0.75, "host_max_results": 8, "host_max_context_tokens": 500, **bound, "operation": r.choice(["read", "read", "write"]), **asked, "depth": r.choice([1, 2, 3, 3, 4]), "reshare": r.random() < 0.3, "grant_id": r.choice(["g"] * 15 + [None, "h"]), "max_results": 7, "max_context_tokens": 300})
    constraint_type, grant_type = access.schemas(IDS)
    selectors = "array<struct<tenant_id: string, user_id: string>>"
    schema = f"request_id int, constraints {constraint_type}, grant {grant_type}, delegated boolean, host_max_results int, host_max_context_tokens int, {', '.join(f'{b} string' for b in access.BINDINGS)}, operation string, namespaces {selectors}, workspace_ids array<string>, record_types array<string>, depth int, reshare boolean, grant_id string, max_results int, max_context_tokens int"
    got = {x.request_id: x for x in access.decided(spark.createDataFrame(requests, schema), F.lit("2024-01-10").cast("timestamp"), IDS).collect()}
    reasons = set()
    for q in requests:
        x, want = got[q["request_id"]], decided_by_loop(q, day(10))
        listed = lambda v: None if v is None else [tuple(y) if isinstance(y, tuple) else y for y in v]
        mine = (x.allowed, x.reason, listed(x.namespaces), x.workspace_ids, x.record_types, x.max_results, x.max_context_tokens)
        plain = lambda t: (*t[:2], *(sorted(v, key=str) if isinstance(v, list) else v for v in t[2:]))
        assert plain(mine) == plain(want), (q, mine, want)
        reasons.add(want[1])
    assert len(reasons) >= 12


def test_selectors_meet_by_the_ids_that_both_have(spark):
    r = random.Random(2)
    make = lambda n: [(r.choice([None, "a", "b"]), r.choice([None, "x", "y"]), r.choice([None, "p"])) for _ in range(n)]
    left, right = make(9), make(7)
    schema = "a string, b string, c string"
    got = context.namespaces_intersected(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ("a", "b", "c")).collect()
    want = {tuple(y if x is None else x for x, y in zip(p, q)) for p in left for q in right if all(x is None or y is None or x == y for x, y in zip(p, q))}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert context.namespaces_intersected(spark.createDataFrame([], schema), spark.createDataFrame(right, schema), ("a", "b", "c")).count() == 0


# Digests


def test_digests_find_every_difference_and_little_else(spark):
    rows = {("k", f"id{i}"): f"h{i}" for i in range(3000)}
    other = {k: v for k, v in rows.items() if k[1] not in ("id5", "id2999")} | {("k", "id7"): "changed", ("k", "new"): "n", ("z", "id8"): "h8", ("k", "id9"): None}
    table = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "object_kind string, object_id string, hash string").repartition(3)
    a, b = range_digests.differences(table(rows), table(other))
    assert a.count() < 15 and b.count() < 15
    found = range_digests.findings(table(rows), table(other), "t1", 9, "8")
    got = sorted(tuple(x) for x in found.select("finding", "object_kind", "object_id").collect())
    assert got == sorted([("missing", "k", "id5"), ("missing", "k", "id2999"), ("stale", "k", "id7"), ("orphan", "k", "new"), ("orphan", "z", "id8"), ("unverifiable", "k", "id9"), ("watermark_mismatch", "target", "t1")])
    mended = range_digests.repaired(table(other), range_digests.repairs(found), 9, 9)
    assert {(x.object_kind, x.object_id): x.hash for x in mended.collect()} == rows | {("k", "id9"): None}
    assert range_digests.findings(table(rows), table(rows), "t1", 9, "9").count() == 0 and range_digests.findings(table(rows), None, "t", 1, None).where("finding = 'unverifiable'").count() == 3000
    assert range_digests.findings(table(rows).limit(0), table(rows).limit(0), "t", 1, None).count() == 0
    with pytest.raises(ValueError):
        range_digests.repaired(table(other), range_digests.repairs(found), 8, 9)


# Views


def test_views_follow_events(spark):
    """Many rounds of puts and deletes, with nulls, groups that come and go and extremes that are lost."""
    r = random.Random(4)
    schema = "object_id string, color string, size long, price double"
    rows, groups, base, cursor = spark.createDataFrame([], schema), view_upkeep.summarised(spark.createDataFrame([], schema), "color", ["size", "price"]), {}, 0
    new_rows = lambda e: e.select("object_id", F.from_json("payload", "color string, size long, price double").alias("p")).select("object_id", "p.*").where("size is null or size < 90")
    import json

    for _ in range(4):
        events = []
        for _ in range(30):
            cursor += 1
            key = f"o{r.randrange(14)}"
            if r.random() < 0.3:
                events.append((cursor, key, "delete", None))
                base.pop(key, None)
            else:
                base[key] = {"color": r.choice(["red", "blue", None, "gold"]), "size": r.choice([None, 1, 5, 99, r.randrange(100)]), "price": r.choice([None, 0.1, 0.2, r.randrange(900) / 8])}
                events.append((cursor, key, "put", json.dumps(base[key])))
        feed = spark.createDataFrame(events, "cursor long, object_id string, operation string, payload string")
        rows, groups, at = view_upkeep.maintained(rows, groups, feed, new_rows, "color", ["size", "price"], cursor - 30)
        rows, groups = spark.createDataFrame(rows.collect(), rows.schema), spark.createDataFrame(groups.collect(), groups.schema)
        want = spark.createDataFrame([(k, v["color"], v["size"], v["price"]) for k, v in base.items() if v["size"] is None or v["size"] < 90], schema)
        assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and at.first()[0] == cursor
        assert sorted(map(str, groups.collect())) == sorted(map(str, view_upkeep.summarised(want, "color", ["size", "price"]).select(*groups.columns).collect()))
    again = view_upkeep.maintained(rows, groups, feed, new_rows, "color", ["size", "price"], cursor)
    assert sorted(map(str, again[1].collect())) == sorted(map(str, groups.collect())) and again[2].first()[0] == cursor
    kinds = spark.createDataFrame([(5, "record"), (9, "embedding")], "cursor long, object_type string")
    assert [view_upkeep.requires_refresh(kinds, c).first()[0] for c in (None, 4, 5)] == [True, True, False]


# The projection worker


def turns_by_loop(events, fails_until, times, most, attempts):
    """applied (target, cursor), and (checkpoint, event, attempts, dead) by target, after turns at these times, each with the events that were there."""
    state, applied = {}, []
    for now, there in times:
        for target in sorted({e[0] for e in events if e[2] in there}):
            done, failure = state.get(target, (0, None))
            for _, cursor, event in sorted(e for e in events if e[0] == target and e[1] > done and e[2] in there)[:most]:
                if failure and (failure[2] or failure[3] > now):
                    break
                if now < fails_until.get(event, 0):
                    n = failure[1] + 1 if failure and failure[0] == event else 1
                    failure = (event, n, n >= attempts, now + min(300, 2 ** (n - 1)))
                    break
                applied.append((target, cursor))
                done, failure = cursor, None
            state[target] = (done, failure)
    return sorted(applied), {t: (d, *(f[:3] if f else (None, None, None))) for t, (d, f) in state.items()}


def test_a_worker_that_is_restarted_applies_each_event_once_and_in_order(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    waves = [[(f"t{r.randrange(4)}", c, f"e{c}") for c in range(a, a + 30)] for a in (1, 31, 61, 91)]
    events = [e for w in waves for e in w]
    fails_until = {f"e{c}": r.choice([101, 104, 10**6]) for c in r.sample(range(1, 121), 14)}
    log, target, ledger, check = (str(tmp_path / n) for n in ("log", "target", "ledger", "check"))
    schema = "target_id string, cursor long, event_id string"
    until = spark.createDataFrame(list(fails_until.items()), "event_id string, until long")
    outcome = lambda e, now: e.join(F.broadcast(until), "event_id", "left").withColumn("ok", F.coalesce("until", F.lit(0)) <= now.cast("long")).withColumn("reason", F.lit("target_write_failed")).drop("until")
    time = {"now": 0}
    clock = lambda: F.timestamp_seconds(F.lit(time["now"]))
    table = lambda: spark.read.schema(schema).parquet(log)

    def run():
        q = worker.work(spark.readStream.schema(schema).parquet(log), table, target, ledger, check, clock, outcome, 9, 4)
        q.awaitTermination()

    times = []
    for i, wave in enumerate(waves):
        spark.createDataFrame(wave, schema).write.mode("append").parquet(log)
        time["now"] = 100 + 2 * i
        if i == 1:  # the turn of this batch is lost after its events are written, and made again by the next start
            turn = worker.turn

            def half(*a, **k):
                applied, _ = turn(*a, **k)
                applied.write.mode("overwrite").parquet(f"{target}/run=2")
                raise RuntimeError("lost")

            monkeypatch.setattr(worker, "turn", half)
            with pytest.raises(Exception, match="lost"):
                run()
            monkeypatch.setattr(worker, "turn", turn)
        run()
        times.append((time["now"], {e[2] for w in waves[: i + 1] for e in w}))
    for now in (108, 109, 112, 120, 500, 900):  # nothing new: failed events are tried again by turns of their own
        time["now"] = now
        assert worker.take_turn(spark, table(), target, ledger, clock(), lambda e: outcome(e, clock()), 9, 4)
        times.append((now, {e[2] for e in events}))
    assert not worker.take_turn(spark, table(), target, ledger, clock(), lambda e: outcome(e, clock()), 9, 4, batch=0)
    applied_want, ledger_want = turns_by_loop(events, fails_until, times, 9, 4)
    got = worker.applied_events(spark, target, ledger, schema).collect()
    assert sorted((x.target_id, x.cursor) for x in got) == applied_want and len(applied_want) > 20
    assert {x.target_id: (x.checkpoint, x.event_id, x.attempts, x.dead_letter) for x in worker.ledger(spark, ledger).collect()} == ledger_want
    assert any(v[3] for v in ledger_want.values())


# A workspace


def write(folder, files):
    for name, text in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if text is None:
            os.remove(path)
        else:
            with open(path, "w") as f:
                f.write(text)


def test_three_polls_with_edits_on_both_sides(spark, tmp_path):
    folder, home = str(tmp_path / "files"), str(tmp_path / "home")
    at = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    sync = workspace.Workspace(spark, home)
    kinds = lambda plan: sorted((x.path, x.previous_path, x.kind) for x in plan.collect())
    write(folder, {"a.md": "A", "dir/b c.md": "B", "c.canvas": "C", "d.md": "D"})
    plan, status = sync.poll(folder, at(1), apply=False)
    assert len(kinds(plan)) == 4 and status.first().pending == 4 and status.first().tracked == 0
    plan, status = sync.poll(folder, at(1))
    assert [k for *_, k in kinds(plan)] == ["created"] * 4 and (status.first().fresh, status.first().stale) == (4, 0)
    records = {x.path: x for x in sync.tables()[1].collect()}
    assert records["dir/b c.md"].content == "B"
    # Both sides change a.md; the folder renames b, deletes c and adds e; the record of d changes alone, and so does nothing else.
    edited = [(records[p].record_id, p, text, text, datetime.datetime(2024, 1, 2)) for p, text in (("a.md", "ours"), ("d.md", "D2"))]
    sync.edit(spark.createDataFrame(edited, workspace.RECORDS))
    write(folder, {"a.md": "theirs", "dir/b c.md": None, "dir/new.md": "B", "c.canvas": None, "e.md": "E"})
    plan, status = sync.poll(folder, at(2))
    assert kinds(plan) == [("a.md", None, "conflict"), ("c.canvas", None, "deleted"), ("d.md", None, "conflict"), ("dir/new.md", "dir/b c.md", "renamed"), ("e.md", None, "created")]
    s = status.first()
    assert (s.tracked, s.fresh, s.stale, s.open_conflicts) == (6, 4, 2, 2)
    ledger, after, conflicts = sync.tables()
    now = {x.path: x for x in after.collect()}
    assert sorted(now) == ["a.md", "d.md", "dir/new.md", "e.md"] and now["dir/new.md"].record_id == records["dir/b c.md"].record_id and now["a.md"].content == "ours"
    assert {x.path: x.superseded_by for x in ledger.where("status = 'stale'").collect()} == {"dir/b c.md": "dir/new.md", "c.canvas": None}
    # A third poll: the same conflicts are noted once; a stale path comes back.
    write(folder, {"c.canvas": "C3", "e.md": "E3"})
    plan, status = sync.poll(folder, at(3))
    assert kinds(plan) == [("a.md", None, "conflict"), ("c.canvas", None, "created"), ("d.md", None, "conflict"), ("e.md", None, "modified")]
    s = status.first()
    assert (s.tracked, s.fresh, s.stale, s.open_conflicts) == (6, 5, 1, 2)
    assert {x.path: x.content for x in sync.tables()[1].collect()} == {"a.md": "ours", "d.md": "D2", "dir/new.md": "B", "e.md": "E3", "c.canvas": "C3"}
    assert {(x.file_kind, x.kind): x.n for x in workspace.by_kind(plan).collect()} == {("markdown", "conflict"): 2, ("canvas", "created"): 1, ("markdown", "modified"): 1}


# Bundles


def test_a_bundle_is_written_and_read_and_every_part_is_verified(spark, tmp_path):
    spark.dataSource.register(bundle_source.BundleSource)
    path = str(tmp_path / "bundle")
    rows = [(1, "é\n x", 1.5, True, datetime.datetime(2024, 1, 2, 3, 4, 5, 6), datetime.date(2024, 1, 2), decimal.Decimal("1.50"), [1, None], {"a": None, "b": 2}, ("x", None), bytearray(b"\x00\xff")), (2, *[None] * 10)]
    schema = "i long, s string, d double, b boolean, t timestamp, e date, m decimal(9,2), l array<int>, p map<string,int>, r struct<x: string, y: int>, y binary"
    df = spark.createDataFrame(rows * 20, schema).repartition(3)
    df.write.format("sealed_bundle").mode("overwrite").save(path)
    got = spark.read.format("sealed_bundle").load(path)
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    known = bundle_source.manifest(path)
    assert known["rows"] == 40 == sum(p["rows"] for p in known["parts"]) and {x.problem for x in bundle_source.verified(spark, path).collect()} == {None}
    with pytest.raises(Exception, match="already"):
        df.write.format("sealed_bundle").mode("append").save(path)
    assert spark.read.format("sealed_bundle").load(path).count() == 40
    df.limit(5).write.format("sealed_bundle").mode("overwrite").save(path)
    assert spark.read.format("sealed_bundle").load(path).count() == 5 and sum(n.startswith("part-") for n in os.listdir(path)) == len(bundle_source.manifest(path)["parts"])
    part = os.path.join(path, bundle_source.manifest(path)["parts"][0]["name"])
    data = open(part, "rb").read()
    open(part, "wb").write(data.replace(b'"i":1', b'"i":3', 1))
    with pytest.raises(Exception, match="checksum mismatch"):
        spark.read.format("sealed_bundle").load(path).collect()
    assert [x.problem for x in bundle_source.verified(spark, path).where("problem is not null").collect()] == ["checksum_mismatch"]
    os.remove(part)
    with pytest.raises(Exception, match="has no"):
        spark.read.format("sealed_bundle").load(path).collect()
    spark.createDataFrame([], schema).write.format("sealed_bundle").mode("overwrite").save(str(tmp_path / "none"))
    assert spark.read.format("sealed_bundle").load(str(tmp_path / "none")).count() == 0

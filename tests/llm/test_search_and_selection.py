"""Secret scans, importance resampling and collocations against plain loops, and over nulls, long texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from mnemos.llm import collocations, importance, secret_scan
from tests.llm.conftest import EDGE
from tests.llm.test_operators import ALNUM, LOWER, docs_of, words

# 11 secrets


def secrets_of(text, rules=secret_scan.RULES):
    """(start, kind, end) by start, then rule: the first three kinds by their plain forms."""
    forms = [
        (re.compile(secret_scan.BASE[0].pattern, re.A), lambda m: len(m[2]) >= 6),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
        *((re.compile(r.pattern), lambda m: True) for r in rules[3:]),
    ]
    found = sorted((m.start(), i, m.end()) for i, (p, ok) in enumerate(forms) for m in p.finditer(text or "") if ok(m))
    return [(rules[i].kind, s, e) for s, i, e in found]


def digest_of(text):
    found = secrets_of(text)
    base = [f for f in found if f[0] in ("assign", "access", "hex")]
    joined = lambda rows: ",".join(f"{k}:{s}:{e}" for k, s, e in rows)
    return (*(sum(f[0] == k for f in base) for k in ("assign", "access", "hex")), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found))


A = "Ab3" * 20
PLANTED = [
    "no secret here, only a token of thanks and a password policy",
    'token = "abc123xyz" and PassWord: hunter2hunter2, api_key=short, APIKEY=longenough',
    "password=token:abcdefgh1 secret=secret=secretpassword:x passwd='a b'",
    "é😀 AKIA" + "Z9" * 8 + " AKIAAKIAAKIA AKIA" + "0" * 40,
    "deadbeef" * 3 + " " + "deadbeef" * 2 + "g" + "0123456789abcdef" * 4,
    f"ghp_{A}{A} glpat-{A} xoxb-{A} AIza{A[:35]} sk_live_{A} rk_test_{A}",
    f"SG.{A[:22]}.{A[:43]} npm_{A[:36]} eyJ{A}.eyJ{A}.{A}",
    "-----BEGIN RSA PRIVATE KEY----- https://user:pa55word@example.com/x Bearer " + A,
    "wörter " * 20_000 + "token=abcdef1234 " + "x" * 5000 + " AKIA" + "Q" * 16,
    "token=abcdef12 " * 2000,
    "",
    None,
]


def test_secrets_of_every_kind_are_placed(spark):
    docs = spark.createDataFrame(list(enumerate(PLANTED)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in secret_scan.digest(secret_scan.scanned(docs)).collect()}
    for i, text in enumerate(PLANTED):
        assert got[i] == digest_of(text), i
    kinds = {x.split(":")[0] for r in got.values() for x in r[-1].split(",") if x}
    assert kinds == {r.kind for r in secret_scan.RULES}


def test_secrets_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = secret_scan.digest(secret_scan.scanned(docs)).collect()
    assert len(rows) == len(texts) and all(tuple(r)[1:] == digest_of(texts[r.doc_id]) for r in rows)
    assert sum(r.n_assign for r in rows) > 5


def test_rules_ask_for_trigrams_that_every_match_has():
    asked = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert asked["hex"] is None and all(v for k, v in asked.items() if k != "hex")
    for text in PLANTED:
        for kind, s, e in secrets_of(text):
            match = text[s:e].lower()
            assert asked[kind] is None or any(all(g in match for g in grams) for grams in asked[kind])
    q = secret_scan.trigram_query
    assert q("abcd") == [{"abc", "bcd"}] and q("ab+c") is None and q("a[xy]b") == [{"axb"}, {"ayb"}]
    assert q("(foo|ba)x*bar") == [{"bar"}] and q("fo{2}d") == [{"foo", "ood"}] and q("x*") is None and q("(?:abc)?def") == [{"def"}]


def test_many_candidates_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(PLANTED)), "doc_id int, text string")
    want = sorted(map(tuple, secret_scan.digest(secret_scan.scanned(docs)).collect()))
    monkeypatch.setattr(secret_scan, "BROADCAST_KEYS", 1)
    monkeypatch.setattr(secret_scan, "SHARD", 3)
    assert sorted(map(tuple, secret_scan.digest(secret_scan.scanned(docs)).collect())) == want


def test_secrets_of_edge_rows(edge, empty):
    got = secret_scan.scanned(edge("Secrets"))
    assert got.count() == len(EDGE) and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "secrets", "base_secrets"]
    assert secret_scan.scanned(edge("_key")).columns[5] == "_key"
    assert secret_scan.scanned(empty).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


# 12 importance resampling


def resampled_by_loop(docs, target, length, buckets, seed, least, percent):
    def grams(text):
        w = words(text)
        return [" ".join(w[i : i + k]) for k in range(1, length + 1) for i in range(len(w) - k + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)))
    for text in target:
        t.update(map(bucket, grams(text)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for key, text in docs:
        f = grams(text)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(may[: len(may) * percent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("length", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 35)])
def test_draw_towards_a_target(spark, sf, length, buckets, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = importance.resampled(docs, target, length=length, buckets=buckets, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == resampled_by_loop(docs_of(spark, sf), [r.text for r in target.collect()], length, buckets, 2024, 20, percent)
    assert sum(r.rank is not None for r in got) > 5


def test_draw_of_edge_rows(spark, edge, empty):
    target = spark.createDataFrame([("seven wizards boil water", 1), (None, 2)], "text string, _id int")
    got = importance.resampled(edge("score"), target, least_words=3, percent=60)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_loop([r[:2] for r in EDGE], ["seven wizards boil water", None], 1, 10_000, 2024, 3, 60)
    assert importance.resampled(empty, target).count() == 0
    assert importance.resampled(edge("rank"), target.limit(0)).count() == len(EDGE)


# 13 collocations


def collocations_by_loop(docs, longest, least, within, top):
    f, n, out = collections.Counter(), collections.Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = collections.defaultdict(int)
    for (lang, w), a in frequent.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inside[lang, w[i : i + size]] = max(inside[lang, w[i : i + size]], a)
    for (lang, w), a in frequent.items():
        if 100 * inside[lang, w] >= within * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, rows = collections.Counter(), []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            rows.append((r[0], rank[r[0]], *r[1:]))
    return sorted(rows)


def mined(docs, *a):
    return sorted(map(tuple, collocations.collocations(docs, *a).collect()))


@pytest.mark.parametrize("settings", [(3, 10, 50, 2000), (4, 4, 80, 30), (2, 5, 50, 100)])
def test_collocations(spark, sf, settings):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    want = collocations_by_loop([(r.lang, r.text) for r in docs.collect()], *settings)
    assert mined(docs, *settings) == want and len(want) > 50


def test_a_crowded_bit_table_changes_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = mined(docs)
    monkeypatch.setattr(collocations, "BITS", 1 << 8)
    monkeypatch.setattr(collocations, "PART", 1 << 14)
    assert mined(docs) == want


def test_collocations_of_edge_rows(spark, edge, empty):
    rows = [*((r[2], r[1]) for r in EDGE), ("und", "One two\tthree, one  two. One two"), (None, "one two\x0bthree"), ("x\ny", "é \x00 é \x00 é"), ("x", "x x x x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int").repartition(2)
    assert mined(docs, 3, 2, 50, 9) == collocations_by_loop(rows, 3, 2, 50, 9)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(edge("f"), 3, 2).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_words_are_those_of_the_pattern():
    assert importance.WORD == ALNUM

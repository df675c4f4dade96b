"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query: alternatives, each a set of trigrams that a match must hold. The trigrams that
rules ask for are indexed: postings are lists of documents, by trigram and shard. A rule's candidates are the documents that are in all lists of one of
its alternatives, and only those are searched with the rule. Rules without mandatory trigrams search every text. All of it is DataFrame functions.
"""

import re
from re import _constants as op
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.columns import let, places
from mnemos.llm.graph import cut
from mnemos.llm.words import sheltered

#: Documents in a shard of the index; most alternatives of a rule; most candidate keys that are broadcast.
SHARD, ALTERNATIVES, BROADCAST_KEYS = 1 << 16, 64, 500_000


class Rule(NamedTuple):
    """What a kind of secret looks like; a match stays if `group` (0: all of it) has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# What counts as a secret. In the first three, maximal runs of at least that length are the runs of any length that are long enough.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public formats of keys and tokens.
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,128}@"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
)


def _lower(code: int) -> str:
    return chr(code + 32 if 65 <= code <= 90 else code)


def _choices(items: list, most: int = 6) -> set[str] | None:
    """The characters of a small class, in lower case; None for others."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(_lower(value))
        elif kind is op.RANGE and value[1] - value[0] < most:
            found |= {_lower(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= most else None


def _extended(states: set, chars: set[str]) -> set:
    """Each state (last two characters, trigrams so far) with each of the characters after it."""
    out = set()
    for tail, grams in states:
        for c in chars:
            text = tail + c
            out.add((text[-2:], grams | {text} if len(text) == 3 else grams))
    return out


def _broken(states: set) -> set:
    """The states when something unknown stands next."""
    return {("", grams) for _, grams in states}


def _walked(nodes, states: set) -> set:
    for kind, value in nodes:
        if kind is op.LITERAL:
            states = _extended(states, {_lower(value)})
        elif kind is op.IN and (chars := _choices(value)):
            states = _extended(states, chars)
        elif kind is op.BRANCH:
            states = set().union(*(_walked(branch, states) for branch in value[1]))
        elif kind is op.SUBPATTERN:
            states = _walked(value[3], states)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            passed = states
            for _ in range(min(least, 3)):
                passed = _walked(inner, passed)
            more = _walked(inner, passed) if (least, most) == (0, 1) else _broken(passed)
            states = passed if least == most <= 3 else _broken(passed) if least else passed | more
        elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):
            states = _broken(states)
        if len(states) > ALTERNATIVES:
            grams = {g for _, g in states}
            least = {g for g in grams if not any(g > other for other in grams)}
            states = {("", g) for g in least} if len(least) <= ALTERNATIVES else {("", frozenset.intersection(*least))}
    return states


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of which one has all its trigrams in the lower-cased text of every match; None where a match needs no trigram.

    The pattern is read as Python and Java both do. Small classes and options give alternatives; with too many of these only the trigrams
    that all of them ask for are kept.
    """
    found = {grams for _, grams in _walked(_parser.parse(pattern), {("", frozenset())})}
    least = [a for a in found if not any(b < a for b in found)]
    return None if frozenset() in least else sorted(least, key=sorted)


def postings(keyed: DataFrame, trigrams: list[str], shards: int) -> DataFrame:
    """(shard, gram, keys): the sorted keys of a shard's documents (_key, text) that hold a trigram, letters without case.

    Only the given trigrams are indexed: no query reads another's list. A list has no more keys than a shard has documents.
    """
    held = let(F.lower("text"), lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))
    rows = keyed.select("_key", F.explode(held).alias("gram")).withColumn("shard", F.pmod(F.hash("_key"), F.lit(shards)))
    return rows.groupBy("shard", "gram").agg(F.sort_array(F.collect_set("_key")).alias("keys"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(_key, rules): the documents that are in all lists of an alternative of a rule, and the numbers of those rules."""
    asked = [(rule, i, len(grams), g) for rule, found in queries.items() for i, grams in enumerate(found) for g in sorted(grams)]
    wanted = index.sparkSession.createDataFrame(asked, "rule int, alternative int, wanted int, gram string").coalesce(1)
    lists = index.join(F.broadcast(wanted), "gram").groupBy("shard", "rule", "alternative", "wanted")
    shortest_first = F.transform(F.array_sort(F.collect_list(F.struct(F.size("keys").alias("n"), "keys"))), lambda x: x["keys"])
    met = lists.agg(shortest_first.alias("lists")).where(F.size("lists") == F.col("wanted"))
    both = F.aggregate(F.slice("lists", 2, ALTERNATIVES * 64), F.col("lists")[0], F.array_intersect)
    return met.select("rule", F.explode(both).alias("_key")).groupBy("_key").agg(F.collect_set("rule").alias("rules"))


def _found(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, number, kind, end>> of a rule's matches that are long enough."""
    size = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else F.length(m)
    kept = F.filter(places(text, rule.pattern), lambda p: size(p["match"]) >= rule.least)
    return F.transform(kept, lambda p: F.struct(p["start"], F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), p["end"]))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, rules=RULES, base: int = len(BASE)) -> DataFrame:
    """docs with secrets (array<struct<start, number, kind, end>> by start, then rule), base_secrets (those of the first `base` rules).

    Places count characters from 0, ends are exclusive; matches of one rule don't overlap, those of different rules may. A null text counts as
    empty; empty texts have no secrets; long texts are read whole. Documents are indexed by a hash of doc_id, nulls too: rows that share it are
    candidates together, and each is searched by itself, so repeated rows each get their result. Other columns stay whatever their names are, but for
    those two, which are replaced. An empty table stays empty. Candidates are broadcast if they are few; if not, texts are joined with them by a shuffle.
    """
    plain, own = sheltered(docs.select(*(c for c in docs.columns if c.lower() not in ("secrets", "base_secrets"))))
    keyed = plain.withColumns({"_key": F.xxhash64("doc_id"), "_text": F.coalesce("text", F.lit(""))})
    queries = {i: found for i, rule in enumerate(rules) if (found := trigram_query(rule.pattern)) is not None}
    trigrams = sorted({g for found in queries.values() for grams in found for g in grams})
    every = [i for i in range(len(rules)) if i not in queries]
    met = keyed.withColumn("rules", F.array().cast("array<int>"))
    if trigrams:
        shards = 1 + docs.count() // SHARD
        found = cut(candidates(postings(keyed.select("_key", F.col("_text").alias("text")), trigrams, shards), queries))
        few = found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        met = keyed.join(F.broadcast(found) if few else found, "_key", "left")
    none = F.array().cast("array<struct<start:bigint,number:int,kind:string,end:bigint>>")
    tried = lambda i, rule: F.col("_text").rlike(rule.pattern) if i in every else F.coalesce(F.array_contains("rules", i), F.lit(False))
    all_found = F.concat(*(F.when(tried(i, rule), _found(F.col("_text"), rule, i)).otherwise(none) for i, rule in enumerate(rules)))
    spans = met.select(*plain.columns, F.array_sort(all_found).alias("secrets"))
    return own(spans.withColumn("base_secrets", F.filter("secrets", lambda s: s["number"] < base)))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of the rows of `scanned`."""
    count = lambda kind: F.size(F.filter("base_secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(count(rule.kind) for rule in BASE), F.sha2(_joined(F.col("base_secrets")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))

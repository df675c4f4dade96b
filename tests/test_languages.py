"""Formulas against Python's own answers, stored queries against plain loops."""

import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.functions.formula import FormulaError, compiled, with_formulas
from mnemos.operators import query_text
from mnemos.operators.needles import met

ROWS = [(i, x, s, b, l, {"k": i or 0, "z": 2}) for (i, x), (s, b), l in itertools.product([(7, -2.5), (-7, 2.0), (0, 0.0), (None, 1.5)], [("open", True), ("", False), (None, None)], [["a", "open"], [], None])]
SCHEMA = "i bigint, x double, s string, b boolean, l array<string>, m map<string,bigint>"
FORMULAS = """
i + 2 * 3 - 1
(i + 2) * 3
i // 3
-i // 3
i % 3
i % -3
x // 2 + x % 2
x // -0.7
i / 4
i / x
i ** 3
2 ** i
x ** 2
-i ** 2
+b + 1
i < 3 < x
0 <= i <= 10 and s == "open"
s == "open" or x > 1
not s
not l or i
"big" if i > 3 else "small"
i if b else x
len(s) + len(l)
s in l
"a" not in l
"pe" in s
s + "!" * 2
l[0]
l[-1]
s[1]
m["k"] + m["z"]
m["none"]
{"open": 1, "": 2}[s]
[1, 2.5, i][2]
i in [7, 8] and i != None
s == None
s != "x"
i == 7.0
b == 1
l == ["a", "open"]
(i == 0) == (x == 0)
1 if s == None else len(s)
i > 0 and 10 / i > 1
i != 0 != 10 // i
9223372036854775807 + i
"k" in m
x < i < s if s == "zzz" else True
""".strip().splitlines()


@pytest.mark.parametrize("formula", FORMULAS)
def test_formula(spark, formula):
    """As Python has it, but that `and` and `or` look at all of their parts and give true or false."""
    import ast

    class Whole(ast.NodeTransformer):
        def visit_BoolOp(self, node):
            self.generic_visit(node)
            name = "all" if isinstance(node.op, ast.And) else "any"
            return ast.Call(ast.Name(name, ast.Load()), [ast.List(node.values, ast.Load())], [])

    rows = spark.createDataFrame(ROWS, SCHEMA)
    if formula == "x < i < s if s == \"zzz\" else True":
        with pytest.raises(FormulaError):
            compiled(formula, rows.schema)
        return
    code = compile(ast.fix_missing_locations(Whole().visit(ast.parse(formula, mode="eval"))), "f", "eval")
    value, error = compiled(formula, rows.schema)
    for r in rows.select("*", value.alias("_v"), error.alias("_e")).collect():
        names = {c: r[c] for c in rows.columns}
        try:
            want = eval(code, {"__builtins__": {"len": len, "all": all, "any": any}}, names)
            want = None if isinstance(want, int) and not -(2**63) <= want < 2**63 else want
            wrong = want is None and formula.startswith("922")
        except (TypeError, ZeroDivisionError, KeyError, IndexError):
            want, wrong = None, True
        assert (r._e is not None) == wrong, (formula, names, r._e)
        assert r._v == want or isinstance(want, float) and abs(r._v - want) < 1e-12, (formula, names, r._v, want)


@pytest.mark.parametrize("formula", ["", "x +", "y", "x.real", "len(x)", "len(s, s)", "str(x)", "s * s", "s < x", "x in s", "l[0:1]", "lambda: 1", "s @ s", "{**m}", "[1, 'a']", "1 if b else 's'", "~i", "i << 2", "f'{s}'", "x is None", "[i for i in l]", "99999999999999999999"])
def test_formulas_that_cannot_be(spark, formula):
    with pytest.raises(FormulaError):
        compiled(formula, T._parse_datatype_string(SCHEMA))


def test_times_in_formulas(spark):
    rows = spark.createDataFrame([("2024-01-05T00:00:00Z", "2024-01-05T02:00:00+01:00"), ("2024-01-06", None), ("soon", "2024-01-01")], "a string, b string")
    got = with_formulas(rows, {"later": "a < b", "same": "a == a", "none": "b == None"}, ("a", "b")).collect()
    assert [(r.later, r.later_error, r.none) for r in got] == [(True, None, False), (None, "nothing where a value is needed", True), (None, "not a time", False)]


RECORDS = [
    ("r1", "Alpha plan", "k1", "The first text about Spark and ing", ["#Red", "x"], "notes/a.md", {"kind": "plan", "n": "1"}),
    ("r2", "Beta", None, "first aid; alpha beta", ["red"], "notes/sub/b.md", {"kind": "plan"}),
    ("r3", "Gamma ray", "k3", None, None, "c.md", None),
    ("r4", None, None, "ab", ["blue"], None, {"kind": "note", "tags": '["#Listed", "b"]'}),
]
LINKS = [("r1", "Beta", "r2", "supports"), ("r1", "Beta", "r2", "supports"), ("r2", "c.md", "r3", "related_to")]
BLOCKS = [("r1", "b1", "paragraph", None, "do it now"), ("r1", "b2", "heading", "part-one", "Part One"), ("r3", "b1", "heading", "b9", "do it")]
QUERIES = {
    "alpha": {"r1", "r2"}, '"first aid" #red': {"r2"}, "[kind:plan] first": {"r1", "r2"}, "[kind:plan] [n:1]": {"r1"}, "[kind:x] [kind:note]": {"r4"}, "#RED": {"r1", "r2"}, "tag:#red path:SUB": {"r2"},
    "file:B.MD": {"r2"}, "content:alpha": {"r2"}, "link_to:Beta": {"r1"}, "linked_from:r1": {"r2"}, "relation_type:supports alpha": {"r1"}, "block:b1": {"r1", "r3"}, "block:b1 section:part-one": {"r1"}, "section:part-one section:b9": {"r3"}, "task:DO": {"r1", "r3"}, "#listed": {"r4"},
    "task:it": {"r1", "r3"}, "a b": {"r1", "r2", "r4"}, "ab sort:title": {"r1", "r4"}, "nowhere alpha": set(), '"': {"r4"}, "first first FIRST": {"r1", "r2"}, "tag:": None, "color:red": None, "sort:size": None, "": None, "  \n": None, "sort:title": None, '[:x] "a b"': None, "[k:v": None,
}


def test_stored_queries(spark):
    records = spark.createDataFrame(RECORDS, "id string, title string, key string, content string, tags array<string>, path string, properties map<string,string>").repartition(3)
    links = spark.createDataFrame(LINKS, "source_record_id string, raw_target string, target_record_id string, relation_type string")
    blocks = spark.createDataFrame(BLOCKS, "record_id string, block_id string, block_type string, anchor string, excerpt string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string").unionByName(spark.createDataFrame([(99, None)], "query_id int, query string"))
    found, errors = query_text.found(queries, records, links, blocks)
    got = {}
    for r in found.collect():
        assert r.id not in got.setdefault(r.query_id, set())
        got[r.query_id].add(r.id)
    bad = {r.query_id: r.error for r in errors.collect()}
    for i, (q, want) in enumerate(QUERIES.items()):
        assert (i in bad) == (want is None), (q, bad.get(i))
        assert got.get(i, set()) == (want or set()), q
    assert bad[99] == "query is required" and bad[list(QUERIES).index("color:red")] == "unsupported operator: color"
    none, _ = query_text.found(queries, records.limit(0), links, blocks)
    assert none.count() == 0 and query_text.found(queries.limit(0), records)[0].count() == 0


def test_parts_of_a_query(spark):
    q = spark.createDataFrame([(1, 'a "b  c" [k: v w] #T tag:##U path:x:y path:z')], "query_id int, query string")
    got = sorted((r.position, r.kind, r.name, r.value) for r in query_text.parsed(q).collect())
    assert got == [(0, "term", None, "a"), (1, "phrase", None, "b  c"), (2, "property", "k", "v w"), (3, "tag", None, "t"), (4, "tag", None, "u"), (6, "field", "path", "z")]


def test_needles_are_met_by_their_rarest_run(spark):
    import random

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé😀") for _ in range(n))
    texts = [(i, word(r.randrange(0, 60))) for i in range(80)] + [(80, None), (81, "aaa" * 50)]
    needles = [(i, word(r.randrange(0, 6))) for i in range(60)] + [(60, "aaa"), (61, None), (61, "b"), (62, "zzz")]
    got = met(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(needles, "needle_id int, needle string"))
    assert sorted(map(tuple, got.collect())) == sorted({(i, j) for i, t in texts for j, n in needles if t and n and n in t})


def test_a_common_beginning_makes_no_pairs(spark):
    """Names that begin alike, and texts that have the beginning: candidates follow the matches, not the product."""
    texts = spark.range(300).select("id", F.concat(F.lit("document number "), F.col("id") * 1009).alias("text"))
    needles = spark.range(300).select(F.col("id").alias("needle_id"), F.concat(F.lit("document "), F.sha2(F.col("id").cast("string"), 256)).alias("needle"))
    assert met(texts, needles).count() == 0

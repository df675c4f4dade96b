"""Work that must not grow with pairs: rows that the joins of a plan make, and the SQL of queries whose given tables have odd rows."""

from pyspark.sql import functions as F

from mnemos.functions import markdown


def rows_of_joins(df):
    """The rows of a DataFrame, and the most rows that a join in its plan made."""
    rows, most, open_ = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            open_.append(node.executedPlan())
        elif "QueryStage" in name or "ReusedExchange" in name:
            open_.append(node.plan() if "QueryStage" in name else node.child())
        children = node.children()
        open_.extend(children.apply(i) for i in range(children.size()))
        made = node.metrics().get("numOutputRows")
        if "Join" in name and made.isDefined():
            most = max(most, made.get().value())
    return rows, most


def test_links_and_records_of_one_name_make_no_pairs(spark):
    k = F.col("id") % 3
    records = spark.range(300).select(F.concat(F.lit("r"), "id").alias("id"), F.lit(None).cast("string").alias("path"), F.lit("Same").alias("title"), F.array(F.concat(F.lit("own "), "id")).alias("aliases"), F.when(k > 0, k.cast("string")).alias("project_id"))
    links = spark.range(300).select(F.concat(F.lit("l"), "id").alias("link_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("OWN "), "id")).alias("raw_target"), k.cast("string").alias("project_id"))
    for ids in ((), ("project_id",)):
        rows, most = rows_of_joins(markdown.resolved(links, records, ids))
        got = {r.link_id: (r.resolution_status, r.target_record_id) for r in rows}
        assert len(rows) == 300 and got == {f"l{i}": ("ambiguous", None) if i % 2 == 0 else ("resolved", f"r{i}") for i in range(300)}
        assert most <= 600


def test_needles_are_met_alike_in_tasks_and_by_joins(spark, monkeypatch):
    import random

    from mnemos.operators import needles

    r = random.Random(7)
    word = lambda n: "".join(r.choice("abé😀") for _ in range(n))
    texts = [(i, word(r.randrange(0, 60)), r.choice("xy")) for i in range(80)] + [(80, None, "x"), (81, "abab", None), (3, "abab", "x")]
    asked = [(f"n{i}", word(r.randrange(0, 6)), r.choice("xy")) for i in range(60)] + [("n60", None, "x"), ("n61", "a", None)]
    t, n = spark.createDataFrame(texts, "id int, text string, kind string"), spark.createDataFrame(asked, "needle_id string, needle string, kind string")
    want = sorted({(i, j) for i, x, a in texts for j, y, b in asked if x and y and y in x and a and a == b})
    for few, one_by_one in ((needles.FEW_NEEDLES, needles.ONE_BY_ONE), (needles.FEW_NEEDLES, 0), (0, 0)):
        monkeypatch.setattr(needles, "FEW_NEEDLES", few)
        monkeypatch.setattr(needles, "ONE_BY_ONE", one_by_one)
        assert sorted(map(tuple, needles.met(t, n, ("kind",)).collect())) == want
        assert needles.met(t, n.limit(0), ("kind",)).count() == 0


def test_few_needles_make_no_rows_of_runs(spark):
    from mnemos.operators.needles import met

    texts = spark.createDataFrame([(i, "one long text of many words " * 20) for i in range(50)], "id int, text string")
    rows, most = rows_of_joins(met(texts, spark.createDataFrame([(1, "one long"), (2, "no such")], "needle_id int, needle string")))
    assert sorted(map(tuple, rows)) == [(i, 1) for i in range(50)] and most <= 50


def test_stored_query_errors_look_up_no_record(spark, sf, monkeypatch):
    from mnemos.operators import query_text
    from mnemos.plans import language_queries

    monkeypatch.setattr(query_text, "_hits", None)
    assert language_queries.stored_query_errors(spark, sf).count() >= 0


def test_words_with_a_line_end_are_one_condition(spark, tmp_path):
    """Items whose words have a line's end, against the SQL: a record with its halves apart isn't found."""
    import duckdb

    from mnemos.plans import language_queries

    items = [(0, "Thing.\nErl two thing more"), (6, "plain words here"), (2, "a bo\ndy x"), (3, "a mid\ndle x"), (11, "q\nxyz more"), (1, "first\nx second"), (9, "x y\tz w")]
    docs = [(1, "thing.\nerl and thing", "en", "src2"), (2, "thing. and erl thing", "en", "src2"), (3, "a bo\ndy", "en", "src0"), (4, "a dy bo", "en", "src0"), (5, "mid\ndle", "de", "src3"), (6, "dle mid", "de", "src3"), (11, "q\nx", "en", "s"), (71, "xq", "en", "s"), (12, "plain here first\nx second", "en", "s"), (7, "y\tz", "de", "src2"), (8, "z y", "de", "src2")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for name in ("benchmark", "documents"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(tuple(r) for r in duck.sql(f"SELECT query_id, id FROM ({language_queries.ORACLES['stored_queries']})").fetchall())
    assert (0, "doc-1") in want and (2, "doc-3") in want and (3, "doc-5") in want and (9, "doc-7") in want
    assert sorted(map(tuple, language_queries.stored_queries(spark, str(tmp_path)).select("query_id", "id").collect())) == want


def test_inventories_are_worked_out_once(spark):
    from mnemos.operators import range_digests

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(500).select(F.lit("o").alias("object_kind"), F.col("id").cast("string").alias("object_id"), F.lit("h").alias("hash")).mapInArrow(count, "object_kind string, object_id string, hash string")
    other = rows.where("object_id <> '7'")
    assert [tuple(r) for r in range_digests.findings(rows, other, "t", 1, None).select("finding", "object_id").collect()] == [("missing", "7")]
    assert seen.value == 1000


def test_paths_work_out_the_edges_once(spark):
    from mnemos.operators import graph

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    k = F.col("id")
    edges = spark.range(60).select(F.concat(F.lit("e"), k).alias("edge_id"), F.concat(F.lit("v"), k).alias("src"), F.concat(F.lit("v"), (k + 1)).alias("dst")).mapInArrow(count, "edge_id string, src string, dst string")
    assert [[h.node for h in r.hops] for r in graph.simple_paths(edges, "v3", "v5", 3, direction="out").collect()] == [["v4", "v5"]]
    assert seen.value == 60


def test_links_of_a_long_note_cost_no_more_than_of_short_ones(spark):
    """The same links in one note and in many; a context isn't looked for from the note's start."""
    import time

    from mnemos.operators import vault

    text, seconds, rows = "[[word|é]] some words and [more](to/x.md) ", {}, {}
    for many in (200, 1):
        notes = spark.range(many, numPartitions=1).select("id", F.repeat(F.lit(text), 10_000 // many).alias("body"))
        links = vault.note_links(notes.withColumnRenamed("id", "record_id"), 10).groupBy("link_kind", "raw_target", "display", "context_after").count()
        links.limit(0).collect()
        start = time.perf_counter()
        rows[many] = {tuple(r)[:3]: 0 for r in links.collect()}
        seconds[many] = time.perf_counter() - start
    assert rows[1] == rows[200] and len(rows[1]) == 2
    assert seconds[1] <= 2 * seconds[200] + 2


def test_contexts_of_links_are_cut_at_characters(spark):
    """Against plain loops: texts of characters of one to four bytes, longer than the blocks that contexts are taken from, links at their ends and side by side."""
    import random
    import re

    from mnemos.operators import vault

    r = random.Random(11)
    part = lambda: r.choice(["[[a#B c|d]]", "![[é😀]]", "[x](y.md)", "[u](http://u)", "😀é" * r.randrange(40), "word \n" * r.randrange(30)])
    texts = [(i, "".join(part() for _ in range(r.randrange(60)))) for i in range(60)] + [(60, ""), (61, None), (62, "[[a]]"), (63, "é" * 251 + "[[a]]"), (64, "é" * 256 + "[[a]]" + "é" * 256), (65, "x" * 512 + "![[b]]")]
    notes = spark.createDataFrame(texts, "record_id long, body string")
    for around in (0, 10, 80, 300):
        want = []
        for i, t in texts:
            for kind, pattern in (("wiki", r"!?\[\[[^\]]+\]\]"), ("link", r"(?<!!)\[[^\]]*\]\([^)]+\)")):
                for m in re.finditer(pattern, t or ""):
                    a, b = m.span()
                    name = ("embed" if m[0][0] == "!" else "wikilink") if kind == "wiki" else "external" if "://" in m[0] else "markdown"
                    want.append((i, name, a, b, t[max(0, a - around) : a], t[b : b + around]))
        got = vault.note_links(notes, around).select("source_record_id", "link_kind", "start", "end", "context_before", "context_after").collect()
        assert sorted(map(tuple, got)) == sorted(want)
        both = notes.select(F.concat(markdown.wikilinks(F.col("body"), around), markdown.links(F.col("body"), around)).alias("l"), "record_id").select("record_id", F.inline("l")).select("record_id", "kind", "start", "end", "before", "after")
        assert sorted(map(tuple, both.collect())) == sorted(want)

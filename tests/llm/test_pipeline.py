import pytest
from pyspark.sql import types as T

import corpus_pipeline as pipeline
from tests.llm.conftest import COLUMNS, EDGE
from tests.llm.test_operators import contaminated, cut, families


def test_stages_do_their_part(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, sf).cache()
        after = [(r.doc_id, r.text) for r in docs.collect()]
        out[name] = before, after
        assert docs.columns[: len(columns)] == columns
    before, after = out["quality"]
    assert 0.8 * len(before) < len(after) < len(before) and set(after) <= set(before)
    before, after = out["near_duplicates"]
    label = families(before, 80)[1]
    assert sorted(i for i, _ in after) == sorted(i for i, _ in before if label[i] == i)
    before, after = out["repeated_passages"]
    removed = {d: n for d, _, n, _ in cut(before, 13)}
    assert sorted(i for i, _ in after) == sorted(i for i, _ in before)
    assert all(len(t.split()) == len(dict(before)[i].split()) - removed[i] and (removed[i] or t == dict(before)[i]) for i, t in after)
    before, after = out["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in after) == sorted(x[0] for x in contaminated(before, items) if not x[5])
    assert {i for i, _ in out["mixture"][1]} <= {i for i, _ in after}
    assert pipeline.run(spark, sf).count() == len(out["mixture"][1])


def test_near_copies_from_four_fifths_on_are_dropped(spark):
    """Of 100 words the last k differ: 86 of 106 shingles are common (0.81) for 10, 84 of 108 (0.78) for 12."""
    texts = []
    for i, k in enumerate((10, 12) * 10):
        own = [f"t{i}w{j}" for j in range(100)]
        texts += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[: 100 - k] + [f"t{i}v{j}" for j in range(k)]))]
    left = {r.doc_id for r in pipeline.no_near_duplicates(spark, spark.createDataFrame(texts, "doc_id long, text string"), "").collect()}
    assert left == {i for i, _ in texts} - {2 * i + 1 for i in range(0, 20, 2)}


OWN = ("hs", "ks", "_doc", "n_words", "n_removed", "kept_text", "kept_sha256", "score", "predicted", "items", "hits", "n_hit", "_u", "_order", "_source", "_cdf", "_salt", "a.b", "component_id", "Text ")


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_pass_columns_of_any_name_and_all_edge_rows(spark, sf, name, stage):
    """Nulls, empty and long texts, ties, repeated rows; columns that have the names of the operators' own; and the empty table."""
    rows = [(*r, *(f"{c}:{r[0]}" for c in OWN)) for r in EDGE]
    schema = T.StructType([*T._parse_datatype_string(COLUMNS.format("extra")), *(T.StructField(c, T.StringType()) for c in OWN)])
    docs = spark.createDataFrame(rows, schema).repartition(3)
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns + ["copy"] * (name == "mixture")
    got = out.collect()
    assert all(tuple(r)[6 : 6 + len(OWN)] == tuple(f"{c}:{r.doc_id}" for c in OWN) for r in got)
    assert all(r[4] in {x[4] for x in EDGE if x[0] == r.doc_id} for r in got if name != "repeated_passages")
    ids = [r.doc_id for r in got]
    if name in ("repeated_passages", "benchmark"):
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in EDGE)
    if name == "near_duplicates":
        assert 6 not in ids and 1 in ids and ids.count(9) == 2 and ids.count(None) == 1 and {2, 3, 4, 5} <= set(ids)
    if name == "quality":
        assert ids.count(9) in (0, 2)
    if name == "mixture":
        assert ids.count(9) % 2 == 0
    assert stage(spark, docs.limit(0), sf).count() == 0

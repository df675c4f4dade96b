"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from mnemos.plans.registry import all_queries

QUERIES, SQL = all_queries()


def normal(df, columns):
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        return repr(round(float(v), 9) + 0.0) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(text, row)) for row in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got, sorted(got.columns)) == normal(want, sorted(got.columns))
    else:
        assert len(got) > 0


def test_entry_points_name_the_same_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_the_rest_works_without_the_optional_part(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("mnemos.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "mnemos.llm", None)
    monkeypatch.setitem(sys.modules, "mnemos.llm.queries", None)
    assert set(entry.queries()) == set(QUERIES)

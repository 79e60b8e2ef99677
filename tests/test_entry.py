import importlib
import sys

import pandas as pd
import pytest

import __spark_entry__ as entry


def test_flagship_and_registry(spark):
    assert entry.entry(spark).limit(5).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_text_subpackage(monkeypatch):
    for name in [x for x in sys.modules if x.startswith("twinbook.llm")]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("twinbook.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert "p1_found" in entry.queries() and "p3_found" not in entry.queries()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "k_markets p_markets book_frames book_streams feeds pair_labels lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    ours = entry.queries()[name](spark, folder)
    theirs = con.sql(entry.oracle_sql()[name])

    def plain(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, str) else round(float(v), 6)

    def rows(pdf):
        return sorted(repr([plain(v) for v in r]) for r in pdf[sorted(pdf.columns)].values.tolist())

    assert rows(ours.toPandas()) == rows(theirs.df())

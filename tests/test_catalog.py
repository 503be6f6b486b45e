"""Every query with SQL against DuckDB, the others for rows."""

import duckdb
import pandas as pd
import pytest

from turnstile.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    a = catalog.queries()[name](spark, sf).toPandas()
    b = duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    by = [c for c in cols if not pd.api.types.is_float_dtype(a[c])] or cols
    a, b = (x[cols].sort_values(by).reset_index(drop=True) for x in (a, b))
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), a[~same].head().to_string() + b[~same].head().to_string()


@pytest.mark.parametrize("name", ["team_rating_future", "player_rating", "normal_distribution", "model_pipeline", "net_over_predicted"])
def test_has_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).limit(5).count() > 0


def test_entry_without_llm(spark, sf, monkeypatch):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.setattr(e, "_llm", lambda: None)
    assert e.queries().keys() == catalog.queries().keys()
    assert e.entry(spark).limit(1).count() == 1

"""Every registered relational query against its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from docweave import queries as q


def _rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return cols, sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_is_its_sql(spark, sf, duck, name):
    assert _rows(q.queries()[name](spark, sf).toPandas()) == _rows(duck.sql(q.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query of the package runs, and equals its SQL in DuckDB."""

import os
from datetime import date

import duckdb
import pytest

from textsieve.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, date) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        r = db.sql(sql)
        assert sorted(r.columns) == cols
        assert rows == sorted(repr([plain(v) for v in x]) for x in r.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from linkloom import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(float(value), 6) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    sql = catalogue.oracle_sql()[name]
    columns = sorted(got.columns)
    assert sorted(duck.sql(sql).columns) == columns
    names = ", ".join('"' + c + '"' for c in columns)
    want = duck.sql(f"SELECT {names} FROM ({sql})").fetchall()
    assert sorted(repr(plain(tuple(r))) for r in got.select(*columns).collect()) == sorted(repr(plain(r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalogue.flagship(spark, sf).count() > 0

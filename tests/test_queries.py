"""Every registered query against its SQL on DuckDB, on whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry


@pytest.fixture(scope="session")
def views(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(frame):
    def value(x):
        if x is None or x != x:
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(repr([value(x) for x in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, views, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert plain(got) == plain(views.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    got = entry.queries()[name](spark, sf)
    # Nothing to compare with here (tests/test_operators.py has the cases): rows, and a name for each column.
    assert got.columns == list(dict.fromkeys(got.columns)) and (got.count() > 0 or name == "pennant_candidates")


def test_entry(spark):
    assert entry.entry(spark).columns == ["symbol", "ts_s", "volume_mean20", "volume_ratio20"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

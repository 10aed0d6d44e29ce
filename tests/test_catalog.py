"""Every registered query against DuckDB on the same tables, or its invariants where SQL has no form for it."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, str):
        return value
    if "bool" in type(value).__name__:
        return bool(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return None if number != number else number


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(request):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.execute(catalog.ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

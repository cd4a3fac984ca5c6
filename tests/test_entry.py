"""Every query runs on the smallest tables; those with SQL equal DuckDB's result."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    result = entry.queries()[name](spark, SF)
    columns = sorted(result.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in result.collect())
    if name not in entry.oracle_sql():
        return
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = db.sql(entry.oracle_sql()[name])
        order = [found.columns.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

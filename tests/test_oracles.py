"""Every registered query runs; those with an oracle agree with DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tectra.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 4) + 0.0
        return v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert canon([tuple(r) for r in found.collect()], found.columns) == canon(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from synteny_spark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows, at):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in (r[i] for i in at)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(got, [df.columns.index(c) for c in want.columns]) == normal(want.fetchall(), range(len(want.columns)))


def test_entry(spark):
    assert entry.entry(spark).count() == 52 and set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())

"""Every query that has SQL gives the SQL's rows on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from loomgrain.plans.registry import QUERIES, SQL

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_plain, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(_plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert got == want
    spark.catalog.clearCache()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)

"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tarnsift.plans import rules, slate  # noqa: F401  (rules adds its queries)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(slate.ORACLES))
def test_query(spark, db, name):
    got = slate.QUERIES[name](spark, DIR)
    result = db.execute(slate.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(slate.QUERIES) - set(slate.ORACLES)))
def test_query_without_sql(spark, name):
    assert slate.QUERIES[name](spark, DIR).count() >= 1

"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from cadenza.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        return repr(round(float(v), 6))

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    expected = duck.sql(catalogue.ORACLES[name])
    assert columns == sorted(expected.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    assert plain(found.select(*[f"`{c}`" for c in columns]).collect()) == plain(expected.project(names).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def names():
    from tickframe import catalogue

    return list(catalogue.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from tickframe import catalogue

    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    found = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(repr([r[columns.index(c)] for c in order]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in order]) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

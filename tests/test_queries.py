"""Every registered query against its DuckDB equivalent on the small tables, and the driver contract."""

import duckdb
import pytest

import __spark_entry__
from stratalens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([None if r[i] is None or r[i] != r[i] else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_against_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert canonical(got, df.columns) == canonical(rows, columns)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["rank", "concept_id", "score"] and df.count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

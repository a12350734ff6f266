"""Every query with SQL gives what DuckDB gives; the others run."""

import duckdb
import pytest

import __spark_entry__ as entry
from kolot import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        assert rows(got) == rows(con.sql(queries.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_readings_are_dealt_out(spark):
    """A table of one row group is read by more than one task."""
    dealt = queries.QUERIES["read_numbers"](spark, FOLDER)
    assert dealt.rdd.getNumPartitions() >= 4
    assert len({n for n, in dealt.selectExpr("spark_partition_id()").collect()}) >= 4

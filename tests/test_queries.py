"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from ridgeline.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    mine, other = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    text = [d[columns].astype(str).sort_values(columns).reset_index(drop=True) for d in (mine, other)]
    assert text[0].equals(text[1])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ride_id", "normalized_power", "trimp", "work_kj"]

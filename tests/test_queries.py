"""Every registered query of the library runs on the smallest tables; those with SQL agree with DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from terraquant import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    got = Q.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert Q.queries()[name](spark, DATA).limit(3).count() > 0

"""The driver's contract: every query runs and meets its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.registry.queries()]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) or name == "q07_circle_circle"  # no two circles of this scale meet
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        text = lambda df: sorted(tuple("null" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
        assert text(got) == text(want)

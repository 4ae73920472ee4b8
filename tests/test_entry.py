"""The contract of __spark_entry__: names, oracles, and equality with SQL on the smallest tables."""

import importlib

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def entry_module():
    return importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_entry_gives_rows(spark):
    df = entry_module().entry(spark)
    assert df.columns and df.count() > 0


def test_oracles_belong_to_queries():
    e = entry_module()
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 100


SOME = ["j01_asof_snapshot_long", "j02_batched_snapshots", "t01_transform_codes", "v01_releases", "e04_win_rates", "p06_months_to_release", "s06_version_ingest", "k06_common_periods"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, name):
    e = entry_module()
    a, b = e.queries()[name](spark, DATA).toPandas(), con.execute(e.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)

    def norm(x):
        x = x[sorted(x.columns)]
        return sorted(tuple("null" if pd.isna(v) else f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in x.itertuples(index=False))

    assert norm(a) == norm(b)

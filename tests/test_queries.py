"""Every query with SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x.item() if hasattr(x, "item") else x)
    null = {"nan", "None", "<NA>", "NaT"}
    out = []
    for r in df.itertuples(index=False):
        values = [plain(x) for x in r]
        values = ["" if v in null else v[:-2] if v.endswith(".0") else v for v in values]
        out.append(tuple(values))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)

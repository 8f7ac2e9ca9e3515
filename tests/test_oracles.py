"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from loam import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    def value(v):
        if v is None or not hasattr(v, "__len__") and pd.isna(v):
            return None
        if hasattr(v, "item") and not hasattr(v, "__len__"):
            v = v.item()
        if isinstance(v, float) and math.isfinite(v) and v == int(v):
            v = int(v)
        return str(v)

    columns = sorted(df.columns)
    return columns, sorted((tuple(value(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert normal(got) == normal(db.execute(SQL[name]).df())
    else:
        assert len(got.columns)

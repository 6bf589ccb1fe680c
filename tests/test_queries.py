"""Every query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quire.plans.oracles import ORACLES
from quire.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if not isinstance(x, str) and pd.isna(x):
        return None
    return x if isinstance(x, str) else str(x) if isinstance(x, pd.Timestamp) else round(float(x), 6) + 0.0


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(value, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got) or name == "column_gutters"  # pages of the smallest tables have too few glyphs
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

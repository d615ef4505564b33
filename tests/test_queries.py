"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark import queries as q

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return f"{float(x):.9g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_twin(spark, duck, name):
    mine, twin = q.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(q.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(twin.columns)
    assert rows(mine) == rows(twin)

"""Every timeline query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from chronoline.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cells(df):
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    show = lambda v: None if v is None else round(float(v), 5) if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(show(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert cells(got) == cells(expected)

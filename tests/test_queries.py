"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from indemna.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x is pd.NaT or x is pd.NA or x != x else round(float(x), 8) + 0.0 if isinstance(x, float) else str(x)
    return sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    numeric = lambda rows: [tuple(float(x) if isinstance(x, str) and x.lstrip("-").replace(".", "", 1).isdigit() else x for x in r) for r in rows]
    assert sorted(numeric(a), key=repr) == sorted(numeric(b), key=repr)

"""The registered queries: those with SQL against it, and the columns and folds of some that have none."""

from __future__ import annotations

import zlib

import duckdb
import pytest

from indemna.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_folds(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name, folds, fold in (("op2_language", 5, 0), ("op3_quality", 3, 1)):
        rows = QUERIES[name](spark, FOLDER).collect()
        assert len(rows) == docs and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 for r in rows)

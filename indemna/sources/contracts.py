"""Checks that a source keeps its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; an error that names the columns that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"the source lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def row_count(df: DataFrame, source: str, expected: int | None = None) -> DataFrame:
    """(source, actual, expected, ok) in one row; without an expected number any row will do."""
    n = F.count("*")
    ok = n > 0 if expected is None else n == expected
    return df.agg(n.alias("actual"), F.lit(expected).cast("long").alias("expected"), ok.alias("ok")).select(F.lit(source).alias("source"), "actual", "expected", "ok")

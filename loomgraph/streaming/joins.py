"""Joins of two streams within an interval of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, before: str, after: str, late: str, how: str = "inner") -> DataFrame:
    """Rows of a key whose right stamp lies from ``before`` before to ``after`` after the left one, both ends included.

    Both sides have a watermark that runs ``late`` behind, so state is bounded by
    the interval, late rows are left out, and with an outer ``how`` a row that
    found no partner comes out, with nulls, once the watermark says that none can
    come. Columns but the key must differ; the key comes once.
    """
    a = left.withWatermark(left_ts, late).alias("a")
    b = right.withWatermark(right_ts, late).withColumnRenamed(key, "_key").alias("b")
    near = (F.col(right_ts) >= F.col(left_ts) - F.expr(f"INTERVAL {before}")) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {after}"))
    joined = a.join(b, (F.col(f"a.{key}") == F.col("b._key")) & near, how)
    return joined.select(F.coalesce(f"a.{key}", "b._key").alias(key), *[c for c in left.columns if c != key], *[c for c in right.columns if c != key])

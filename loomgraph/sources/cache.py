"""A read-through cache of values by coordinates, such as elevations.

The cache is a Parquet table keyed on coordinates at five decimals. A lookup
takes what is there, asks the provider once for each missing place, then the
fallback for those that it couldn't tell, appends the answers and joins them
back. Places that no provider knew stay null with the origin ``failed``; they
are in the cache too, and are asked again only on demand. Rows with a null
coordinate stay null with the origin ``none``. Where two runs stored a place, a
value counts before a failure, then the later answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import written

DIGITS = 5  # fixed value: about a metre
SCHEMA = "kx long, ky long, value double, origin string, stored timestamp"
BATCH = 100  # fixed value: places asked for together

Provider = Callable[[DataFrame], DataFrame]


def batched(ask: Callable[[list[tuple[float, float]]], list[float | None]], size: int = BATCH) -> Provider:
    """A provider from a function of up to ``size`` places; a call that raises tells nothing about its places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for at in range(0, len(p), size):
                part = p.iloc[at : at + size]
                try:
                    values = ask(list(zip(part["x"], part["y"])))
                except Exception:  # noqa: BLE001 - the service's own errors, of whatever kind, leave nulls
                    values = [None] * len(part)
                yield pd.DataFrame({"x": part["x"].to_numpy(), "y": part["y"].to_numpy(), "value": pd.array([None if v is None else float(v) for v in values], dtype="Float64")})

    return lambda places: places.select("x", "y").mapInPandas(run, "x double, y double, value double")


def _keys(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumns({"kx": F.round(F.col(x) * 10**DIGITS).cast("long"), "ky": F.round(F.col(y) * 10**DIGITS).cast("long")})


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows, a place once; empty where there is none yet."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    best = F.max_by(F.struct("value", "origin"), F.struct(F.col("value").isNotNull(), "stored", "value"))
    return rows.groupBy("kx", "ky").agg(best.alias("b")).select("kx", "ky", "b.value", "b.origin")


def read_through(points: DataFrame, path: str, primary: Provider, fallback: Provider | None = None, x: str = "x", y: str = "y", ask_failed_again: bool = False) -> DataFrame:
    """``points`` with ``value`` and ``origin`` (``primary``, ``fallback``, ``failed`` or ``none``).

    A provider takes ``x, y`` at five decimals, each place once, and returns
    ``x, y, value``; it may leave places out.
    """
    spark = points.sparkSession
    keyed = _keys(points, x, y)
    known = cached(spark, path)
    known = written(known.filter("value is not null") if ask_failed_again else known, "cached")
    missing = keyed.filter("kx is not null and ky is not null").select("kx", "ky").distinct().join(known, ["kx", "ky"], "left_anti")
    missing = written(missing, "missing")

    def told(places: DataFrame, ask: Provider, name: str) -> DataFrame:
        asked = places.select((F.col("kx") / 10**DIGITS).alias("x"), (F.col("ky") / 10**DIGITS).alias("y"))
        got = _keys(ask(asked), "x", "y").filter("value is not null and not isnan(value)").groupBy("kx", "ky").agg(F.max(F.col("value").cast("double")).alias("value"))
        return written(got.withColumn("origin", F.lit(name)), "told")

    if not missing.isEmpty():
        found = told(missing, primary, "primary")
        rest = missing.join(found, ["kx", "ky"], "left_anti")
        if fallback is not None:
            rest = written(rest, "rest")
            if not rest.isEmpty():
                found = found.unionByName(told(rest, fallback, "fallback"))
        every = missing.join(found, ["kx", "ky"], "left").withColumn("origin", F.coalesce("origin", F.lit("failed")))
        every = written(every.select("kx", "ky", "value", "origin"), "answers")
        every.withColumn("stored", F.current_timestamp()).write.mode("append").parquet(path)
        known = known.unionByName(every)
    return keyed.join(known, ["kx", "ky"], "left").withColumn("origin", F.coalesce("origin", F.lit("none"))).drop("kx", "ky")

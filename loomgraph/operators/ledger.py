"""Ledger operators: greedy consumption in order of priority, tiered and volume prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consume(credits: DataFrame, amount: Column) -> DataFrame:
    """``credits(user_id, balance, priority, ...)`` with ``used``: what an amount per user takes from each, in order. Running sums replace the loop.

    What went before is the running sum less the row's own balance, as SQL says it: a sum of the rows before
    differs in the last bit, which shows where credits add up to the amount. A null balance gives nothing.
    """
    w = Window.partitionBy("user_id").orderBy("priority")
    before = F.sum("balance").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("balance")
    return credits.withColumn("used", F.greatest(F.lit(0.0), F.least(F.col("balance"), amount - before))).filter("used > 0")


def tiered_price(qty: Column, tiers: tuple[tuple[float, float, float], ...]) -> Column:
    """Each tier ``(from, to, price)`` prices its own part."""
    total = F.lit(0.0)
    for lo, hi, price in tiers:
        total = total + F.greatest(F.lit(0), F.least(qty, F.lit(hi)) - F.lit(lo)) * F.lit(price)
    return total


def volume_price(qty: Column, tiers: tuple[tuple[float, float, float], ...]) -> Column:
    """The tier that the whole quantity reaches prices all of it."""
    price = F.lit(0.0)
    for lo, hi, p in tiers:
        price = F.when((qty >= lo) & (qty < hi), F.lit(p)).otherwise(price)
    return qty * price

"""Pareto fronts, crowding, hypervolume, penalties and diverse selection."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce
from math import ceil, inf, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import written


def front_2d(df: DataFrame, x: str, y: str, buckets: int = 64) -> DataFrame:
    """Rows that no row dominates, both objectives to be small; equal rows all stay.

    Only the least ``y`` per distinct ``x`` can matter, so rows are reduced to
    that first. A sweep over ``x`` then runs inside ranges of ``x``, each
    starting from the least ``y`` of all ranges before it, so that no single
    task sees all rows.
    """
    best = df.groupBy(x).agg(F.min(y).alias("__y"))
    lo_hi = best.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi")).withColumn("__k", F.lit(1))
    span = F.col("__hi") - F.col("__lo")
    cut = F.when(span > 0, F.floor((F.col(x) - F.col("__lo")) / span * (buckets - 1))).otherwise(0)
    parts = best.withColumn("__k", F.lit(1)).join(F.broadcast(lo_hi), "__k").withColumn("__part", cut).drop("__k", "__lo", "__hi")
    ends = parts.groupBy("__part").agg(F.min("__y").alias("__m"))  # at most `buckets` rows
    ends = ends.withColumn("__before", F.min("__m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
    above = F.min("__y").over(Window.partitionBy("__part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    swept = parts.withColumn("__above", above).join(F.broadcast(ends), "__part")
    least = F.least("__above", "__before")  # least skips nulls
    keep = swept.filter(least.isNull() | (F.col("__y") < least)).select(x, F.col("__y"))
    return df.join(keep, x).filter(F.col(y) == F.col("__y")).select(*df.columns)


def _sweep(points: pa.Table, known: pa.Table) -> pa.Table:
    """Fronts of a block's points ``x, y``, met in order of ``x``, then ``y``, together with points whose ``front`` is known."""
    events = [(-inf if x is None else x, -inf if y is None else y, f) for x, y, f in zip(*(known[c].to_pylist() for c in ("kx", "ky", "front")))]
    events += [(x, y, 0) for x, y in zip(points["x"].to_pylist(), points["y"].to_pylist())]
    events.sort(key=lambda e: (e[0], e[1], -e[2]))  # what is known comes before a point of the same place
    least: list = []  # the least y of each front so far or of a later one; never falls from one front to the next
    xs, ys, fronts = [], [], []
    for x, y, f in events:
        if f:
            at = bisect_right(least, y)
            if f > at:  # a point of a front implies one in every earlier front that is no higher
                least[at:f] = [y] * (f - at)
        else:
            at = bisect_right(least, y)
            least[at : at + 1] = [y]
            xs.append(x)
            ys.append(y)
            fronts.append(at + 1)
    return pa.table({"x": pa.array(xs, pa.float64()), "y": pa.array(ys, pa.float64()), "front": pa.array(fronts, pa.int64())})


def layers_2d(df: DataFrame, x: str, y: str, block_points: int = 200_000, most_ranges: int = 24) -> DataFrame:
    """All rows with both objectives as ``front`` 1, 2, ...: what is left when the fronts before are taken off.

    Distinct points are dealt into a grid of ranges of ``x`` by ranges of ``y``,
    of about ``block_points`` a block. A block depends only on those left of it
    and below it, so blocks of a diagonal are ranked side by side, diagonal after
    diagonal. What a block must know of the ones before is small: of its row the
    least ``y`` of each front, of its column the least ``x`` of each front, and
    the highest front of all that lie both left and below, which dominate it
    whole. A table of one block is one sweep. Null and NaN objectives are left
    out; objectives are compared as doubles.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    points = written(both.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct(), "points")
    n = points.count()
    ranges = max(1, min(most_ranges, ceil(sqrt(n / block_points))))
    cuts = points.approxQuantile(["x", "y"], [i / ranges for i in range(1, ranges)], 0.001) if ranges > 1 and n else [[], []]
    of = lambda c, at: sum((F.when(F.col(c) > v, 1).otherwise(0) for v in sorted(set(at))), F.lit(0))
    grid = written(points.withColumns({"i": of("x", cuts[0]), "j": of("y", cuts[1])}), "grid")
    known, ranked = None, []  # known: of each block its fronts with the least x and least y
    nothing = grid.limit(0).select("i", "j", F.lit(0.0).alias("kx"), F.lit(0.0).alias("ky"), F.lit(0).cast("long").alias("front"))
    for wave in range(2 * ranges - 1):
        now = grid.filter(F.col("i") + F.col("j") == wave)
        carry = nothing
        if known is not None:
            blocks = F.broadcast(spark_range(grid, ranges).filter(F.col("i") + F.col("j") == wave))  # at most as many rows as ranges
            k = known.select(F.col("i").alias("pi"), F.col("j").alias("pj"), "kx", "ky", "front")
            null = F.lit(None).cast("double")
            row = k.groupBy("pj", "front").agg(F.min("ky").alias("ky")).join(blocks, F.col("pj") == F.col("j")).select("i", "j", null.alias("kx"), "ky", "front")
            column = k.groupBy("pi", "front").agg(F.min("kx").alias("kx")).join(blocks, F.col("pi") == F.col("i")).select("i", "j", "kx", null.alias("ky"), "front")
            top = k.groupBy("pi", "pj").agg(F.max("front").alias("front"))  # a row a block
            corner = top.join(blocks, (F.col("pi") < F.col("i")) & (F.col("pj") < F.col("j"))).groupBy("i", "j").agg(F.max("front").alias("front")).select("i", "j", null.alias("kx"), null.alias("ky"), "front")
            carry = row.unionByName(column).unionByName(corner)
        swept = now.groupBy("i", "j").cogroup(carry.groupBy("i", "j")).applyInArrow(_sweep, "x double, y double, front long")
        swept = written(swept, "fronts")
        ranked.append(swept)
        if wave < 2 * ranges - 2:
            of_block = swept.withColumns({"i": of("x", cuts[0]), "j": of("y", cuts[1])}).groupBy("i", "j", "front").agg(F.min("x").alias("kx"), F.min("y").alias("ky"))
            known = written(of_block if known is None else known.unionByName(of_block), "known")
    fronts = reduce(DataFrame.unionByName, ranked)
    joined = both.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")}).join(fronts.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("front").cast("int").alias("_front")), ["_x", "_y"])
    return joined.select(*df.columns, F.col("_front").alias("front"))


def spark_range(like: DataFrame, n: int) -> DataFrame:
    """All blocks ``i, j`` of a grid of ``n`` by ``n``."""
    return like.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))


def crowding(front: DataFrame, key: str, objectives: tuple[str, ...], group: str | None = None) -> DataFrame:
    """``key, crowding`` on a front: gap between the neighbours over the range, summed; null at the ends (infinite)."""
    by = [group] if group else []
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = []
    for o in objectives:
        w = whole.orderBy(o, key)
        span = F.max(o).over(whole) - F.min(o).over(whole)
        total.append((F.lead(o).over(w) - F.lag(o).over(w)) / F.nullif(span.cast("double"), F.lit(0.0)))
    return front.select(*by, key, F.round(reduce(lambda a, b: a + b, total), 6).alias("crowding"))


def hypervolume_2d(front: DataFrame, x: str, y: str, ref_x: float, ref_y: float) -> DataFrame:
    """One row: the area that the front covers up to the reference corner; zero for an empty front."""
    steps = front.groupBy(x).agg(F.min(y).alias("y"))  # a front is thin: no two of its points share a side
    prev = F.lag("y", 1, ref_y).over(Window.orderBy(x))
    area = F.greatest(F.lit(0.0), F.lit(ref_x) - F.col(x)) * F.greatest(F.lit(0.0), F.col("prev") - F.col("y"))
    return steps.withColumn("y", F.col("y").cast("double")).withColumn("prev", prev).agg(F.round(F.coalesce(F.sum(area), F.lit(0.0)), 4).alias("hypervolume"))


def penalty(limits: dict[str, float]) -> Column:
    """Sum of violations relative to their limits; a value on the limit adds nothing."""
    return reduce(lambda a, b: a + b, [F.greatest(F.lit(0.0), F.col(c) - v) / v for c, v in limits.items()])


def farthest_first(df: DataFrame, group: str, key: str, k: int, distance: Callable[[Column, Column], Column], prefer: str) -> DataFrame:
    """``group, key, pos, distance``: of each group up to ``k`` rows, each as far as can be from those picked before it.

    Ties, and the first pick, go to the larger ``prefer``, then to the smaller
    key. A round is a grouped minimum and an update of each row's distance to
    the nearest pick, so a group of any size meets no single task; picks are one
    row a group, joined as the planner sees fit.
    """
    rows, found = df.withColumn("_far", F.lit(1.0)), []
    for pos in range(1, k + 1):
        order = F.struct((-F.col("_far")).alias("far"), (-F.col(prefer)).alias("prefer"), F.col(key).alias("key"), F.struct(*df.columns).alias("row"))
        pick = written(rows.groupBy(group).agg(F.min(order).alias("_pick")), "pick")
        found.append(pick.select(group, F.col("_pick.key").alias(key), F.lit(pos).cast("long").alias("pos"), (-F.col("_pick.far")).alias("distance")))
        if pos < k:
            rows = rows.join(pick, group).filter(F.col(key) != F.col("_pick.key"))
            nearer = F.least(F.col("_far"), distance(F.struct(*df.columns), F.col("_pick.row")))
            rows = written(rows.withColumn("_far", nearer).select(*df.columns, "_far"), "pool")
    return reduce(DataFrame.unionByName, found)

"""Joins of points and line segments over a grid of square cells.

A segment has a row for each cell that it crosses, a point one for each of the
nine cells around it: whatever lies within a cell's width of the point shares one
of those keys. The nearest segment at any distance is found down a pyramid of
grids: each point keeps the crossed cells that may hold its nearest segment, by
least and greatest distance of the cells, and looks into their quarters next. So
a far point meets the cells that face it, not all that lies around them. Nearest
searches and adjacent lines meet each place and each course once, however many
points or segments have it; few bytes make much work here, so the joins are spread
over all tasks.

Points and segments with a null or non-finite coordinate take no part; a segment
may be a point; distances are rounded to six digits and ties go to the smaller
line; columns named ``group`` must be equal on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.geometry import point_segment
from loomgraph.session import spread, written

DIGITS = 6
LIST_LINES = 1000  # lines of a course that a row holds on average
SALTS = 4  # a cell's points are dealt to so many tasks, and its segments copied to each
ENDS = ("x1", "y1", "x2", "y2")


def _finite(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    good = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in columns]
    for g in good:
        df = df.filter(g)
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def crossed_cells(width: Column | float) -> Column:
    """Cells ``cx, cy`` that the segment ``x1, y1, x2, y2`` crosses or touches, column of cells by column."""
    x1, y1, x2, y2 = map(F.col, ENDS)
    width = F.lit(width) if isinstance(width, float) else width
    edge = width * 1e-9
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    cell = lambda v: F.floor(v / width)
    columns = F.sequence(cell(left - edge), cell(right + edge))

    def of_column(i: Column) -> Column:
        # the part of the segment over this column of cells
        y_at = lambda x: y1 + (y2 - y1) * (x - x1) / (x2 - x1)
        from_, to = F.greatest(left, i * width - edge), F.least(right, (i + 1) * width + edge)
        steep = right - left < edge
        a, b = F.when(steep, y1).otherwise(y_at(from_)), F.when(steep, y2).otherwise(y_at(to))
        rows = F.sequence(cell(F.least(a, b) - edge), cell(F.greatest(a, b) + edge))
        return F.transform(rows, lambda j: F.struct(i.alias("cx"), j.alias("cy")))

    return F.flatten(F.transform(columns, of_column))


def around(width: Column | float) -> Column:
    """The nine cells around the point ``x, y``."""
    width = F.lit(width) if isinstance(width, float) else width
    i, j = F.floor(F.col("x") / width), F.floor(F.col("y") / width)
    return F.array(*[F.struct((i + a).alias("cx"), (j + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])


def within(points: DataFrame, lines: DataFrame, radius: float, group: tuple[str, ...] = ()) -> DataFrame:
    """``point, line, dist`` of all ``points(point, x, y)`` and ``lines(line, x1, y1, x2, y2)`` no more than ``radius`` apart."""
    p, s = _finite(points, ("x", "y")), _finite(lines, ENDS)
    width = radius * (1 + 1e-6) + 1e-6
    p = p.select(*group, "point", "x", "y", F.inline(around(width)))
    s = s.select(*group, "line", *ENDS, F.inline(crossed_cells(width)))
    met = p.join(s, [*group, "cx", "cy"]).select(*group, "point", "line", F.round(point_segment(*map(F.col, ("x", "y", *ENDS))), DIGITS).alias("dist"))
    return met.filter(F.col("dist") <= radius).distinct()  # a long segment meets a point in several cells


def _courses(lines: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Each course once, under its smallest line."""
    return lines.groupBy(*group, *ENDS).agg(F.min("line").alias("line"))


def _apart() -> Column:
    return F.round(point_segment(*map(F.col, ("x", "y", *ENDS))), DIGITS)


def nearest_within(points: DataFrame, lines: DataFrame, radius: float, group: tuple[str, ...] = ()) -> DataFrame:
    """``point, line, dist``: the nearest line of each point that has one within ``radius``."""
    p, s = _finite(points, ("x", "y")).select(*group, "point", "x", "y"), _finite(lines, ENDS)
    width = radius * (1 + 1e-6) + 1e-6
    places = p.select(*group, "x", "y").distinct().select("*", F.inline(around(width)))
    courses = spread(_courses(s, group), *group, *ENDS).select("*", F.inline(crossed_cells(width)))
    met = places.join(courses, [*group, "cx", "cy"]).select(*group, "x", "y", F.struct(_apart().alias("dist"), "line").alias("m")).filter(F.col("m.dist") <= radius)
    best = met.groupBy(*group, "x", "y").agg(F.min("m").alias("m"))
    return p.join(best, [*group, "x", "y"]).groupBy(*group, "point").agg(F.min("m").alias("m")).select(*group, "point", "m.line", "m.dist")


def nearest(points: DataFrame, lines: DataFrame, cell: float | None = None) -> DataFrame:
    """``point, line, dist``: the nearest line of each point at whatever distance. ``cell`` is the finest grid's width, by the lines' density where it isn't given."""
    p, s = written(_finite(points, ("x", "y")).select("point", "x", "y"), "points"), written(_courses(_finite(lines, ENDS)), "segments")
    box = s.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2")), F.count(F.lit(1))).first()
    if not box[4]:
        return p.join(s, F.lit(False)).select("point", "line", F.lit(0.0).alias("dist"))
    span = max(box[1] - box[0], box[3] - box[2], 1e-6)
    finest = float(cell or span / max(1.0, box[4] ** 0.5))
    # room for what rounding does to cells and distances
    slack = finest * 1e-6 + 2 * 10.0**-DIGITS + max(map(abs, box[:4])) * 1e-12
    held = written(spread(s, *ENDS).select("*", F.inline(crossed_cells(finest))), "held")
    grids = [written(held.select("cx", "cy").distinct(), "grid")]
    for _ in range(max(0, math.ceil(math.log2(span / finest)))):
        grids.append(written(grids[-1].select(F.floor(F.col("cx") / 2).alias("cx"), F.floor(F.col("cy") / 2).alias("cy")).distinct(), "grid"))
    place = Window.partitionBy("x", "y")
    near = spread(p.select("x", "y").distinct(), "x", "y").crossJoin(F.broadcast(grids[-1]))  # a few cells span all lines
    for level in range(len(grids) - 1, -1, -1):
        if level < len(grids) - 1:
            quarters = F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
            near = near.select("x", "y", F.inline(quarters)).join(grids[level], ["cx", "cy"])
        width = finest * 2.0**level
        low, high = [], []
        for at, c in (("x", "cx"), ("y", "cy")):
            under, over = F.col(c) * width - F.col(at), F.col(at) - (F.col(c) + 1) * width
            low.append(F.greatest(under, over, F.lit(0.0)))
            high.append(F.greatest(F.abs(under), F.abs(over)))
        least, most = (F.sqrt(a * a + b * b) for a, b in (low, high))
        near = near.withColumn("least", least).withColumn("bound", F.min(most).over(place)).filter(F.col("least") <= F.col("bound") * (1 + 1e-9) + slack)
        near = written(near.select("x", "y", "cx", "cy"), "near")
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(SALTS))
    near = spread(near.withColumn("salt", salt), "cx", "cy", "salt")
    copies = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    best = near.join(spread(copies, "cx", "cy", "salt"), ["cx", "cy", "salt"]).groupBy("x", "y").agg(F.min(F.struct(_apart().alias("dist"), "line")).alias("m"))
    return p.join(best, ["x", "y"]).groupBy("point").agg(F.min("m").alias("m")).select("point", "m.line", "m.dist")


def _beside(reach: float) -> dict[str, Column]:
    """Columns of a segment for ``_maybe``: its direction (any for a point), its squared length, and what lies ``reach`` beside it."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    long = dx * dx + dy * dy
    return {"dx": F.when(long == 0, 1.0).otherwise(dx), "dy": dy, "long": long, "beside": (reach + 2 * 10.0**-DIGITS) * F.when(long == 0, 1.0).otherwise(F.sqrt(long))}


def _maybe(x: str, y: str) -> Column:
    """Whether the place lies in the rectangle around the segment: a few operations that let all through that is near, so that few pairs get their exact, rounded distance. That one is too long a code for a join of many pairs."""
    wx, wy = F.col(x) - F.col("x1"), F.col(y) - F.col("y1")
    along = wx * F.col("dx") + wy * F.col("dy")
    return (F.abs(wx * F.col("dy") - wy * F.col("dx")) <= F.col("beside")) & (along >= -F.col("beside")) & (along <= F.col("long") + F.col("beside"))


def _with_lines(lines: DataFrame, group: tuple[str, ...], name: str) -> DataFrame:
    """Each course once with the list ``name`` of its lines, in several rows where they are more than ``LIST_LINES`` on average."""
    s = _finite(lines, ENDS).select(*group, *ENDS, "line").filter("line is not null")
    pieces = s.groupBy(*group, *ENDS).agg(F.ceil(F.count(F.lit(1)) / LIST_LINES).alias("pieces")).filter("pieces > 1")
    if pieces.isEmpty():  # no course is shared by many
        return s.groupBy(*group, *ENDS).agg(F.collect_set("line").alias(name))
    return s.join(pieces, [*group, *ENDS], "left").groupBy(*group, *ENDS, F.pmod(F.xxhash64("line"), F.coalesce("pieces", F.lit(1))).alias("piece")).agg(F.collect_set("line").alias(name)).drop("piece")


def adjacent(lines: DataFrame, others: DataFrame, tolerance: float, group: tuple[str, ...] = ()) -> DataFrame:
    """``line, other``: lines both of whose ends lie within ``tolerance`` of the other.

    Each course is measured once, however many lines have it: each place where
    courses start meets the others once, and their other ends are measured then.
    """
    kept, own = (written(_with_lines(df, group, name), "courses") for df, name in ((others, "others"), (lines, "lines")))
    width = tolerance * (1 + 1e-6) + 1e-6
    places = own.select(*group, F.col("x1").alias("x"), F.col("y1").alias("y")).distinct().select("*", F.inline(around(width)))
    side = _beside(tolerance)
    crossed = spread(kept.select(*group, *ENDS).distinct()).withColumns(side).select("*", F.inline(crossed_cells(width)))
    # a long segment meets a place in several cells
    near = places.join(crossed, [*group, "cx", "cy"]).filter(_maybe("x", "y")).groupBy(*group, "x", "y", *ENDS, *side).agg(F.min(point_segment(*map(F.col, ("x", "y", *ENDS)))).alias("dist"))
    near = near.filter(F.round("dist", DIGITS) <= tolerance).drop("dist").join(kept, [*group, *ENDS])
    keys = [*group, "x", "y", "salt"]
    near = spread(near.withColumn("salt", F.pmod(F.xxhash64(*ENDS, F.col("others")[0]), F.lit(SALTS))), *keys)
    starts = own.select(*group, F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x2").alias("to_x"), F.col("y2").alias("to_y"), "lines")
    starts = spread(starts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), *keys)
    met = near.join(starts, keys).filter(_maybe("to_x", "to_y")).select(*group, "lines", "others", point_segment(*map(F.col, ("to_x", "to_y", *ENDS))).alias("dist"))
    met = met.withColumn("line", F.explode(F.when(F.round("dist", DIGITS) <= tolerance, F.col("lines"))))
    return met.withColumn("other", F.explode("others")).select(*group, "line", "other")

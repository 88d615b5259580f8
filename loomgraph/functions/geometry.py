"""Planar geometry over doubles and ring arrays ``array<struct<x, y>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / size)))
    ex, ey = x - x1 - t * dx, y - y1 - t * dy
    return F.sqrt(ex * ex + ey * ey)


def _sides(ring: Column) -> Column:
    """Pairs of neighbouring corners, the last with the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_centroid(ring: Column) -> Column:
    """``x, y`` of the centre of area; of a ring without area, the mean of its corners."""
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    total = lambda part: F.aggregate(_sides(ring), F.lit(0.0), lambda s, p: s + part(p))
    twice = total(cross)
    flat = twice == 0
    axis = lambda k: F.when(flat, total(lambda p: p["a"][k]) / F.nullif(F.size(ring), F.lit(0))).otherwise(total(lambda p: (p["a"][k] + p["b"][k]) * cross(p)) / F.nullif(3 * twice, F.lit(0.0)))
    return F.struct(axis("x").alias("x"), axis("y").alias("y"))


def ring_area(ring: Column) -> Column:
    """Area by the shoelace sum."""
    return F.abs(F.aggregate(_sides(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def ring_length(ring: Column) -> Column:
    return F.aggregate(_sides(ring), F.lit(0.0), lambda s, p: s + F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], 2) + F.pow(p["b"]["y"] - p["a"]["y"], 2)))


def azimuth(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)), F.lit(360.0))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes ``(x1, y1, x2, y2)``."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union == 0, 0.0).otherwise(w * h / union)

"""Distance of designs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.geometry import box_iou
from loomgraph.functions.sequence import sequence_distance

# Shares of shape, measures, order of steps and family in the distance of two designs.
SHAPE, MEASURES, STEPS, FAMILY = 0.30, 0.25, 0.35, 0.10


def design_distance(a: Column, b: Column) -> Column:
    """Distance in [0, 1] of two structs with ``box`` (x1, y1, x2, y2), ``measures`` and ``steps`` (arrays) and ``family``, at four digits.

    Shapes differ by what their boxes don't share, measures by the mean of their
    absolute differences, steps by their sets, counts and order.
    """
    corners = [tuple(s["box"][i] for i in range(4)) for s in (a, b)]
    shape = 1 - box_iou(*corners)
    gaps = F.zip_with(a["measures"], b["measures"], lambda x, y: F.abs(x - y))
    measures = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(gaps), F.lit(1))
    steps = sequence_distance(a["steps"], b["steps"])
    family = F.when(a["family"] == b["family"], 0.0).otherwise(1.0)
    parts = [shape * SHAPE, measures * MEASURES, steps * STEPS, family * FAMILY]
    return F.round(reduce(lambda x, y: x + y, parts), 4)

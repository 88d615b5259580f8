import random

import pytest

from loomgraph.operators.pareto import layers_2d
from loomgraph.plans import catalogue

QUERIES = ("front_layers",)  # tested here against brute force


def peeled(points):
    """The front of each distinct point, by taking fronts off until none is left."""
    out, rest, n = {}, set(points), 0
    while rest:
        n += 1
        front = {a for a in rest if not any(b != a and b[0] <= a[0] and b[1] <= a[1] for b in rest)}
        out |= dict.fromkeys(front, n)
        rest -= front
    return out


def test_layers_rank_every_row(spark):
    r = random.Random(2)
    rows = [(i, float(r.randrange(40)), r.randrange(12)) for i in range(400)]
    want = peeled([x[1:] for x in rows])
    assert max(want.values()) > 3
    got = layers_2d(spark.createDataFrame(rows, "k int, a double, b int").repartition(4), "a", "b").collect()
    assert sorted(map(tuple, got)) == [(*x, want[x[1:]]) for x in rows]


@pytest.mark.parametrize(("block", "spread"), [(25, 40), (8, 12), (60, 1000)])
def test_a_grid_of_blocks_ranks_the_same(spark, block, spread):
    """Ties in both objectives, a chain along the diagonal, one long front against it, and equal rows."""
    r = random.Random(block)
    points = [(float(r.randrange(spread)), float(r.randrange(spread))) for _ in range(150)]
    points += [(float(i), float(i)) for i in range(0, spread, max(1, spread // 25))] + [(float(i), float(spread - i)) for i in range(0, spread, max(1, spread // 25))] + [(3.0, 3.0)] * 3
    want = peeled(points)
    rows = [(i, *p) for i, p in enumerate(points)] + [(900, None, 1.0), (901, 1.0, float("nan"))]
    got = layers_2d(spark.createDataFrame(rows, "k int, a double, b double"), "a", "b", block_points=block).collect()
    assert sorted(map(tuple, got)) == [(i, *p, want[p]) for i, p in enumerate(points)]


def test_nothing_to_rank(spark):
    assert layers_2d(spark.createDataFrame([], "k int, a double, b double"), "a", "b").collect() == []


def test_query_ranks_every_part(spark):
    got = catalogue.QUERIES["front_layers"](spark, "/root/testdata/sf0.001").collect()
    want = peeled([(x.price, x.size) for x in got])
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert all(x.front == want[x.price, x.size] for x in got)

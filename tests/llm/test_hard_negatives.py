import numpy as np
import pytest

from loomgraph.llm import hard_negatives as H
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<float>, score int, list int, anchor_id int"


def brute(rows, every=10, n_pos=5, n_neg=10):
    good = [(i, c, tuple(np.floor(np.array(v, np.float32).astype(float) * 256).astype(int).tolist())) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in sorted({i for i, _, _ in good if i % every == 0}):
        label, q = min((c, v) for i, c, v in good if i == a)
        best = {True: {}, False: {}}
        scores = [(i, c == label, dot(q, v)) for i, c, v in good if i != a]
        for i, same, s in scores:
            if same:
                best[True][i] = max(s, best[True].get(i, s))
        for p, ps in sorted(best[True].items(), key=lambda x: (-x[1], x[0]))[:n_pos]:
            found = {}
            for i, same, s in scores:
                if not same and 30 * ps <= 100 * s <= 90 * ps:
                    found[i] = max(s, found.get(i, s))
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n_neg])]
    return sorted(out)


def run(spark, rows, every=10, **how):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % every == 0, **how).collect()))


def data(n, dims, seed, labels=4):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, dims))
    return [(i, int(r.integers(labels)), [float(x) for x in centre[i % 12] + r.normal(size=dims) * 0.3]) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rows = data(600, 6, 1)
    rows += [(700 + i, i % 3, rows[7][2]) for i in range(200)]  # equal vectors, ties
    rows += [(950, None, [1.0] * 6), (960, 1, None), (970, 1, [1.0, None] * 3), (980, 1, [float("nan")] * 6), (990, 1, [float("inf")] + [0.0] * 5), (None, 1, [1.0] * 6)]
    rows += [(1000, 2, [0.0] * 6), (1010, 1, [0.5, 0.25]), rows[30], rows[31], (40, 3, [-1.0] * 6), (33, 0, [2.0] * 6), (33, 1, [1.5] * 6), (1020, 9, [1.0] * 6)]
    want = brute(rows)
    assert len(want) > 500
    assert run(spark, rows) == want
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    monkeypatch.setattr(H, "CHUNK", 8)
    monkeypatch.setattr(H, "BUNDLE", 16)
    assert run(spark, rows, lists=40) == want


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.5, 0.0]), (10, 3, [0.5, 0.5]), (11, 3, []), (12, 4, [])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1e3, 3e6])
def test_large_components(spark, size):
    rows = [(i, c, [x * size for x in v]) for i, c, v in data(60, 3, 4)]
    assert run(spark, rows) == brute(rows)


def test_lists_are_pruned(spark):
    """Well apart groups: an anchor doesn't visit most lists, and the result is the same."""
    r = np.random.default_rng(3)
    rows = [(i, i % 2, [float(10 * (i % 16 == d)) + float(r.normal()) * 0.1 for d in range(16)]) for i in range(640)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA)
    index = H.Lists(df, lists=16)
    asked = index.anchors(df.filter("vec_id % 10 = 0"))
    windows = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(H.NONE + 1).alias("lo"), F.lit(-H.NONE).alias("hi")))
    first = index._route(0, 16, 1)
    routes = asked.withColumn("windows", F.transform(windows, lambda w: F.struct(w["key"].alias("key"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.lit(5_000_000).cast("long").alias("kth")))).withColumn("chunk", F.lit(0).cast("long"))
    visited = routes.groupBy("chunk").applyInArrow(first, H.ROUTES).selectExpr("sum(length(ids) div 8) as n").first().n
    assert visited <= 4 * asked.count()  # of 16 lists
    assert run(spark, rows, lists=16) == brute(rows)

"""Joins over a grid against all pairs."""

import math
import random

import pytest

from loomgraph.operators import spatial as S

POINTS, LINES = "point long, x double, y double, line int", "line long, x1 double, y1 double, x2 double, y2 double, cx int"


def distance(p, s):
    (x, y), (x1, y1, x2, y2) = p, s
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / size)) if size else 0.0
    return round(math.hypot(x - x1 - t * dx, y - y1 - t * dy), 6)


def data(seed, reach):
    r = random.Random(seed)
    points = [(i, r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(80)] + [(100 + i, 10.0 * (i - 2), 0.0) for i in range(5)] + [(200, 900.0, -900.0), (201, -10.0, -10.0)]
    lines = []
    for i in range(60):
        x, y = r.uniform(-50, 50), r.uniform(-50, 50)
        lines.append((i, x, y, x + r.uniform(-reach, reach), y + r.uniform(-reach, reach)))
    lines += [(70, 0.0, 0.0, 0.0, 0.0), (71, -40.0, 10.0, 40.0, 10.0), (72, 10.0, -40.0, 10.0, 40.0), (73, -30.0, -30.0, 30.0, 30.0), (74, -30.0, -30.0, 30.0, 30.0), (75, 20.0, 40.0, 20.0, -40.0)]
    return points, lines


def frames(spark, points, lines):
    bad = [(900, None, 1.0), (901, float("nan"), 1.0)]
    return spark.createDataFrame([(*p, 1) for p in points + bad], POINTS), spark.createDataFrame([(*s, 1) for s in lines] + [(990, None, 1.0, 1.0, 1.0, 1), (991, float("inf"), 1.0, 1.0, 1.0, 1)], LINES)


@pytest.mark.parametrize(("radius", "reach"), [(5.0, 30.0), (0.5, 3.0), (40.0, 100.0)])
def test_within(spark, radius, reach):
    points, lines = data(1, reach)
    want = {(p[0], s[0], d) for p in points for s in lines if (d := distance(p[1:], s[1:])) <= radius}
    assert {tuple(r) for r in S.within(*frames(spark, points, lines), radius).collect()} == want


@pytest.mark.parametrize("cell", [None, 0.7, 300.0])
def test_nearest_at_any_distance(spark, cell):
    points, lines = data(2, 20.0)
    want = {(p[0], *min((distance(p[1:], s[1:]), s[0]) for s in lines)[::-1]) for p in points}
    got = {tuple(r) for r in S.nearest(*frames(spark, points, lines), cell).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want} and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got), sorted(want)))


def test_adjacent(spark):
    _, lines = data(3, 8.0)
    lines += [(80, 1.0, 10.2, 5.0, 9.9), (81, 10.1, 0.0, 9.8, 12.0)]
    want = {(a[0], b[0]) for a in lines for b in lines if max(distance(a[1:3], b[1:]), distance(a[3:], b[1:])) <= 1.0}
    _, df = frames(spark, [], lines)
    assert {tuple(r) for r in S.adjacent(df, df, 1.0).collect()} == want


def test_nothing(spark):
    points, lines = frames(spark, *data(1, 5.0))
    assert S.nearest(points.limit(0), lines).collect() == [] == S.nearest(points, lines.limit(0)).collect()
    assert S.within(points, lines.limit(0), 5.0).collect() == []


def test_copies_meet_once_and_work_is_spread(spark):
    """Places and courses that many share: the same rows as by all pairs, and few bytes of input don't end in one task."""
    points, lines = data(4, 10.0)
    points += [(1000 + p[0], *p[1:]) for p in points]
    lines = [(1000 + s[0], *s[1:]) for s in lines] + lines
    far = [(3000 + i, 400.0 + i, 300.0 - i) for i in range(40)]
    p, s = frames(spark, points + far, lines)
    want = {q[0]: min((distance(q[1:], t[1:]), t[0]) for t in lines) for q in points + far}
    got = S.nearest(p, s)
    assert {r.point: r.line for r in got.collect()} == {q: line for q, (_, line) in want.items()}
    close = S.nearest_within(p, s, 5.0)
    assert {(r.point, r.line, r.dist) for r in close.collect()} == {(q, line, d) for q, (d, line) in want.items() if d <= 5.0}
    pairs = S.adjacent(s, s, 1.0)
    for df in (got, close, pairs):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == sum(max(distance(a[1:3], b[1:]), distance(a[3:], b[1:])) <= 1.0 for a in lines for b in lines)


def test_adjacent_courses_are_measured_once(spark, monkeypatch):
    """Lines of one course pair up after their course was measured, in rows of bounded lists."""
    _, lines = data(5, 8.0)
    lines = [(1000 * n + s[0], *s[1:]) for n in range(12) for s in lines] + [(20_000, -0.0, 0.0, 0.0, -0.0)]
    want = sorted((a[0], b[0]) for a in lines for b in lines if max(distance(a[1:3], b[1:]), distance(a[3:], b[1:])) <= 1.0)
    _, df = frames(spark, [], lines)
    for most in (1000, 5):
        monkeypatch.setattr(S, "LIST_LINES", most, raising=False)
        pairs = S.adjacent(df, df, 1.0)
        assert sorted(map(tuple, pairs.collect())) == want
        assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 3  # lists of both sides, and the salt

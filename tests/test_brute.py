"""Queries without a twin in SQL, against plain loops over the same tables."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest

from loomgraph.operators.network import components
from loomgraph.plans import catalogue
from loomgraph.sources.tables import Tables
from tests.test_leiden import connected, plain_leiden, quality
from tests.test_sites import step_distance

SF = "/root/testdata/sf0.001"
QUERIES = ("component_labels", "community_detect", "farthest_first", "rate_limit_accept", "statute_units")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def test_rate_limit(spark, tables):
    by_user = defaultdict(list)
    for r in tables.events.collect():
        by_user[r.user_id].append((r.ts, r.event_id))
    want = set()
    for user, found in by_user.items():
        accepted = []
        for ts, event in sorted(found):
            ok = sum((ts - x).total_seconds() < 6 * 3600 for x in accepted) < 3
            accepted += [ts] * ok
            want.add((user, event, ok))
    got = {(r.user_id, r.event_id, r.accepted) for r in run(spark, "rate_limit_accept")}
    assert got == want and {True, False} >= {x[2] for x in want}


def iou(a, b):
    inside = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    either = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inside
    return inside / either if either else 0.0


def test_farthest_first(spark, tables):
    def distance(a, b):
        box = [(0, 0, x["p_size"], x["p_partkey"] % 10 + 1) for x in (a, b)]
        measures = (abs(a["p_retailprice"] - b["p_retailprice"]) / 2000 + abs(a["p_size"] - b["p_size"]) / 50) / 2
        family = a["p_name"].split(" ")[0] != b["p_name"].split(" ")[0]
        return round(0.30 * (1 - iou(*box)) + 0.25 * measures + 0.35 * step_distance(a["p_type"].split(" "), b["p_type"].split(" ")) + 0.10 * family, 4)

    by_brand = defaultdict(list)
    for r in tables.part.collect():
        by_brand[r.p_brand].append(r)
    got = defaultdict(dict)
    for r in run(spark, "farthest_first"):
        got[r.p_brand][r.pos] = (r.p_partkey, r.distance)
    for brand, parts in by_brand.items():
        assert sorted(got[brand]) == list(range(1, min(5, len(parts)) + 1))
        picked = []
        for pos in sorted(got[brand]):  # each pick is one of the farthest, as rounding may part ties
            key, d = got[brand][pos]
            far = {p["p_partkey"]: min([1.0, *(distance(p, q) for q in picked)]) for p in parts if p not in picked}
            assert abs(far[key] - d) < 2e-4 and far[key] >= max(far.values()) - 2e-4
            if not picked:
                assert key == max(parts, key=lambda p: (p["p_retailprice"], -p["p_partkey"]))["p_partkey"]
            picked.append(next(p for p in parts if p["p_partkey"] == key))


def shared_orders(tables):
    """Weighted pairs of suppliers that share an order, by a plain loop."""
    by_order = defaultdict(set)
    for r in tables.lineitem.select("l_orderkey", "l_suppkey").collect():
        by_order[r.l_orderkey].add(r.l_suppkey)
    return [(*pair, float(n)) for pair, n in Counter(p for s in by_order.values() for p in combinations(sorted(s), 2)).items()]


def test_component_labels(spark, tables):
    edges = shared_orders(tables)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert {(r.node, r.component) for r in run(spark, "component_labels")} == {(v, find(v)) for v in root}


def test_components_of_many_kinds(spark):
    """Paths, stars, rings and single edges, against union and find."""
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(400, 401), (403, 402), (402, 403), (500, 160), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, find(v)) for v in root}


def test_community_detect(spark, tables):
    """Levels are over the same nodes and nest, communities are connected, and their modularity is a plain version's."""
    edges = shared_orders(tables)
    graph = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        graph[a][b] += w
        graph[b][a] += w
    by_level = defaultdict(dict)
    for r in run(spark, "community_detect"):
        by_level[r.level][r.node] = r.community
    assert sorted(by_level) == [0, 1, 2] and all(set(x) == set(graph) for x in by_level.values())
    for level in by_level:
        members = defaultdict(list)
        for v, c in by_level[level].items():
            members[c].append(v)
        assert all(min(m) == c and connected(m, edges) for c, m in members.items())
        if level:
            assert all(by_level[level][v] == by_level[level][c] for v, c in by_level[level - 1].items())
    assert quality(graph, by_level[2]) >= 0.99 * plain_leiden(edges)


def test_statute_units(spark, tables):
    lines = defaultdict(list)
    for r in tables.lineitem.collect():
        lines[r.l_orderkey].append((r.l_linenumber, r.l_partkey))
    got = defaultdict(list)
    for r in run(spark, "statute_units"):
        got[r.doc].append(r)
    orders = [r.o_orderkey for r in tables.orders.collect()]
    assert set(got) == {f"doc{k}" for k in orders}
    for k in orders:
        found = {r.full_id: r for r in got[f"doc{k}"]}
        assert Counter(r.unit_type for r in found.values())["JO"] == 1
        (jo,) = [r for r in found.values() if r.unit_type == "JO"]
        assert jo.unit_number == f"{k}조" and jo.title == "주문" and jo.parent_id == f"doc{k}" and jo.revision_dates == ["2020.1.2."] and "개정" not in jo.content
        first = any(n == 1 for n, _ in lines[k])
        assert sum(r.unit_type == "HANG" for r in found.values()) == int(first)
        ho = {r.unit_number for r in found.values() if r.unit_type == "HO"}
        assert ho == ({str(n) for n, _ in lines[k] if n > 1} if first else set())
        assert all(r.parent_id == jo.full_id for r in found.values() if r.unit_type == "HANG")

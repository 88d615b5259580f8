"""Step lists, order of visit, captions and contents of statutes against plain loops; edge cases of the site operators."""

import re
from collections import Counter, defaultdict, deque
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import sequence
from loomgraph.operators import captions, network, sites, statute
from loomgraph.plans import catalogue
from loomgraph.sources.tables import Tables

SF = "/root/testdata/sf0.001"
QUERIES = ("step_distances", "visit_order", "caption_times", "statute_contents")


def common(a, b):
    table = {}
    for i in range(len(a)):
        for j in range(len(b)):
            table[i, j] = table.get((i - 1, j - 1), 0) + 1 if a[i] == b[j] else max(table.get((i - 1, j), 0), table.get((i, j - 1), 0))
    return table.get((len(a) - 1, len(b) - 1), 0)


def step_distance(a, b):
    if not a and not b:
        return 0.0
    shared = sum((Counter(a) & Counter(b)).values())
    like = len(set(a) & set(b)) / len(set(a) | set(b)) * 0.38 + 2 * shared / (len(a) + len(b)) * 0.32 + common(a, b) / max(len(a), len(b)) * 0.30
    return max(0.0, min(1.0, 1 - like))


def test_step_distances(spark):
    by_brand = defaultdict(list)
    for r in Tables(spark, SF).part.orderBy("p_partkey").collect():
        by_brand[r.p_brand].append((r.p_partkey, f"{r.p_name} {r.p_type}{f' {r.p_name}' * (r.p_size % 2 == 0)}".split(" ")))
    got = {r.p_partkey: r for r in catalogue.QUERIES["step_distances"](spark, SF).collect()}
    assert len(got) == sum(len(x) - 1 for x in by_brand.values())
    for parts in by_brand.values():
        for (_, b), (key, a) in zip(parts, parts[1:]):
            assert got[key].common_order == common(a, b) and got[key].shared == sum((Counter(a) & Counter(b)).values())
            assert abs(got[key].distance - step_distance(a, b)) < 6e-5


def test_empty_and_longer_steps(spark):
    rows = [(0, [], []), (1, ["x"], []), (2, ["a", "b", "c", "b", "d"], ["b", "d", "c", "a", "b"]), (3, ["a"] * 4, ["a"] * 2)]
    got = spark.createDataFrame(rows, "k int, a array<string>, b array<string>").select("k", sequence.common_order(F.col("a"), F.col("b")).alias("n"), sequence.sequence_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        _, a, b = rows[r.k]
        assert r.n == common(a, b) and abs(r.d - step_distance(a, b)) < 6e-5


def test_empty_permutation(spark):
    rows = spark.createDataFrame([([],), ([0],), ([3, 1, 0, 2],)], "p array<int>").withColumn("c", sequence.inversions(F.col("p"))).select("p", "c", sequence.permutation(F.col("c")).alias("back")).collect()
    assert all(r.p == r.back for r in rows) and {tuple(r.c) for r in rows} == {(), (0,), (2, 1, 1, 0)}


def walk(n, near):
    order, queue, seen = [], deque([0]), {0}
    while queue:
        i = queue.popleft()
        order.append(i)
        for j in near.get(i, []):
            if 0 <= j < n and j not in seen:
                seen.add(j)
                queue.append(j)
    return order + [i for i in range(n) if i not in seen]


def test_visit_order(spark):
    got = defaultdict(dict)
    for r in catalogue.QUERIES["visit_order"](spark, SF).collect():
        got[r.grp][r.pos] = r.node
    sizes = Counter(r.p_brand for r in Tables(spark, SF).part.collect())
    assert {g: len(x) for g, x in got.items()} == sizes
    for g, n in sizes.items():
        near = {i: [i * 2 + 2, i * 2 + 1, i - 3, i * 3 % 11] for i in range(n) if i % 7 != 5}
        assert [got[g][p] for p in range(n)] == walk(n, near)


def test_visit_order_without_links(spark):
    nodes = spark.createDataFrame([("a", 4), ("a", 2), ("a", 4), ("b", 9)], "grp string, node long")
    edges = spark.createDataFrame([("a", 2, 77, 0)], "grp string, src long, dst long, nth int")
    assert sorted(map(tuple, network.visit_order(nodes, edges).collect())) == [("a", 2, 0), ("a", 4, 1), ("b", 9, 0)]


def test_caption_times(spark):
    said = defaultdict(list)
    for r in Tables(spark, SF).conversations.collect():
        said[r.conv_id].append((r.turn, r.text or ""))
    chunks = defaultdict(list)
    for video, turns in said.items():
        for turn, text in sorted(turns):
            chunks[video, turn // 4].append(text)
    stamp = lambda s: f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}"
    ratio = lambda a, b: SequenceMatcher(None, a, b.replace("\n", " ")).ratio()
    want = {}
    for (video, chunk), texts in chunks.items():
        whole = "\n".join(texts)
        first = max(sorted(said[video]), key=lambda x: ratio(whole[:40].strip().replace("\n", " "), x[1]))
        last = max(sorted(said[video]), key=lambda x: ratio(whole[-40:].strip().replace("\n", " "), x[1]))
        want[video, chunk] = (stamp(first[0] * 700), stamp(last[0] * 700 + 9))
    got = {(r.video, r.chunk): (r.start_timestamp, r.end_timestamp) for r in catalogue.QUERIES["caption_times"](spark, SF).collect()}
    assert got == want


def test_captions_with_nothing_in_common(spark):
    chunks = spark.createDataFrame([("v", 0, "zzz"), ("w", 0, "abc"), ("v", 1, None)], "video string, chunk int, text string")
    said = spark.createDataFrame([("v", 0, 3, 2, "abc"), ("v", 1, 5, 2, None)], "video string, seq int, start int, duration int, text string")
    got = captions.caption_times(chunks, said).collect()
    assert {(r.video, r.chunk): (r.start_timestamp, r.end_timestamp) for r in got} == {("v", 0): (None, None), ("w", 0): (None, None), ("v", 1): ("0:00:05", "0:00:07")}


def contents(lines):
    """Headings of one document by a walk down its lines: ``{(type, number, title, chapter): is_toc}``."""
    sections, chapters, chapter, section = {}, {}, None, None
    for text in lines:
        if m := re.match(r"제(\d+)장\s*(.*)", text):
            chapter, section = m[1], None
            chapters.setdefault(chapter, [m[2], True])
        elif (m := re.match(r"제(\d+)절\s*(.*)", text)) and chapter:
            section = (m[1], m[2])
            if section in sections:
                sections[section][1] = False
                chapter = sections[section][0]
                chapters[chapter][1] = False
            else:
                sections[section] = [chapter, True]
        elif re.match(r"제\d+조", text):
            if chapter:
                chapters[chapter][1] = False
            if section:
                sections[section][1] = False
                chapters[sections[section][0]][1] = False
    return {("JANG", n, t, n): toc for n, (t, toc) in chapters.items()} | {("JEOL", *k, c): toc for k, (c, toc) in sections.items()}


def test_statute_contents(spark):
    got = defaultdict(dict)
    for r in catalogue.QUERIES["statute_contents"](spark, SF).collect():
        got[r.doc][r.unit_type, r.number, r.title, r.chapter] = r.is_toc
    for r in Tables(spark, SF).customer.collect():
        k = r.c_custkey
        heads = [f"제1장 총칙 {k % 3}", "제1절 통칙", "제2절 보칙", "제2장 벌칙", f"제3절 부칙 {k % 2}"]
        again = [f"제1장 총칙 {k % 3}"] + ["제1절 통칙"] * (k % 3 > 0) + ["제1조(목적) 이 법은"] * (k % 2 == 0) + ["제2장 벌칙"] * (k % 5 == 0) + ["제9조(벌칙) 과태료"] * (k % 7 == 0)
        assert got[f"doc{k}"] == contents(heads + again)
    assert {True, False} == {toc for x in got.values() for toc in x.values()}


def test_contents_of_odd_documents(spark):
    lines = [("a", 0, "제1절 머리"), ("a", 1, "제1조 본문"), ("b", 0, "제1장"), ("b", 1, "제1조(목적)"), ("c", 0, "")]
    got = statute.contents_flags(spark.createDataFrame(lines, "doc string, line_number int, text string")).collect()
    assert [(r.doc, r.unit_type, r.number, r.title, r.is_toc) for r in got] == [("b", "JANG", "1", "", False)]


@pytest.mark.parametrize("turned", [False, True])
def test_square_has_one_north_edge_and_two_roads(spark, turned):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    p = spark.createDataFrame([(1, ring[::-1] if turned else ring)], "k int, ring array<struct<x: double, y: double>>")
    got = sites.edge_classes(p, "ring").collect()
    assert sum(r.north for r in got) == 1 and sum(r.road for r in got) == 2 and all(r.adjacent == (not r.road and not r.north) for r in got)


def test_parcel_without_corners(spark):
    p = spark.createDataFrame([(1, []), (2, [(1.0, 1.0)]), (3, None)], "k int, ring array<struct<x: double, y: double>>")
    assert sites.edge_classes(p, "ring").collect() == []


def test_edges_are_worked_out_once(spark):
    """No expression of a parcel is written into those that use it, so none is worked out again for every edge."""
    from loomgraph.plans import catalogue

    plan = catalogue.QUERIES["parcel_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("atan2") == 2  # both sides of north
    assert "RepartitionByExpression" in plan or "Repartition" in plan

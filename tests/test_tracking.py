"""Pages of transcripts and sequences of intents against plain loops; edge cases of changes."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.operators import changes
from loomgraph.plans import catalogue
from loomgraph.plans.tracking import SEQUENCES, TERMS
from loomgraph.sources.tables import Tables

SF = "/root/testdata/sf0.001"
QUERIES = ("transcript_pages", "intent_sequences")


def pages(rows, seconds):
    """``(text, started, ended)`` of each page of ``(start, text)`` rows."""
    out, words, end = [], [], seconds
    for start, text in rows:
        words.append(text)
        if start >= end:
            out.append((" ".join(words), end - seconds, start))
            words, end = [], end + seconds
    return [*out, (" ".join(words), end - seconds, rows[-1][0])]


def stamp(s):
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}"


def test_transcript_pages(spark):
    said = defaultdict(list)
    for r in Tables(spark, SF).events.withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp"))).collect():
        said[r.user_id].append((r.at, r.event_id, r.event_type))
    want = set()
    for video, rows in said.items():
        rows.sort()
        for p, (text, lo, hi) in enumerate(pages([(at - rows[0][0], text) for at, _, text in rows], 86400)):
            want.add((video, p, text, stamp(lo), stamp(hi)))
    got = [(r.video, r.page, r.text, r.started, r.ended) for r in catalogue.QUERIES["transcript_pages"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_pages_with_gaps_and_a_closing_last_row(spark):
    starts = {"gap": [0, 300, 301, 302, 303, 304, 305], "closes": [5, 61], "one": [3], "late": [700], "same": [60, 60, 60]}
    rows = [(v, i, s, f"{v}{i}") for v, xs in starts.items() for i, s in enumerate(xs)]
    got = defaultdict(list)
    for r in changes.transcript_pages(spark.createDataFrame(rows, "video string, seq int, start int, text string")).orderBy("page").collect():
        got[r.video].append((r.text, r.started, r.ended))
    assert got == {v: pages([(s, f"{v}{i}") for i, s in enumerate(xs)], 60) for v, xs in starts.items()}


def words(text):
    return set(re.findall(r"[a-z0-9_]+|[가-힣]+", text)) | {text}


def matches(intent):
    said, found = intent.lower().strip(), []
    verbs = {v for names, vs in TERMS if any(n.lower() in said for n in names) for v in vs}
    for name, aliases, own in SEQUENCES:
        score = sum(3 if a.lower() in said else len(words(a.lower()) & words(said)) for a in aliases) + 2 * len(verbs & set(own))
        found += [(-score, len(found), name)] if score else []
    return [(name, -low) for low, _, name in sorted(found)][:3]


def test_intent_sequences(spark):
    got = defaultdict(dict)
    for r in catalogue.QUERIES["intent_sequences"](spark, SF).collect():
        got[r.p_partkey][r.nth] = (r.sequence, r.score)
    for r in Tables(spark, SF).part.collect():
        assert [x for _, x in sorted(got[r.p_partkey].items())] == matches(r.p_name)
    assert any(len(x) == 3 for x in got.values()) and len({x for y in got.values() for x in y.values()}) > 5


def test_no_intent(spark):
    df = spark.createDataFrame([(None,), ("",), ("nothing",)], "t string").select(changes.match_sequences(F.col("t"), SEQUENCES, TERMS).alias("x"))
    assert [r.x for r in df.collect()] == [None, [], []]


def test_changes_of_empty_tables(spark):
    rows = spark.createDataFrame([], "k int, name string, v double")
    assert changes.partial_update(rows, rows, "k").collect() == []
    counters = changes.bump_counters(spark.createDataFrame([], "k int, a long"), spark.createDataFrame([(1, "a", 2), (1, "zzz", 9), (2, "a", None)], "k int, action string, value long"), "k", ["a"])
    assert sorted(map(tuple, counters.collect())) == [(1, 2), (2, 0)]


def test_provenance_needs_what_it_names(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "key string")
    decisions = spark.createDataFrame([("d1", "t1", "a1", "x1"), ("d1", "t1", "a1", "x1"), ("d2", "t1", "a1", None), ("d3", "t9", "a1", "x1"), ("d4", "t1", "a9", "x1"), ("d5", "t1", "a1", "x9"), (None, "t1", "a1", "x1")], "id string, turn string, agent string, execution string")
    support = spark.createDataFrame([("d1", "e1", 0.5), ("d3", "e2", 0.5), ("d1", None, 1.0)], "decision string, evidence string, weight double")
    artifacts = spark.createDataFrame([("r1", "t1", "x1", "d1"), ("r2", "t1", "x1", "d9"), ("r3", "t1", "x9", "d1"), ("r4", "t1", None, None), ("r5", "t9", "x1", "d1")], "id string, turn string, execution string, decision string")
    nodes, edges = changes.provenance_graph(ids("t1"), ids("a1"), ids("x1"), decisions, support, artifacts)
    assert sorted(tuple(r) for r in nodes.collect()) == [("d1", "Decision"), ("d2", "Decision"), ("e1", "Evidence"), ("e2", "Evidence"), ("r1", "Artifact"), ("r2", "Artifact"), ("r4", "Artifact")]
    assert sorted(tuple(r)[:3] for r in edges.collect()) == sorted(
        [("t1", "d1", "HAS_DECISION"), ("t1", "d2", "HAS_DECISION"), ("d1", "a1", "MADE_BY"), ("d2", "a1", "MADE_BY"), ("x1", "d1", "MADE_DECISION"), ("d1", "e1", "SUPPORTED_BY")]
        + [("t1", r, "PRODUCED") for r in ("r1", "r2", "r4")] + [("x1", r, "PRODUCED") for r in ("r1", "r2")] + [("d1", "r1", "RESULTED_IN")]
    )

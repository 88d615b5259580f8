"""Stored posting lists against a full scan."""

import math
import random
import re
from collections import Counter, defaultdict

from loomgraph.operators.keyword_index import KeywordIndex

ROWS = "doc_id long, text string, block int, id int"


def words(text):
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def full_scan(rows, questions, k):
    held = defaultdict(Counter)
    for i, text in rows:
        if i is not None and text is not None:
            held[i].update(words(text))
    mean = sum(c.total() for c in held.values()) / max(1, len(held))
    df = Counter(t for c in held.values() for t in c)
    out = []
    for q, text in questions:
        score = defaultdict(float)
        for t in set(words(text or "")):
            for i, c in held.items():
                if c[t]:
                    score[i] += math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean))
        best = sorted(((-round(s, 6), i) for i, s in score.items()))[:k]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


def data(n, seed):
    r = random.Random(seed)
    vocab = ["the", *(f"w{i}" for i in range(400))]
    return [(i, "The " + " ".join(vocab[min(int(r.expovariate(0.02)), 400)] for _ in range(r.randint(1, 60)))) for i in range(n)]


def close(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and x[1] == y[1] and x[3] == y[3] and abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b))


def test_equals_a_full_scan_and_skips_blocks(spark):
    rows = data(600, 1) + [(700 + i, "the same tied words") for i in range(30)] + [(None, "no id"), (801, None), (802, ""), (803, "!!"), (3, "w1 twice")]
    questions = [(1, "the w1 w5"), (2, "w390 w391 the"), (3, "tied tied WORDS"), (4, "unknown"), (5, None), (6, ""), (7, "the"), (8, "w300 w2")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], ROWS)
    index = KeywordIndex.build(df, block_rows=16)
    asked = spark.createDataFrame(questions, "query_id long, question string")
    got = sorted((r.query_id, r.id, r.score, r["rank"]) for r in index.search(asked, 5).collect())
    assert close(got, full_scan(rows, questions, 5))
    # a rare word's blocks bound the others out: fewer blocks reach the k-th score than there are
    bounds = [(r.query_id, r.bound) for r in index.bounds(index.asked(asked)).collect()]
    kth = {q: s for q, _, s, n in got if n == 5}
    assert sum(b >= kth[q] for q, b in bounds if q == 3) < sum(q == 3 for q, _ in bounds) or sum(b >= kth[q] for q, b in bounds if q == 8) < sum(q == 8 for q, _ in bounds)


def test_a_common_term_is_many_postings(spark):
    index = KeywordIndex.build(spark.createDataFrame([(*r, 1, 2) for r in data(600, 2)], ROWS), block_rows=16)
    sizes = [len(r.rows) for r in spark.read.parquet(f"{index.path}/postings").filter("term = 'the'").collect()]
    assert sum(sizes) == 600 and max(sizes) < 60 and len(sizes) == 38


def test_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    asked = spark.createDataFrame([(1, "a")], "query_id long, question string")
    assert KeywordIndex.build(none).search(asked, 5).collect() == []
    some = KeywordIndex.build(spark.createDataFrame([(1, "a", 1, 1)], ROWS))
    assert some.search(asked.limit(0), 5).collect() == [] and some.search(asked, 5).count() == 1


def test_postings_are_dealt_by_block(spark, monkeypatch):
    """Queries of several groups get a full scan's rows, and no row of a posting is shuffled for each query."""
    from loomgraph.operators import keyword_index

    monkeypatch.setattr(keyword_index, "QUERIES", 3)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcdefghijkl") * r.randint(1, 2) for _ in range(r.randint(1, 20)))) for i in range(300)]
    asks = [(q, " ".join(r.choice("abcdefghijkl") for _ in range(4))) for q in range(20)]
    index = KeywordIndex.build(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=16)
    found = index.search(spark.createDataFrame(asks, "query_id long, question string"), 5)
    assert sorted(map(tuple, found.collect())) == full_scan(rows, asks, 5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()

import numpy as np

from loomgraph.llm import topk_search
from loomgraph.llm.topk_search import select_top, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    good = {i: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in good:
            scores = sorted(((int(good[q] @ v), -i) for i, v in good.items() if i != q), reverse=True)[:k]
            out += [(q, r + 1, -i, s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=10, every=100):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "1 as block", "2 as score", "3 as q", "4 as n")
    return sorted(map(tuple, top_k(df, df.filter(f"vec_id % {every} = 0"), k).collect()))


def test_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(500)]
    rows += [(600 + i, rows[7][1]) for i in range(40)] + [(700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (800, [0.0] * 8)]
    want = brute(rows, range(0, 1000, 100), 10)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk_search, "BLOCK_VALUES", 512)
    monkeypatch.setattr(topk_search, "CHUNK", 2)
    assert run(spark, rows) == want


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (3, [-0.5])]) == [(0, 1, 3, -512 * 1024)]


def test_selection_resolves_ties_by_id():
    sums, ids = np.array([5, 5, 7, 1, 5, 0]), np.array([9, 2, 8, 1, 4, 3])
    total = [np.packbits(np.pad((sums >> b & 1).astype(bool), (0, 58)), bitorder="little").view(np.uint64) for b in range(3)]
    among = np.array([0b111111], np.uint64)
    assert ids[select_top(total, among, ids, 3)].tolist() == [8, 2, 4]

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import registries
from loomgraph.operators import retrieval as R


def vectors(spark, n=300, d=8, seed=1):
    r = np.random.default_rng(seed)
    v = r.integers(-3, 4, (n, d)).astype(float)
    rows = [(i, i % 5, x.tolist()) for i, x in enumerate(v)] + [(n, 0, None)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), v


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_equals_brute_force(spark, metric):
    df, v = vectors(spark)
    asked = df.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    got = R.nearest(asked, df, 4, metric=metric, query_rows=20, row_rows=37).collect()  # many blocks
    want = []
    for q in range(0, 300, 3):
        if metric == "l2":
            s = -np.round(np.linalg.norm(v - v[q], axis=1), 6)
        else:
            n = np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])
            s = np.round(np.clip(np.divide(v @ v[q], n, out=np.zeros(len(v)), where=n > 0), 0, 1), 6)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:4]
        want += [(q, i, round(abs(float(s[i])), 6), k + 1) for k, i in enumerate(best)]
    assert sorted((r.query_id, r.vec_id, round(r.score, 6), r["rank"]) for r in got) == sorted(want)
    assert R.nearest(asked.limit(0), df, 4).count() == 0 and R.nearest(asked, df.limit(0), 4).count() == 0


def test_threshold_same_and_best_per(spark):
    df, v = vectors(spark)
    asked = df.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("label").alias("mine"), F.lit(0.6).alias("least"), F.col("embedding").alias("qe"))
    got = R.nearest(asked, df, 0, same=("mine", "label"), least="least", row_rows=50).collect()
    every = R.nearest(asked, df, 300).filter("mine = label and score >= 0.6").collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(r.query_id, r.vec_id) for r in every} and got
    assert all(r.label != 1 and r.score >= 0.3 for r in R.retrieve(asked, df, 10, least=0.3, keep=F.col("label") != 1).collect())
    per = R.nearest(asked, df, 1, best_per="label", row_rows=50)
    assert per.groupBy("query_id", "label").agg(F.max("score")).count() == 100


def corpus(spark):
    mk = spark.createDataFrame
    chunks = mk([(1, "d1", "the gate opens at dawn", [1.0, 0.0]), (2, "d1", "Éclair and tea", [0.8, 0.6]), (3, "d2", "no such thing", [0.0, 1.0])], "chunk_id long, doc_id string, text string, embedding array<double>")
    entities = mk([(10, "Gate", 100, [1.0, 0.0]), (11, "Tea", 100, [0.6, 0.8]), (12, "Dawn", 101, [0.0, 1.0]), (13, "Wall", 101, [-1.0, 0.0])], "entity_id long, name string, community_id long, embedding array<double>")
    communities = mk([(100, "gates and tea", [1.0, 0.1]), (101, "times of day", [0.1, 1.0])], "community_id long, summary string, embedding array<double>")
    return R.Corpus(chunks, entities, communities, mk([(1, 10), (1, 12), (2, 11), (2, 10)], "chunk_id long, entity_id long"), mk([(10, 13), (13, 11), (12, 11)], "src long, dst long"))


def test_every_mode_answers(spark):
    c = corpus(spark)
    q = spark.createDataFrame([(1, "when does the gate open", [1.0, 0.0]), (2, "éclair?", [0.0, 1.0])], "query_id long, question string, embedding array<double>")
    got = {m: sorted(map(tuple, R.answer(m, c, q).collect()), key=str) for m in registries.MODES}
    assert [(r[2], r[4]) for r in got["vector"] if r[0] == 1] == [("1", 1.0), ("2", 0.8), ("3", 0.0)]
    assert ("2", 1.0) in [(r[2], r[4]) for r in got["fulltext"] if r[0] == 2]  # by keyword
    assert {r[2] for r in got["entity_vector"] if r[:2] == (1, "community")} == {"100", "101"}
    # the gate is alike enough for two steps: the wall, then tea behind it
    assert {(r[2], r[4]) for r in got["graph_vector"] if r[:2] == (1, "neighbour")} >= {("13", 1.0), ("11", 2.0)}
    assert {r[2] for r in got["graph_vector"] if r[:2] == (1, "entity")} == {"10", "11", "12"}
    assert [r[2] for r in got["global_vector"] if r[0] == 1 and r[4] == 1.0] == ["100"]
    assert {(r[1], r[2]) for r in got["graph"]} == {("entity", "10"), ("neighbour", "13")}
    assert got["graph_vector_fulltext"] == sorted(map(tuple, R.answer("unknown", c, q).collect()), key=str)
    only = spark.createDataFrame([("d2",), ("d2",)], "doc_id string")
    assert {r.id for r in R.answer("vector", c, q, only).collect()} == {"3"}


def test_context_and_citations(spark):
    hits = spark.createDataFrame([(1, 5, "b", 0.123456, 2), (1, 4, "a", 0.9, 1), (1, 6, "c", 0.1, 3), (2, 4, "a", 0.90001, 1)], "query_id long, vec_id long, text string, score double, rank int")
    got = {r.query_id: r for r in R.pack_context(hits, 2).collect()}
    assert got[1].context == "a\n----\nb" and got[1].used == 2 and [tuple(s) for s in got[1].sources] == [(4, 0.9), (5, 0.1235)]
    assert sorted(map(tuple, R.citations(hits).collect())) == [(4, 0.9), (5, 0.1235), (6, 0.1)]
    assert sorted((r.vec_id, r.query_id) for r in R.fan_out(hits).collect()) == [(4, 1), (5, 1), (6, 1)]


def test_hop_budget(spark):
    df = spark.createDataFrame([(0.95,), (0.9,), (0.3,), (0.29,), (None,)], "s double")
    assert [tuple(r) for r in df.select(*R.hop_budget(F.col("s"))).collect()] == [(2, 40), (1, 20), (1, 20), (0, 0), (1, 20)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_of_odd_vectors(spark, metric):
    odd = {1: [1.0, 0.0], 2: [1.0, 0.0, 0.0], 3: [float("nan"), 1.0], 4: [None, 1.0], 5: [float("inf"), 1.0], 6: [], 7: [0.0, 0.0], 8: [2.0, 0.0], 9: None}
    df = spark.createDataFrame(list(odd.items()), "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    got = {}
    for r in R.nearest(asked, df, 9, metric=metric).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    if metric == "l2":  # only pairs that have a distance
        assert got == {1: {8: 1.0, 7: 1.0}, 7: {1: 1.0, 8: 2.0}, 8: {1: 1.0, 7: 2.0}}
    else:
        assert set(got) == set(range(1, 9)) and all(len(x) == 7 for x in got.values())
        assert {(q, i) for q, x in got.items() for i, s in x.items() if s} == {(1, 8), (8, 1)}


def test_best_cosines_are_exact_and_bounded():
    """Ties, zero and odd vectors: single precision only narrows the rows down, and no matrix of all queries and rows is made."""
    import tracemalloc

    r = np.random.default_rng(5)
    x = r.integers(-2, 3, (3000, 4)).astype(float)
    x[7], x[8] = np.nan, 0
    ids = np.arange(len(x))
    i, j, s, left = R._top_cosines(x[:600], x, ids[:600], ids, 5, 6)
    assert {7, 8} <= set(left) and len(i) == 5 * (600 - len(left))
    every = R.cosines(x[:600], x, 6)
    every[np.arange(600), np.arange(600)] = -np.inf
    for q in sorted(set(range(600)) - set(left)):
        want = np.lexsort((ids, -every[q]))[:5]
        assert list(j[i == q]) == list(want) and np.allclose(s[i == q], every[q][want])
    tracemalloc.start()
    R._top_cosines(np.tile(r.normal(size=(600, 4)), (5, 1)), r.normal(size=(3000, 4)), None, ids, 5, 6)
    assert tracemalloc.get_traced_memory()[1] < 3000 * 3000 * 4
    tracemalloc.stop()


def test_best_terms_broadcast_few(spark, monkeypatch):
    """Terms beyond the broadcast meet their numbers by a shuffle, with the same rows; a repeated id is one text."""
    df = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "alpha delta"), (1, "gamma omega"), (3, None), (4, "alpha beta omega kappa sigma")], "doc_id long, text string")
    whole = sorted(map(tuple, R.best_terms(df, "doc_id", "text", " ", 2).collect()))
    monkeypatch.setattr(R, "COMMON", 1)
    assert sorted(map(tuple, R.best_terms(df, "doc_id", "text", " ", 2).collect())) == whole
    assert [r[1] for r in whole if r[0] == 1] == ["beta", "gamma"] or {r[1] for r in whole if r[0] == 1} == {"beta", "gamma"}

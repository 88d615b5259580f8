"""The inverted-file index against full scans."""

import numpy as np
import pytest

from loomgraph.operators import vector_index as V
from loomgraph.operators.retrieval import nearest
from loomgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES = ("vector_index_topk",)
ROWS = "vec_id long, embedding array<double>, list int, v int"


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, dims))
    return [(i, [float(x) for x in centre[i % 12] + r.normal(size=dims) * 0.35], 1, 2) for i in range(n)]


def hits(df):
    return {(r.query_id, r.vec_id): r.score for r in df.collect()}


def asked(df, every):
    return df.filter(f"vec_id % {every} = 0").selectExpr("vec_id as query_id", "embedding as qe")


def test_recall_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 32)
    monkeypatch.setattr(V, "BUNDLE_ROWS", 8)
    df = spark.createDataFrame(clustered(1200, 12, 1), ROWS)
    index = V.VectorIndex.build(df, lists=24)
    want, got = hits(nearest(asked(df, 20), df.select("vec_id", "embedding"), 10)), hits(index.search(asked(df, 20), 10, probes=5))
    assert len(set(want) & set(got)) >= 0.9 * len(want) and all(want[p] == got[p] for p in set(want) & set(got))
    assert hits(index.search(asked(df, 20), 10, probes=24)) == want  # all lists: the same rows


def test_a_search_reads_the_probed_lists_only(spark):
    df = spark.createDataFrame(clustered(600, 8, 2), ROWS)
    index = V.VectorIndex.build(df, lists=12)
    one = asked(df, 1000)
    found = index.search(one, 10, probes=1)
    rows = spark.read.parquet(f"{index.path}/blocks").selectExpr("list", "explode(ids) as id")
    lists = {r["list"] for r in rows.join(found, rows.id == found.vec_id).select("list").collect()}
    assert len(lists) == 1


@pytest.mark.parametrize("least", [0.2, 0.9])
def test_within_is_exact(spark, least):
    df = spark.createDataFrame(clustered(400, 6, 3) + [(900, [0.0] * 6, 1, 2), (901, [1e-3] * 6, 1, 2)], ROWS)
    index = V.VectorIndex.build(df)
    want = hits(nearest(asked(df, 7).selectExpr("*", f"double({least}) as least"), df.select("vec_id", "embedding"), 0, least="least"))
    assert hits(index.within(asked(df, 7), least)) == want and want


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], 1, 1), (2, [1.0, 0.0], 1, 1), (2, [1.0, 0.0], 1, 1), (3, None, 1, 1), (4, [1.0, None], 1, 1), (5, [1.0], 1, 1), (6, [float("nan"), 1.0], 1, 1), (None, [1.0, 1.0], 1, 1), (7, [0.0, 0.0], 1, 1)]
    df = spark.createDataFrame(rows, ROWS)
    got = sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in V.VectorIndex.build(df).search(asked(df, 1), 2, 9).collect())
    assert got == [(1, 2, 1.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 1), (2, 1, 1.0, 2), (7, 1, 0.0, 1), (7, 2, 0.0, 2)]
    none = df.filter("false")
    assert V.VectorIndex.build(none).search(asked(df, 1), 2, 9).collect() == []
    assert V.VectorIndex.build(df).search(asked(none, 1), 2, 9).collect() == []


def test_query_recall(spark):
    got = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["vector_index_topk"](spark, SF).collect()}
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = set(hits(nearest(asked(e, 20), e.select("vec_id", "embedding"), 10)))
    assert len(want & got) >= 0.9 * len(want)


def test_means_hold_a_strip_of_scores():
    """The driver fits means without the scores of the whole sample at once; they are the plain ones."""
    import tracemalloc

    import numpy as np

    from loomgraph.operators.vector_index import spherical_means, unit

    x = unit(np.random.default_rng(4).normal(size=(8192, 8)))
    tracemalloc.start()
    c = spherical_means(x, 512, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8192 * 512 * 8 / 2
    plain = x[np.linspace(0, len(x) - 1, 512).astype(int)]
    for _ in range(2):
        of = (x @ plain.T).argmax(1)
        total = np.zeros_like(plain)
        np.add.at(total, of, x)
        assert np.bincount(of, minlength=512).all()
        plain = unit(total)
    assert np.allclose(c, plain)

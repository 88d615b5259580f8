import zlib

import numpy as np

from loomgraph.llm.quality import FEATURES, grow, quality_scores, statistics, traverse
from loomgraph.sources.tables import table
from tests.llm.docs import SCHEMA, awkward

SF = "/root/testdata/sf0.01"


def descend(model, row):
    """A tree walk for one row, node by node."""
    out = model["base"]
    for f, c, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        node = 0
        for _ in range(model["depth"]):
            node = 2 * node + 1 + int(row[f[node]] > c[node])
        out += leaf[node - (2 ** model["depth"] - 1)]
    return 1 / (1 + np.exp(-out))


def test_trees_learn_and_flat_traversal_equals_a_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = grow(x[:1000], y[:1000], rounds=40, depth=4)
    p = traverse(model, x)
    assert np.allclose(p[:30], [descend(model, row) for row in x[:30]])
    assert ((p[1000:] > 0.5) == y[1000:]).mean() > 0.95
    assert np.allclose(traverse(grow(x, np.ones(1500)), x[:3]), 0.999)
    assert np.allclose(traverse(grow(np.zeros((0, 6)), np.zeros(0)), x[:3]), 0.5)


def test_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "1 as y", "array(1.0) as stats", "0.1 as score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality_scores(df, labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(df.limit(0), labels.limit(0)).count() == 0
    assert len(statistics(None)) == len(statistics("a b\n\nc")) == len(FEATURES)


def plain_grow(x, y, rounds, depth, rate, least, ridge):
    """Scores after boosting by plain loops: every cut of every feature is tried in every node."""
    base = np.log(y.mean() / (1 - y.mean()))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 128)[1:-1])) for c in x.T]
    score = np.full(len(x), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes = [np.arange(len(x))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best = (1e-6, None)
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        low = x[rows, f] <= c
                        if low.sum() >= least and (~low).sum() >= least:
                            parts = [(g[rows[m]].sum(), h[rows[m]].sum()) for m in (low, ~low, low | True)]
                            gain = sum(a * a / (b + ridge) for a, b in parts[:2]) - parts[2][0] ** 2 / (parts[2][1] + ridge)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, c))
                low = x[rows, best[1][0]] <= best[1][1] if best[1] else np.ones(len(rows), bool)
                below += [rows[low], rows[~low]]
            nodes = below
        for rows in nodes:
            score[rows] -= rate * g[rows].sum() / (h[rows].sum() + ridge)
    return 1 / (1 + np.exp(-score))


def test_grow_equals_plain_loops():
    r = np.random.default_rng(5)
    x = r.normal(size=(160, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=160) / 2 > 0).astype(float)
    how = {"rounds": 4, "depth": 3, "rate": 0.2, "least": 10, "ridge": 1.0}
    assert np.allclose(traverse(grow(x, y, **how), x), plain_grow(x, y, **how))


def test_all_scores_against_a_plain_fit(spark):
    """The whole query again: whom it learns from, and a walk of every tree for every document."""
    small = "/root/testdata/sf0.001"
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and not held[r.doc_id] and r.quality is not None)
    model = grow(np.array([statistics(texts[i]) for i, _ in known]), np.array([q for _, q in known], float))
    want = {i: descend(model, statistics(t)) for i, t in texts.items()}
    for repeated in (docs, docs.union(docs.filter("doc_id % 3 = 0"))):
        got = quality_scores(repeated, labels.union(labels)).collect()
        assert len(got) == repeated.count() and all(abs(r.score - want[r.doc_id]) < 1e-9 and r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.3) for r in got)


def test_bound_holds_for_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 3, i % 2) for i in range(300)], "doc_id long, quality int")
    assert quality_scores(docs, labels, max_rows=2).count() == 300

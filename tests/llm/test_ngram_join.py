import random

import numpy as np

from loomgraph.llm import ngram_join
from loomgraph.llm.components import connected_components
from loomgraph.llm.ngram_join import keep_one_row_of_each_group, ngram_jaccard_join, overlaps
from loomgraph.sources.tables import table
from tests.llm.docs import SCHEMA, awkward, prose


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()


def brute(rows):
    """(doc_id, group, links) by comparing all pairs of different sets."""
    classes = {}
    for r in rows:
        if r[0] is not None and (g := frozenset(grams(r[1]))):
            classes.setdefault(g, []).append(r[0])
    sets = list(classes)
    links, root = {s: len(classes[s]) - 1 for s in sets}, {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            if both and both / (len(a) + len(b) - both) >= 0.8:
                links[a] += len(classes[b])
                links[b] += len(classes[a])
                root[find(a)] = find(b)
    group = {}
    for s in sets:
        group[find(s)] = min(group.get(find(s), 1 << 60), min(classes[s]))
    out = [(r[0], r[0], r[0], 0) for r in rows if r[0] is None or not grams(r[1])]
    return sorted(out + [(i, min(classes[s]), group[find(s)], links[s]) for s in sets for i in classes[s]], key=str)


def near_group(n, seed=9):
    r = random.Random(seed)
    base = [f"w{r.randrange(9999)}" for _ in range(150)]
    out = []
    for i in range(n):
        words = base[:]
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(150)] = f"x{r.randrange(9999)}"
        out.append((10_000 + i, " ".join(words), "en", "hot", 1))
    return out


def test_against_brute_force(spark, monkeypatch):
    rows = awkward() + prose(80) + near_group(120)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as cluster", "3 as size", "'b' as block")
    want = brute(rows)
    assert sorted(map(tuple, ngram_jaccard_join(df).collect()), key=str) == want
    assert sorted(map(tuple, ngram_jaccard_join(df, block=32).collect()), key=str) == want  # a cluster over many blocks
    assert ngram_jaccard_join(df.limit(0)).count() == 0


def test_driver_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect())) == sorted(brute(rows))


def test_overlaps():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 9000, 6000)).astype(np.uint64) for _ in range(7)]
    assert (overlaps(sets[:3], sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 139), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 500: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    words = [f"word{i}" for i in range(80)]
    near, other = " ".join(words), " ".join(f"other{i}" for i in range(80))
    rows = [(1, near), (2, near + " more"), (2, other), (3, "a third text that stays as it is"), (3, "a third text that stays as it is"), (None, other + " more"), (None, "nobody knows this text of no id"), (None, "nobody knows this text of no id")]
    rows += [(4, ""), (4, ""), (None, None)]
    df = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], SCHEMA).selectExpr("*", "1 as row", "2 as `group`", "3 as KEY", "4 as class_id").repartition(3)
    got = keep_one_row_of_each_group(df)
    assert got.columns == df.columns and keep_one_row_of_each_group(df.limit(0)).count() == 0
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[6], *rows[8:]], key=str)

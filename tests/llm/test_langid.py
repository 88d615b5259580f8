import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.langid import Scorer, fit_on, frequencies, hashed, keep_identified, language_id, sample_by_language, words_of
from loomgraph.sources.tables import table
from tests.llm.docs import SCHEMA, awkward

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "0.5 as score", "'q' as lang_pred")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert got[5].lang_pred == got[6].lang_pred == got[10].lang_pred == "und"
    assert got[7].lang_pred != "und" and got[None].held_out is False and 0 <= got[7].score <= 1
    assert language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(df.withColumn("lang", df.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang")).collect()} == {"und"}


def test_backoff_prefers_words_then_longer_grams():
    def known(rows):
        h = np.repeat(hashed(list(rows)), 2)
        return frequencies(h, np.tile([0, 1], len(rows)), np.array(list(rows.values())).ravel(), 2)

    model = {"langs": ["a", "b"], "words": known({"cat": [30, 1]}), "grams": known({"^do": [1, 30], "g$": [300, 1], "d": [90, 1], "xx": [0, 500]})}
    s = Scorer(model)
    assert s.predict("CAT")[0] == "a" and s.predict("dog")[0] == "b" and s.predict("rug")[0] == "a" and s.predict("d d d")[0] == "a"
    assert words_of("x²  ² 12_z") == ["x²", "²", "z"] and words_of("² 3") == []


def test_model_grows_with_what_each_language_has():
    rng = np.random.default_rng(5)
    langs, each = 200, 500
    h, lang = rng.integers(-(1 << 62), 1 << 62, langs * each), np.repeat(np.arange(langs), each)
    h[:: each // 2] = h[0]  # one entry that all have
    h = np.where(np.arange(len(h)) % each == each // 2, h[0] + 1, h)  # and a second one
    n = rng.integers(1, 50, len(h))
    found = frequencies(h, lang, n, langs)
    assert len(found.gain) == len(found.lang) == len(h) and len(found.base) == langs and len(found.first) == len(found.known) + 1
    dense = np.full((len(found.known), langs), 0.5)
    np.add.at(dense, (np.searchsorted(found.known, h), lang), n)
    want = np.log(dense / dense.sum(0))
    got = np.tile(found.base, (len(found.known), 1))
    owner, value = found.rows(np.arange(len(found.known)))
    np.add.at(got, (owner, found.lang[value]), found.gain[value])
    assert np.allclose(got - got[:, :1], want - want[:, :1], atol=1e-4)


def brute(rows):
    """Predictions by plain loops over strings, learned from all rows outside the held-out fold."""
    learn = {(i, t, lang) for i, t, lang in rows if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    langs = sorted({lang for _, t, lang in learn if words_of(t)})
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in learn:
        for w in words_of(t):
            words[w][lang] += 1
            for n in range(1, 5):
                for k in range(len(w) + 3 - n):
                    grams[f"^{w}$"[k : k + n]][lang] += 1

    def logs(table):
        sums = Counter()
        for c in table.values():
            sums.update(c)
        out = {}
        for key, c in table.items():
            v = [math.log((c[x] + 0.5) / (sums[x] + 0.5 * len(table))) for x in langs]
            out[key] = [y - sum(v) / len(v) for y in v]
        return out

    by_word, by_gram = logs(words), logs(grams)

    def of(w):
        if w in by_word:
            return by_word[w]
        for n in range(4, 0, -1):
            found = [by_gram[g] for k in range(len(w) + 3 - n) if (g := f"^{w}$"[k : k + n]) in by_gram]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    out = []
    for i, t, _ in rows:
        found = words_of(t)
        if not found or not langs:
            out.append((i, "und", 0.0))
            continue
        total = [sum(x) / math.sqrt(len(found)) for x in zip(*map(of, found))]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        out.append((i, langs[best], 1 / sum(math.exp(x - total[best]) for x in total)))
    return out


@pytest.mark.parametrize("name", ["awkward", "driver"])
def test_against_brute_force(spark, name):
    df = spark.createDataFrame(awkward(), SCHEMA) if name == "awkward" else table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language_id(df).collect()), key=str)
    for x, y in zip(got, sorted(brute(rows), key=str), strict=True):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3


def test_sample_is_bounded_by_language(spark):
    rows = [(i, f"text {i % 7}" * (1 + i % 3), "en" if i % 10 else "xx") for i in range(2000)] + [(1, "text 1" * 2, "en")] * 500
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    n = {r.lang: r["count"] for r in sample_by_language(df, 100, 1 << 30).groupBy("lang").count().collect()}
    assert n == {"en": 100, "xx": 100}
    chars = {r.lang: r.n for r in sample_by_language(df, 1 << 30, 900).groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert all(900 <= c <= 920 for c in chars.values()) and len(chars) == 2


def test_stage_keeps_rows_as_they_are(spark):
    df = spark.createDataFrame(awkward() * 2, SCHEMA).selectExpr("*", "1 as score", "2 as `__id`", "3 as held_out")
    kept = keep_identified(df, fit_on(df, "doc_id", "text", "lang"), least=0.0)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if words_of(r.text))
    assert keep_identified(df.limit(0), fit_on(df.limit(0), "doc_id", "text", "lang")).count() == 0


@pytest.mark.parametrize("most", [50])
def test_bounded_sample(spark, most):
    assert language_id(table(spark, SF, "documents"), max_docs=most).filter("lang_pred = 'und'").count() == 0

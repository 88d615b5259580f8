import hashlib
import random

import numpy as np

from loomgraph.llm.suffix_dedup import anchors, column_wise, gram_hashes, leftmost_min, suffix_dedup
from loomgraph.sources.tables import table
from tests.llm.docs import SCHEMA, awkward, prose


def brute(rows, width=100):
    """Every string by a dictionary, in order of (id, start)."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            x = raw[s : s + width]
            if x in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(x)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def data():
    r = random.Random(4)
    rows = [(r_[0] + 100, r_[1]) for r_ in prose(60)]
    rows += [(1000, "ab" * 200), (1001, "a" * 350), (1002, "é" * 120), (1003, None), (1004, ""), (1005, "x" * 100), (1006, "x" * 99), (1007, "x" * 100)]
    base = "".join(r.choice("abcd ") for _ in range(500))
    for i in range(60):  # one passage in many contexts, and copies with a byte changed
        rows.append((1100 + i, f"{r.random()} {base[:150]} {r.random()}"))
        at = r.randrange(500)
        rows.append((1200 + i, base[:at] + "#" + base[at + 1 :]))
    r.shuffle(rows)
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], SCHEMA).selectExpr("*", "1 as anchor", "2 as tag", "3 as at")
    return sorted(map(tuple, suffix_dedup(df.repartition(5), **how).collect()))


def test_against_brute_force(spark):
    rows = data()
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=64) == want  # anchors over several blocks


def test_driver_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted(map(tuple, suffix_dedup(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), SCHEMA)
    got = suffix_dedup(df, texts_out=True).collect()
    assert len(got) == len(awkward())
    assert {r.doc_id: r.n_removed for r in got}[7] > 0  # it repeats itself
    assert suffix_dedup(df.limit(0)).count() == 0


def test_column_wise_equals_sorting():
    r = np.random.default_rng(3)
    regions = [r.integers(97, 100, r.integers(4, 30)).astype(np.uint8) for _ in range(50)]
    regions += [x.copy() for x in regions[:10]]
    owner, offset, same = column_wise(regions, 4)
    strings = [regions[o][p : p + 4].tobytes() for o, p in zip(owner, offset)]
    assert strings == sorted(strings) and len(strings) == sum(len(x) - 3 for x in regions)
    assert [False] + [a == b for a, b in zip(strings, strings[1:])] == same.tolist()


def test_anchors():
    r = np.random.default_rng(5)
    raw = r.integers(97, 101, 400).astype(np.uint8)
    h = gram_hashes(raw, 16)
    assert len(h) == 385 and len(np.unique(h)) == 385 and gram_hashes(np.concatenate([raw, raw]), 16)[400] == h[0]
    x = r.integers(0, 5, 300).astype(np.uint64)
    assert leftmost_min(x, 37).tolist() == [s + int(x[s : s + 37].argmin()) for s in range(264)]
    a, region, check, begin, end = anchors(raw)
    assert begin[0] == 0 and end[-1] == 300 and (begin[1:] == end[:-1] + 1).all()
    b, region_b, check_b, *_ = anchors(np.concatenate([raw[:7], raw]))
    assert set(region[1:-1]) <= set(region_b) and set(check[1:-1]) <= set(check_b) and not set(region) & set(check)


def test_repeated_and_null_id_rows_keep_their_text(spark):
    r = random.Random(8)
    own = ["".join(r.choice("abcdefgh ") for _ in range(400)) for _ in range(3)]
    shared = "".join(r.choice("abcdefgh ") for _ in range(300))
    once = [(1, own[0]), (2, own[1] + shared), (3, shared[:-9] + own[2])]  # the last two meet in the fetched regions
    want = brute(once)
    for repeats in (2, 7):  # within a task and across tasks
        for parts in (1, 5):
            df = spark.createDataFrame([(*x, "en", "s", 1) for x in once * repeats], SCHEMA).repartition(parts)
            assert sorted(map(tuple, suffix_dedup(df).collect())) == sorted(want * repeats)
    nulls = [(None, own[0], "en", "s", 1)] * 2 + [(4, own[1], "en", "s", 1)]
    for parts in (1, 3):
        assert [x.n_removed for x in suffix_dedup(spark.createDataFrame(nulls, SCHEMA).repartition(parts)).collect()] == [0, 0, 0]


def test_one_long_text_with_a_separator(spark):
    """Thousands of different regions of one document under one anchor are dealt over several blocks."""
    r = random.Random(11)
    line = "=" * 20 + "".join(r.choice("abcdefgh") for _ in range(60)) + "=" * 20
    text = line.join("".join(r.choice("abcdefgh ") for _ in range(r.randint(3, 40))) for _ in range(900))
    rows = [(1, text), (2, "before it " + line + " after it"), (3, text[5000:9000])]
    assert run(spark, rows, block=64) == run(spark, rows) == brute(rows)


def test_other_texts_of_an_id_and_null_ids(spark):
    """Such texts have an order of their own: what they share goes from all but one of them."""
    r = random.Random(12)
    words = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = words(250)
    for ids in ((7, 7, 7), (None, None, None), (7, None, None), (7, 7, None)):
        texts = [words(120) + passage + words(130), passage + words(140), words(110) + passage]
        df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts)], SCHEMA).repartition(2)
        got = suffix_dedup(df, texts_out=True).collect()
        assert sorted(x.n_removed for x in got) == [0, 250, 250] and sum(passage.encode() in x.kept for x in got) == 1
        if ids[0] == 7 and ids[1] is None:
            assert [x.n_removed for x in got if x.doc_id == 7] == [0]  # null ids come last


def test_longer_symbols_save_rounds(monkeypatch):
    """Symbols of several bytes give what single bytes do, for any width, in a part of the rounds."""
    from loomgraph.llm import suffix_dedup as module

    r = np.random.default_rng(7)
    base = r.integers(97, 101, 160).astype(np.uint8)
    regions = [base[i % 20 : i % 20 + r.integers(3, 140)] for i in range(60)] + [np.frombuffer(b"a" * 150, np.uint8)]
    calls, plain = [], module.range_min
    monkeypatch.setattr(module, "range_min", lambda *x: calls.append(len(x[0])) or plain(*x))
    for width in (100, 44, 6, 7):
        calls.clear()
        owner, offset, same = module.column_wise(regions, width)
        strings = [regions[o][p : p + width].tobytes() for o, p in zip(owner, offset)]
        assert strings == sorted(strings) and sorted(strings) == sorted(x[i : i + width].tobytes() for x in regions for i in range(len(x) - width + 1))
        assert [False] + [a == b for a, b in zip(strings, strings[1:])] == same.tolist()
        assert len(set(zip(owner, offset))) == len(strings)
        if width == 100:
            assert len({n for n in calls}) <= 2 * 150 // 5


def test_range_min():
    from loomgraph.llm.suffix_dedup import range_min

    r = np.random.default_rng(2)
    x = r.integers(0, 200, 5000).astype(np.uint8)
    lo = r.integers(0, 5000, 400)
    hi = np.minimum(lo + r.integers(0, 3000, 400), 4999)
    assert range_min(x, lo, hi).tolist() == [int(x[a : b + 1].min()) for a, b in zip(lo, hi)]

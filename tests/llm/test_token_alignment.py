import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm import token_alignment as T
from tests.llm.docs import SCHEMA, awkward, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def characters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {chr(b) if b in own else chr(next(rest)): b for b in range(256)}


def brute(rows, libraries):
    tok, sp = libraries
    back = characters()
    docs, count = [], Counter()
    for r in rows:
        text = r[1]
        a = tok.encode(" " + text, add_special_tokens=False) if text else None
        b = sp.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in t) for t in a.tokens] if a else []
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs.append((r[0], 0, 0, [], ""))
            continue
        ends = []
        for tokens in (a_bytes, b_bytes):
            n, found = 0, []
            for t in tokens:
                n += len(t)
                found.append(n)
            ends.append(found)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        last, groups, links = 0, [], []
        for c in cuts:
            x, y = ([i for i, e in zip(ids, found) if last < e <= c] for ids, found in ((a.ids, ends[0]), (b, ends[1])))
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            links.append((x[-1], y[-1]))
            last = c
        count.update(links)
        docs.append((r[0], len(a.ids), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((i, n_a, n_b, len(k), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), sha) for i, n_a, n_b, k, sha in docs), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as pairs", "3 as n_a")
    return sorted(map(tuple, T.token_alignment(df, A, B).collect()), key=str)


def odd(n=300):
    r = random.Random(5)
    parts = ["the", " ", "  ", "\n", "é", "ﬁ", "😀", "<|endoftext|>", "</s>", "<0x41>", "▁", "\x00", "don't", "12", "中文", "　", "é", "​", "ab" * 40, "\t"]
    return [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30))), "en", "s", 1) for i in range(n)]


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_against_brute_force(spark, libraries, monkeypatch, bound):
    monkeypatch.setattr(T, "MOST_BROADCAST", bound)
    rows = awkward()[:6] + [(8, "word " * 3000, None, None, None), (None, "no id", "en", "a", 5), (9, "x", None, "a", 1), (9, "x", None, "a", 1)] + prose(40) + odd()
    want = brute(rows, libraries)
    assert sum(w[1] == 0 for w in want) > 5 and sum(w[5] < w[4] for w in want) > 20
    assert run(spark, rows) == want
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None, None), (2, "", None, None, None)]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_runs_do_not_change_results(spark, libraries, monkeypatch):
    a, rows = T.aligner(A, B), odd(60)
    whole = a.run([r[1] for r in rows])
    parts = [x for i in range(0, 60, 7) for x in a.run([r[1] for r in rows[i : i + 7]])]
    assert [(*x[:5], x[5].tolist(), x[6].tolist()) for x in whole] == [(*x[:5], x[5].tolist(), x[6].tolist()) for x in parts]
    monkeypatch.setattr(T, "RUN_BYTES", 10)
    assert list(T.runs([4, 4, 4, 50, 0, 3])) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(T.runs([])) == []


def test_tokens_have_bytes():
    for e in (T.encoder(A), T.encoder(B)):
        assert all(e.bytes)

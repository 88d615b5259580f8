import math
import random
import re
from collections import Counter, defaultdict

import pytest

from loomgraph.llm.line_dedup import line_dedup
from loomgraph.sources.tables import table
from tests.llm.docs import SCHEMA, awkward, prose

LAST = 1 << 63


def masked(line):
    return tuple("<*>" if re.search(r"\d", t) else t for t in line.split())


def brute(rows, depth=3, min_tokens=3, min_docs=3, constant=0.7, long_tokens=40):
    """The texts after the same rules, by plain loops over tokens in every leaf, not the fullest ones alone."""
    seen = [(LAST if r[0] is None else r[0], r[1]) for r in rows]
    holders = defaultdict(set)
    for doc, text in seen:
        for line in (text or "").split("\n"):
            if len(t := masked(line)) >= min_tokens:
                holders[t].add(doc)
    leaves = defaultdict(set)
    for t in holders:
        tail, n = t[depth:], max(0, len(t) - depth)
        for part in range(4):
            if chunk := tail[n * part // 4 : n * (part + 1) // 4]:
                for i, lead in enumerate(t[:depth]):
                    leaves[len(t), i, lead, part, chunk].add(t)
    leaves = {leaf: forms for leaf, forms in leaves.items() if len(forms) > 1 and sum(len(holders[t]) for t in forms) >= min_docs}
    found = defaultdict(set)
    for forms in leaves.values():
        counts = Counter((i, x) for t in forms for i, x in enumerate(t))
        for t in forms:
            n = sorted((counts[i, x] for i, x in enumerate(t)), reverse=True)
            need = math.ceil(constant * len(t))
            same = tuple((i, x) for i, x in enumerate(t) if counts[i, x] >= max(2, 0.75 * n[need - 1]))
            if len(same) >= need:
                found[len(t), same].add(t)
    firm, pair = {}, {}
    for t, docs in holders.items():
        if len(docs) >= min_docs:
            firm[t] = min(docs)
        elif len(docs) > 1 and len(t) >= long_tokens:
            pair[t] = min(docs)
    for forms in found.values():
        docs = set().union(*(holders[t] for t in forms))
        if len(docs) >= min_docs:
            for t in forms:
                firm[t] = min(firm.get(t, LAST), min(docs))
    out = []
    for (doc, text), r in zip(seen, rows):
        lines = (text or "").split("\n")
        forms = [masked(x) for x in lines]
        shared = Counter(pair[t] for t in forms if t in pair and t not in firm and doc > pair[t])
        n = sum(len(t) >= min_tokens for t in forms)
        kept = [x for x, t in zip(lines, forms) if not (t in firm and doc > firm[t] or t not in firm and t in pair and doc > pair[t] and 2 * shared[pair[t]] <= n)]
        out.append((r[0], "\n".join(kept) if text is not None else None))
    return sorted(out, key=str)


def own_words(i):
    return " ".join(chr(97 + (i * 7 + j * j) % 26) * (j + 2 + i % 3) for j in range(6))


def logs():
    out = []
    for i in range(30):
        user = f"name{'abcdefghijklmnopqrstuvwxyz'[i % 26]}"
        lines = [f"request {i} took {i * 7} ms on node{i}", f"the session of user {user} was opened on the main console today", "All rights reserved here.", own_words(i)]
        out.append((2000 + i, "\n".join(lines + ["", "Of."]), "en", "log", 1))
    return out


def test_against_brute_force(spark):
    rows = awkward() + [(r[0] + 5000, *r[1:]) for r in prose(60)] + logs()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as form", "'x' as tag", "4 as line", "5 as `gone`", "6 as DOC", "7 as n_lines")
    got = line_dedup(df, counts=("all_lines", "n_dropped"))
    assert got.columns == [*df.columns, "all_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(rows)


def test_templates(spark):
    got = {r.doc_id: r.text.split("\n") for r in line_dedup(spark.createDataFrame(logs(), SCHEMA)).collect()}
    assert len(got[2000]) == 6  # the first keeps all
    assert got[2007] == [own_words(7), "", "Of."]


def test_driver_table_and_empty(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.text) for r in line_dedup(docs).collect()), key=str) == brute(rows)
    assert line_dedup(docs.limit(0)).count() == 0


def test_one_id_with_several_texts_is_one_document(spark):
    line = "this very line recurs in texts of one id only"
    rows = [(1, f"{line}\nfirst words of one"), (1, f"{line}\nother words of it"), (1, line), (None, f"{line} too"), (None, f"{line} too\nmore of it here"), (None, f"x\n{line} too")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in line_dedup(df).collect()), key=str) == sorted(rows, key=str)
    more = rows + [(i, f"{line}\nown words number {chr(90 + i)}") for i in (7, 8)]
    got = {(r.doc_id, r.text) for r in line_dedup(spark.createDataFrame([(*r, "en", "s", 1) for r in more], SCHEMA)).collect()}
    assert {r[1] for r in got if r[0] == 1} == {r[1] for r in rows[:3]} and all(line not in t for i, t in got if i in (7, 8))


def test_a_passage_of_two_documents_goes_from_the_second(spark):
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = words(60)
    rows = [(1, f"{words(30)}\n{passage}\n{words(20)}"), (2, f"{words(30)}\n{words(20)}\n{passage}\n{words(10)}"), (3, copy := f"{words(50)}\n{words(50)}\n{words(9)}"), (4, copy)]
    got = {x.doc_id: x.text for x in line_dedup(spark.createDataFrame([(*x, "en", "s", 1) for x in rows], SCHEMA)).collect()}
    assert passage in got[1] and passage not in got[2] and len(got[2].split()) == 60 and got[3] == got[4] == copy


@pytest.mark.parametrize("fields", [1, 2, 3])
def test_recall_of_planted_templates(spark, fields):
    """Templates whose fields the generator alone knows, at any place, among prose and among each other; several share length and leading words."""
    r = random.Random(fields)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(900)]
    names = ["".join(r.choice("qrstuvwxyz") for _ in range(5)) for _ in range(60)]
    planted, lines = {}, []
    for k in range(40):
        n = r.randint(max(6, 4 * fields), 18)
        base = [r.choice(vocab) for _ in range(n)]
        if k % 2:
            base[:2] = vocab[:2]
        at = r.sample(range(n), fields)
        for _ in range(8):
            line = list(base)
            for i in at:
                line[i] = r.choice(names)
            lines.append((k, " ".join(line)))
    r.shuffle(lines)
    rows = []
    for i, (k, line) in enumerate(lines):
        own = [" ".join(vocab[:2] + [r.choice(vocab) for _ in range(r.randint(4, 16))]) if r.random() < 0.5 else " ".join(r.choice(vocab) for _ in range(12)) for _ in range(3)]
        rows.append((i, "\n".join([*own[:1], line, *own[1:]]), "en", "log", 1))
        planted.setdefault(k, []).append(i)
    got = {x.doc_id: x.text.split("\n") for x in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    later = [i for k, docs in planted.items() for i in docs if i > min(docs)]
    assert sum(lines[i][1] not in got[i] for i in later) / len(later) >= 0.9
    clean = [x in got[i] for i, row in enumerate(rows) for x in row[1].split("\n") if x != lines[i][1]]
    assert sum(clean) / len(clean) >= 0.99


def test_what_a_line_says_is_put_together_once(monkeypatch):
    """Forms, leading tokens and parts hash as written out token by token; a line and its parts need no second joining, which counts as one digest for each."""
    import pyarrow as pa

    from loomgraph.llm import line_dedup as module

    lines = ["a b", "a b c", "x1 y z w", "one two three four five six seven", "１ two three four", "é\x1cü ö 9 q r s t u v w", "r2d2"]
    texts = ["\n".join(lines), None, "one two three four five six seven"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array(texts)], names=["doc", "tag", "text"])
    got = pa.Table.from_batches(list(module._lines(3, 3)(iter([batch])))).to_pylist()
    want, seen = [], set()
    for doc, tag, text in zip((1, 2, 3), (4, 5, 6), texts):
        for i, line in enumerate((text or "").split("\n")):
            tokens = [module.FIELD if any(c.isdecimal() for c in t) else t for t in line.split()]
            if len(tokens) < 3:
                continue
            form, deep = module._hash(" ".join(tokens)), len(tokens) > 3
            cuts = [3 + (len(tokens) - 3) * j // 4 for j in range(5)]
            parts = [module._hash(" ".join(tokens[a:b]), len(tokens) * 4 + j) for j, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b] if deep else []
            want.append({"doc": doc, "tag": tag, "line": i, "tokens": len(tokens), "form": form, "fresh": form not in seen, "lead": [module._hash(t) for t in tokens[:3]] if deep and form not in seen else [], "parts": parts})
            seen.add(form)
    assert got == want
    searched = []
    monkeypatch.setattr(module, "DIGIT", type("D", (), {"search": staticmethod(lambda x: searched.append(x))}))
    module.masked_tokens("no number stands in this line")
    module.masked_tokens("room 101 of 7")
    assert searched == ["101", "7"]  # neither the line nor words of letters are searched

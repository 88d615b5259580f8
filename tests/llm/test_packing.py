import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm.packing import TIERS, Encoder, Packer, merge_ranks, pack_documents
from loomgraph.sources.tables import table
from tests.llm.docs import SCHEMA, awkward, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, texts):
    """Every id in exactly one piece, windows gapless and not over the longest, each full or a power of two."""
    lib = Tokenizer.from_file(PATH)
    windows, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
    assert set(docs) == set(texts)
    for doc_id, found in docs.items():
        ids = np.array([*lib.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for found in windows.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    return windows


def test_ids_equal_the_library():
    enc, lib = Encoder(PATH), Tokenizer.from_file(PATH)
    odd = ["a  b", "a   b", "a \nB", "x\n  y", "x\n \n y ", " lead", "  lead", "end ", "end  ", "\t z", "a<|endoftext|> b", "<|startoftext|>", "I'm we'll  's 'LL", "", " ", "  ", "\n\n", "a  b", "a   b", "q\x1c r"]
    odd += [r[1] for r in prose(20)] + ["a" * 50_000, " " * 50_000 + "x", "\n" * 50_000, "é1!" * 20_000]
    # every character between letters, digits, marks and white space
    for lo in range(0, 0x110000, 512):
        odd.append("".join(f"a{c}a 1{c}1 {c} !{c}!{c}{c} x" for c in map(chr, range(lo, lo + 512, 5)) if not 0xD800 <= ord(c) < 0xE000))
    assert enc.ranked is not None
    assert [enc.encode(t) for t in odd] == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_other_files_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, lib = Encoder(path), Tokenizer.from_file(path)
    assert enc.ranked is None and enc.encode("Hello  World") == np.array(lib.encode("Hello  World", add_special_tokens=False).ids, "<u4").tobytes()
    spec = json.loads(open(PATH, encoding="utf-8").read())
    assert len(merge_ranks(spec)) == 50256
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        assert merge_ranks(spec | change) is None


def test_pieces(spark):
    data = [r for r in awkward() if r[0] != 9] + prose(80)
    data = [(i, *r[1:]) for i, r in enumerate(data)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as start", "2 as length", "3 as tier").repartition(3)
    windows = check(pack_documents(df, PATH).collect(), {r[0]: r[1] for r in data})
    assert len(windows) > 20
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_driver_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    windows = check(pack_documents(docs, PATH).collect(), dict(docs.select("doc_id", "text").collect()))
    sizes = [sum(p.length for p in w) for w in windows.values()]
    assert all(s in TIERS for s in sizes[:-10]) and sum(s not in TIERS for s in sizes) <= 10


@pytest.mark.parametrize("n", [1, 63, 64, 200])
def test_step_groups_are_balanced(n):
    p = Packer(0)
    for i in range(n):
        p.add(i, b"\1\0\0\0" * (1023 if i % 2 else 300), b"\0\0\0\0")
    p.finish()
    groups = defaultdict(set)
    for r in p.rows:
        if r[7] == 1024:
            groups[r[8]].add(r[5])
    sizes = sorted(map(len, groups.values()))
    assert not sizes or sizes[-1] <= 64 and sizes[-1] - sizes[0] <= 1


def test_tiers():
    """Each tier has its own windows, opened by a piece of that tier; gaps hold pieces of shorter ones, few of them cut."""
    r = np.random.default_rng(4)
    lengths = [int(x) for x in np.exp(r.uniform(np.log(20), np.log(1500), 4000))]
    p = Packer(0)
    for i, n in enumerate(lengths):
        p.add(i, b"\1\0\0\0" * (n - 1), b"\0\0\0\0")
        if i % 1000 == 999:
            p.pack()
    p.finish()
    windows = defaultdict(list)
    for doc, start, length, _, total, seq, offset, tier, _ in p.rows:
        assert total == lengths[doc]
        windows[seq].append((offset, doc, start, length, tier))
    by_tier, pieces = Counter(), Counter()
    for found in windows.values():
        found.sort()
        tier = found[0][4]
        assert sum(f[3] for f in found) == tier
        by_tier[tier] += 1
        first = found[0][3]
        if tier in TIERS[1:] and first < tier:
            assert all(f[3] <= first for f in found)
            pieces[tier, first > tier // 2] += 1
        elif tier in TIERS:
            pieces[tier, True] += 1
    assert set(by_tier) >= set(TIERS) and min(by_tier[t] for t in TIERS) > 20
    assert all(pieces[t, False] <= 0.02 * pieces[t, True] for t in TIERS[1:])  # only where pieces were cut
    assert sum(t not in TIERS for t in by_tier) <= 10
    whole = sum(-(-n // 1024) for n in lengths)
    assert len(p.rows) <= 1.6 * whole  # cuts are at most one for each window

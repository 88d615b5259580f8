import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.llm.bpe import Codec, decode_documents, encode_documents, merge, round_trip
from tests.llm.docs import SCHEMA, awkward, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "ΑΣ ΟΔΥΣΣΕΥΣ Σ", "İstanbul x<|endoftext|>y Σ", "a\x1cb\x85c d", "éé\tI'LL we'd 123²", "x" * 3000 + "ab" * 3000, "<|startoftext|> <|endof|>", "日本語 テスト 👩‍👩‍👧",
    "﻿ a​b", "don't''s", "tokenisation of antidisestablishmentarianism",
]


def naive(ids, pairs):
    ids = list(ids)
    while True:
        ranked = [(pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        if not ranked:
            return ids
        _, i = min(ranked)
        ids[i : i + 2] = [pairs[ids[i], ids[i + 1]][1]]


def test_segment_tree_equals_naive_merging():
    r = random.Random(5)
    for _ in range(300):
        pairs, new = {}, 10
        for rank in range(30):
            pairs.setdefault((r.randrange(new), r.randrange(new)), (rank, new))
            new += 1
        ids = [r.randrange(5) for _ in range(r.randrange(0, 40))]
        assert merge(ids, pairs) == naive(ids, pairs)


def test_equals_the_library():
    codec, lib = Codec(PATH), Tokenizer.from_file(PATH)
    for text in ODD + [r[1] for r in prose()]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_every_code_point_equals_the_library():
    codec, lib = Codec(PATH), Tokenizer.from_file(PATH)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [" ".join(f"a{c}1{c}b" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    got = lib.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, got) if codec.encode(t) != e.ids] == []


def test_random_strings_of_all_planes_equal_the_library():
    codec, lib, r = Codec(PATH), Tokenizer.from_file(PATH), random.Random(1)
    ranges = [(0, 0xD800), (0xE000, 0x110000), (0, 0x3000), (0x10000, 0x20000), (0, 128)]
    texts = ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(1, 40))) for _ in range(10_000)]
    assert [t for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)) if codec.encode(t) != e.ids] == []


def test_query_rows(spark):
    lib, data = Tokenizer.from_file(PATH), awkward() + [(100 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' as ids_sha256", "1 as n_tokens")
    want = []
    for r in data:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(g[0]), *g[1:4]) for g in round_trip(df, PATH).collect()) == sorted(want)
    texts = {r.doc_id: r.text for r in decode_documents(encode_documents(df, PATH), PATH).collect()}
    assert texts[1] == "alpha</w> beta</w>" and texts[5] == ""
    assert round_trip(df.limit(0), PATH).count() == 0

"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Normalising and splitting follow the tokenizer file (NFC, white space as a
break, lower case; contractions, letters, single digits, runs of the rest; byte
level symbols, the last one with the end-of-word suffix); texts that hold code
points newer than Python's own Unicode tables are normalised and split by the
tokenizers library, whose tables may know them. The merges of a piece
are found by a segment tree whose leaves hold the ranks of adjacent pairs: its
root is the lowest rank and, among equals, the leftmost pair, and a merge is
three point updates of logarithmic cost. So a piece of n symbols takes
n log n steps, however long it is, and there is no limit on the length of text.

Defined results: a null text encodes as an empty one (no ids, empty decoded
text); special-token strings in a text become their ids; rows repeat as the
input does; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern by which the vocabulary's pieces are split.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
CONTROL = re.compile("[\x1c-\x1f]")  # str.split takes these for white space; the tokenizer does not
CACHED, CACHED_LENGTH = 1_500_000, 48  # entries of a worker's cache, and the longest text kept in it
NO_PAIR = 1 << 62


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """For every code point whether Python's tables leave it without a category: newer tables may take it for a letter, or have another case for it."""
    return np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)


def holds_unassigned(text: str) -> bool:
    return not text.isascii() and bool(unassigned()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from 256 upwards in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def merge(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``ids`` after all merges. ``pairs``: (left, right) to (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NO_PAIR] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        if (p := get((ids[i], ids[i + 1]))) is not None:
            tree[size + i] = p[0] << 32 | i  # the rank, then the place: least is the leftmost of the lowest rank
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    ids = ids[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        i += size
        tree[i] = key
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    while (top := tree[1]) != NO_PAIR:
        at = top & 0xFFFFFFFF
        gone = after[at]
        ids[at] = get((ids[at], ids[gone]))[1]
        nxt = after[at] = after[gone]
        ids[gone] = -1
        if nxt < n:
            before[nxt] = at
            p = get((ids[at], ids[nxt]))
            put(at, NO_PAIR if p is None else p[0] << 32 | at)
            put(gone, NO_PAIR)  # the pair that the right symbol headed is gone
        else:
            put(at, NO_PAIR)
        if (prev := before[at]) >= 0:
            p = get((ids[prev], ids[at]))
            put(prev, NO_PAIR if p is None else p[0] << 32 | prev)
    return [i for i in ids if i >= 0]


class Codec:
    """Encoder and decoder for a tokenizer file of this kind."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.pairs = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        symbols = byte_symbols()
        self.first = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + self.suffix) for s in symbols]
        self.pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace")
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return merge([i for i in ids if i is not None], self.pairs)

    def _chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for p in PIECE.findall(chunk):
            ids = self.pieces.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(p) <= CACHED_LENGTH:
                    self.pieces[p] = ids
            out += ids
        if len(chunk) <= CACHED_LENGTH:
            self.chunks[chunk] = out
        return out

    def _newer(self, text: str) -> list[int]:
        """Normalising and splitting by the library, merging as ever."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        out: list[int] = []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            ids = [self.vocab.get(s) for s in piece[:-1]] + [self.vocab.get(piece[-1] + self.suffix)]
            out += merge([i for i in ids if i is not None], self.pairs)
        return out

    def _plain(self, text: str) -> list[int]:
        if holds_unassigned(text):
            return self._newer(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # each character for itself: no final form
        parts = [p for p in SPACE.split(text) if p] if CONTROL.search(text) else text.split()
        if len(self.chunks) + len(self.pieces) > CACHED:
            self.chunks.clear()
            self.pieces.clear()
        get, make = self.chunks.get, self._chunk
        return list(chain.from_iterable([make(p) if (ids := get(p)) is None else ids for p in parts]))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.split_special is None or "<|" not in text and not self.split_special.search(text):
            return self._plain(text)
        out: list[int] = []
        for part in self.split_special.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """A worker process keeps its codec, with what it has cached, from task to task."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: one row per document, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i.as_py() or []) for i in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of both directions: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; ids and decoded text never leave their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Hierarchical packing of documents into token windows of several lengths.

Documents are tokenised (ids of the tokenizer file, then one end id). Whole
windows of the longest tier are cut off first; what remains of each document is
routed to the shortest tier that holds it. Each tier is then packed by itself,
the longest first: its longest piece opens a window, the gap takes the largest
pieces of shorter tiers that fit, and the last gap is closed by cutting a piece,
whose rest is routed anew. So every window of a tier is full, and short
documents that no long window has room for meet in short windows. What a
partition has left at its end, less than one long window, goes into windows of
the powers of two that add up to it, so nothing is padded at all. The full
windows of a tier are dealt to step groups of equal tokens in order of their
attention cost (the sum of squared piece lengths), back and forth, which
balances the groups.

A partition packs its own documents as they stream by, with a bounded buffer:
there is no shuffle, and a recomputed partition gives the same windows.

Defined results: a null text packs as an empty one (its end id only); repeated
rows are packed each for itself, and equal lengths in the order of arrival; null
ids stay null; very long texts give as many whole windows as they fill; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (128, 256, 512, 1024)
BUFFER = 2048  # documents whose remainders are packed together
STEP = 64  # windows of the longest tier in a step group; other tiers have as many tokens in theirs
ROWS = 20_000  # pieces handed over together

# Fixed value: the piece pattern of byte-level BPE files.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by token of a tokenizer file whose ids are its merges in order, over bytes and without normalising; None for any other."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return None
    back, vocab = byte_characters(), model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocab.get(t) != 256 + i for i, t in enumerate(merged)) or {vocab.get(c) for c in back} != set(range(256)):
        return None
    return {bytes(back[c] for c in t): vocab[t] for t in [*back, *merged]}


class Encoder:
    """Ids as little-endian bytes.

    Texts go whole through ranked merges over bytes where the file is of that
    kind; texts that name a special token, or that its splitter gives up on, and
    files of other kinds go through the tokenizers library. Ids are the same.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = merge_ranks(json.load(f))
        self.ranked = Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.ranked is None or any(s in text for s in self.special):
            return self._library(text)
        try:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except BaseException as e:  # the splitter's own limit on a very long run comes as a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            return self._library(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` of one partition; ``take`` hands over finished rows."""

    def __init__(self, part: int, tiers: tuple[int, ...] = TIERS, step: int = STEP):
        self.tiers, self.longest, self.step = tiers, tiers[-1], step
        self.next_id = self.next_group = part << 32
        self.open: list[list] = []  # pieces that wait for a window
        self.full: dict[int, list[list[tuple]]] = {t: [] for t in tiers}  # windows that wait for a step group
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes, end: bytes) -> None:
        ids += end
        n = len(ids) // 4
        whole = n - n % self.longest
        for s in range(0, whole, self.longest):
            self._window(self.longest, [(doc_id, s, ids[4 * s : 4 * (s + self.longest)], n)])
        if n > whole:
            self.open.append([doc_id, whole, ids[4 * whole :], n])

    def _window(self, tier: int, pieces: list[tuple]) -> None:
        self.full[tier].append(pieces)
        if len(self.full[tier]) == self._in_step(tier) * 16:
            self._groups(tier)

    def _in_step(self, tier: int) -> int:
        return self.step * self.longest // tier

    def _groups(self, tier: int) -> None:
        """Deal windows, dearest first, back and forth over as many groups as they fill."""
        full = self.full[tier]
        n = -(-len(full) // self._in_step(tier))
        full.sort(key=lambda pieces: -sum(len(p[2]) ** 2 for p in pieces))
        for i, pieces in enumerate(full):
            turn, at = divmod(i, n)
            self._emit(pieces, self.next_group + (at if turn % 2 == 0 else n - 1 - at))
        self.next_group += n
        self.full[tier] = []

    def _emit(self, pieces: list[tuple], group: int) -> None:
        offset, tier = 0, sum(len(p[2]) for p in pieces) // 4
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next_id, offset, tier, group))
            offset += len(ids) // 4
        self.next_id += 1

    def _tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def pack(self) -> None:
        """Fill the windows of each tier, longest first; pieces too few to fill a window of their tier go on waiting."""
        left = sum(len(p[2]) for p in self.open) // 4
        shelf: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}  # of each tier: (length, piece) in order
        for i, p in enumerate(self.open):
            n = len(p[2]) // 4
            shelf[self._tier(n)].append((n, i))
        for waiting in shelf.values():
            waiting.sort()

        def take(most: int) -> int | None:
            """The largest waiting piece of at most so many tokens, from the longest tier that has one."""
            for t in reversed(self.tiers):
                if (k := bisect_right(shelf[t], (most, len(self.open)))) > 0:
                    return shelf[t].pop(k - 1)[1]
            return None

        def cut(gap: int) -> tuple:
            """The first tokens of the shortest waiting piece, whose rest is routed anew."""
            _, i = shelf[next(t for t in self.tiers if shelf[t])].pop(0)
            doc_id, start, ids, n = self.open[i]
            self.open[i] = [doc_id, start + gap, ids[4 * gap :], n]
            rest = len(ids) // 4 - gap
            insort(shelf[self._tier(rest)], (rest, i))
            return doc_id, start, ids[: 4 * gap], n

        for tier in reversed(self.tiers):
            while shelf[tier] and left >= tier:
                window, gap = [], tier
                while gap:
                    i = take(gap)  # the tier's own longest piece first, as longer tiers are done
                    window.append(cut(gap) if i is None else tuple(self.open[i]))
                    gap -= len(window[-1][2]) // 4
                self._window(tier, window)
                left -= tier
        self.open = [self.open[i] for t in reversed(self.tiers) for _, i in reversed(shelf[t])]

    def finish(self) -> None:
        """What waits is cut at the powers of two that add up to it."""
        self.pack()
        for tier in self.tiers:
            if self.full[tier]:
                self._groups(tier)
        left = sum(len(p[2]) for p in self.open) // 4
        waiting = iter(self.open)
        piece = next(waiting, None)
        while left:
            size = gap = min(1 << (left.bit_length() - 1), self.longest)
            window = []
            while gap:
                doc_id, start, ids, n = piece
                used = min(gap, len(ids) // 4)
                window.append((doc_id, start, ids[: 4 * used], n))
                gap -= used
                piece = [doc_id, start + used, ids[4 * used :], n] if 4 * used < len(ids) else next(waiting, None)
            self._emit(window, self.next_group)
            left -= size
        self.open = []

    def take(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), types)], names=[f.split()[0] for f in SCHEMA.split(", ")])
        self.rows = []
        return batch


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc, waiting = Packer(TaskContext.get().partitionId(), tiers, step), encoder(path), 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc_id, enc.encode(text.as_py() or ""), end)
                waiting += 1
                if waiting >= BUFFER:
                    packer.pack()
                    waiting = 0
                if len(packer.rows) >= ROWS:
                    yield packer.take()
        packer.finish()
        if (rows := packer.take()) is not None:
            yield rows

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SCHEMA)

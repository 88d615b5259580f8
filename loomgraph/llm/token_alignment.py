"""Alignment of two tokenizers' tokens by the bytes where they end.

A whole run of an Arrow batch is aligned at once. Its texts, each led by a
space, are laid end to end; both tokenizers' token ends are byte offsets in that
one string, counted by ``bincount``. Where A and B tokens both end the texts are
cut into groups, and the two tokens that end there are linked (every token has
at least one byte, so a cut is one link). Positions, groups and counts of all
documents come from prefix sums over the string, parted at the documents.

How often a pair of ids is linked is counted over the whole corpus. Documents
then look their pairs up: in a sorted array that goes to all workers while the
distinct pairs are no more than ``MOST_BROADCAST`` (17 bytes each), by a
shuffled join on the pair beyond that. Both give the same rows.

Defined results: a text that is null or empty, or whose A or B tokens don't
spell a space and the text, has no tokens: zeros and an empty ``groups_sha256``;
special-token strings in a text are plain text; repeated rows come out as often
as they went in, and count each time; null ids stay null; very long texts are
aligned whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.packing import Encoder, byte_characters
from loomgraph.session import written

RUN_BYTES = 4 << 20  # text that is laid end to end; a longer text is a run of its own
MOST_BROADCAST = 2_000_000
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class PlainEncoder(Encoder):
    """Ids of a byte-level file; special-token strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.special = []
        back = byte_characters()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encode(" " + t), "<u4") for t in texts]


class PieceEncoder:
    """Ids of a sentencepiece model that adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = m.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if m.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "<u4") for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def encoder(path: str) -> PlainEncoder | PieceEncoder:
    """A worker process keeps its encoders from task to task."""
    return PieceEncoder(path) if path.endswith(".model") else PlainEncoder(path)


class Aligner:
    def __init__(self, a, b):
        self.encoders = (a, b)
        self.spelled = [pa.array(e.bytes, pa.binary()) for e in (a, b)]
        self.sizes = [np.array([len(t) for t in e.bytes], np.int64) for e in (a, b)]
        ids = range(max(len(a.bytes), len(b.bytes)))
        # an id and what follows it: another of the group, the group's B side, the next group
        self.written = pa.array([f"{i}{s}".encode() for i in ids for s in ",|;"], pa.large_binary())

    def spelling(self, side: int, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """All token bytes of a run, and where each document's end among them."""
        at = np.concatenate([[0], np.cumsum(self.sizes[side][ids])])
        return memoryview(self.spelled[side].take(pa.array(ids)).buffers()[2] or b""), at[ends]

    def run(self, texts: list[str | None]) -> list[tuple]:
        """``n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` of each text."""
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
        out = [none] * len(texts)
        asked = [i for i, t in enumerate(texts) if t]
        both = [e.ids([texts[i] for i in asked]) for e in self.encoders]
        flat = [np.concatenate(x) if x else np.zeros(0, "<u4") for x in both]
        spelled = [self.spelling(s, f, np.cumsum([0, *map(len, x)])) for s, (f, x) in enumerate(zip(flat, both))]
        good = []
        for n, i in enumerate(asked):
            want = (" " + texts[i]).encode()
            if all(bytes(buffer[at[n] : at[n + 1]]) == want for buffer, at in spelled):
                good.append(n)
        if not good:
            return out
        if len(good) < len(asked):
            flat = [np.concatenate([x[n] for n in good]) for x in both]
        counts = [np.array([len(x[n]) for n in good]) for x in both]
        ends = [np.cumsum(self.sizes[s][f]) for s, f in enumerate(flat)]
        total = int(ends[0][-1])
        cut = (np.bincount(ends[0], minlength=total + 1) > 0) & (np.bincount(ends[1], minlength=total + 1) > 0)
        before = np.cumsum(cut) - cut  # cuts before an offset: the group of a token that ends there
        linked = [cut[e] for e in ends]
        group = [before[e] for e in ends]
        per = [np.bincount(g, minlength=int(cut.sum())) for g in group]
        place_a = np.arange(len(flat[0])) + (np.cumsum(per[1]) - per[1])[group[0]]
        place_b = np.arange(len(flat[1])) + np.cumsum(per[0])[group[1]]
        code = np.empty(len(flat[0]) + len(flat[1]), np.int64)
        code[place_a] = flat[0] * np.int64(3) + linked[0]
        code[place_b] = flat[1] * np.int64(3) + 2 * linked[1]
        told = self.written.take(pa.array(code))
        text, at = memoryview(told.buffers()[2]), np.frombuffer(told.buffers()[1], "<i8")[: len(code) + 1]
        pairs = flat[0][linked[0]].astype(np.int64) << 32 | flat[1][linked[1]]
        token = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        links = np.concatenate([[0], np.cumsum(linked[0])])[token[0]]  # a document's share of all links
        for n, g in enumerate(good):
            i, j = token[0][n] + token[1][n], token[0][n + 1] + token[1][n + 1]
            found, times = np.unique(pairs[links[n] : links[n + 1]], return_counts=True)
            size = int(links[n + 1] - links[n])
            out[asked[g]] = (int(counts[0][n]), int(counts[1][n]), size, size, hashlib.sha256(text[at[i] : at[j] - 1]).hexdigest(), found, times.astype(np.int32))
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(encoder(path_a), encoder(path_b))


def runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows of a batch from, to: texts of about ``RUN_BYTES`` together."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > RUN_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts, the digest of its groups, and its distinct linked pairs (A id in the upper half) with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = aligner(path_a, path_b)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in batches:
            sizes = [n or 0 for n in pa.compute.binary_length(b.column(1)).to_pylist()]
            for start, stop in runs(sizes):
                found = a.run(b.column(1)[start:stop].to_pylist())
                n_a, n_b, groups, links, sha, pairs, times = zip(*found)
                at = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (pairs, times)]
                cols = [pa.array(range(row, row + stop - start), pa.int64()), b.column(0)[start:stop], *[pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)], pa.array(sha, pa.string()), *lists]
                row += stop - start
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, n, best``: how often ids are linked corpus-wide, and whether no other A id is linked with the B id more often."""
    n = found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    n = written(n.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    return n.join(n.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def looked_up(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts from a sorted array of all pairs: for a number of pairs that has been checked."""
    table = counts.orderBy("pair").toArrow()
    spark = found.sparkSession
    known = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for b in batches:
            asked, times = np.asarray(b.column("pairs").flatten()), np.asarray(b.column("times").flatten()).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(np.asarray(b.column("pairs").value_lengths()))])
            place = np.searchsorted(pair, asked)
            over = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)])[at][1:] - np.concatenate([[0], np.cumsum(x)])[at][:-1], pa.int64())
            rest = [b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*rest, over(np.where(best[place], times, 0) if len(place) else times), over(n[place] * times if len(place) else times), b.column("groups_sha256")], names=list(COLUMNS))

    return found.drop("row").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def joined(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on the pair."""
    each = found.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def token_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per document."""
    found = written(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    counts = written(pair_counts(found), "counts")
    return (looked_up if counts.count() <= MOST_BROADCAST else joined)(found, counts)

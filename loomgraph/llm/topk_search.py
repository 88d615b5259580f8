"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers. The index holds, for a block of rows, a
bitmap per attribute and bit. A query adds the slices of all attributes, each
shifted by the set bits of its weight, with carry-save adders on bitmaps; the
sum is again a set of slices. The top rows are then selected from the most
significant slice downward, and rows of equal score at the boundary are
resolved exactly, by their ids. There is no approximation anywhere.

Blocks and chunks of queries have a fixed size, so a task's memory is bounded;
only each block's best ``k`` per query are shuffled.

Defined results: vectors that are null, or hold a null or a component that
isn't finite, take no part, nor do rows with a null id; shorter vectors count
as padded by zeros; rows that carry the query's id count as its own; a query id
that repeats is asked once, with its least vector; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import written

BLOCK_VALUES = 1 << 21  # components in a block of the index
CHUNK = 256  # queries in a chunk
INDEX = "block long, n long, ids binary, low array<long>, bits array<int>, slices binary"
PARTIAL = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id, q``: components as floor(scale * x)."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & fine).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q")
    )


def padded(rows: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def slice_block(x: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """Least value and number of bits of each attribute, and the bitmaps of (value - least), bit by bit."""
    low = x.min(0)
    rows = -(-len(x) // 64) * 64
    bits, parts = [], []
    for d in range(x.shape[1]):
        u = np.zeros(rows, np.uint64)
        u[: len(x)] = (x[:, d] - low[d]).astype(np.uint64)
        n = int(u.max()).bit_length()
        bits.append(n)
        parts += [np.packbits((u >> np.uint64(b)) & np.uint64(1) == 1, bitorder="little").tobytes() for b in range(n)]
    return low.tolist(), bits, b"".join(parts)


def add_slices(weights: np.ndarray, low: list[int], slices: list[np.ndarray]) -> tuple[list[np.ndarray | None], int]:
    """Slices of a non-negative sum, and the constant that makes it the inner product with ``weights``.

    A negative weight takes the complement of its attribute, so that only additions occur.
    """
    buckets: dict[int, list[np.ndarray]] = defaultdict(list)
    constant = 0
    for w, lo, bitmap in zip(map(int, weights), low, slices):
        constant += w * lo
        if w < 0:
            bitmap = ~bitmap
            constant += w * ((1 << len(bitmap)) - 1)
            w = -w
        for j in range(w.bit_length()):
            if w >> j & 1:
                for b in range(len(bitmap)):
                    buckets[j + b].append(bitmap[b])
    out: list[np.ndarray | None] = []
    at = 0
    while at <= max(buckets, default=-1):
        waiting = buckets[at]
        while len(waiting) > 2:
            a, b, c = waiting.pop(), waiting.pop(), waiting.pop()
            half = a ^ b
            buckets[at + 1].append((a & b) | (half & c))
            waiting.append(half ^ c)
        if len(waiting) == 2:
            a, b = waiting
            buckets[at + 1].append(a & b)
            waiting[:] = [a ^ b]
        out.append(waiting[0] if waiting else None)
        at += 1
    return out, constant


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(total: list[np.ndarray | None], among: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest sums: sure rows from the top slice down, then boundary rows by id."""
    sure, maybe = np.zeros_like(among), among
    for s in reversed(total):
        if s is None:
            continue
        with_bit = maybe & s
        n = int(np.bitwise_count(sure | with_bit).sum())
        if n > k:
            maybe = with_bit
        else:
            sure = sure | with_bit
            maybe = maybe & ~s
            if n == k:
                break
    found = positions(sure)
    if len(found) < k:
        edge = positions(maybe)
        found = np.concatenate([found, edge[np.argsort(ids[edge], kind="stable")[: k - len(found)]]])
    return found


def search_block(queries: list[tuple[int, np.ndarray]], n: int, ids: np.ndarray, low: list[int], bits: list[int], raw: bytes, k: int) -> list[tuple[int, int, int]]:
    words = -(-n // 64)
    flat = np.frombuffer(raw, "<u8").reshape(-1, words)
    ends = np.cumsum(bits)
    slices = [flat[e - b : e] for e, b in zip(ends, bits)]
    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    out = []
    for query_id, weights in queries:
        among = valid
        if len(own := np.flatnonzero(ids == query_id)):
            mask = np.ones(words * 64, bool)
            mask[own] = False
            among = valid & np.packbits(mask, bitorder="little").view(np.uint64)
        total, constant = add_slices(weights, low, slices)
        for p in select_top(total, among, ids, k):
            score = sum((int(s[p >> 6]) >> (int(p) & 63) & 1) << w for w, s in enumerate(total) if s is not None)
            out.append((query_id, int(ids[p]), score + constant))
    return out


def build_index(q: DataFrame, blocks: int, dims: int) -> DataFrame:
    """The index, a row for each block."""

    def build(t: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        x = padded(t["q"].to_pylist(), dims)
        low, bits, raw = slice_block(x)
        return pa.table(
            {"block": t["block"][:1], "n": pa.array([len(ids)]), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "low": pa.array([low], pa.list_(pa.int64())), "bits": pa.array([bits], pa.list_(pa.int32())), "slices": pa.array([raw], pa.binary())}
        )

    return q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInArrow(build, INDEX)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products, ties to the smaller id."""
    q = quantised(vectors, id_col, vector_col)
    asked = quantised(queries, id_col, vector_col).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("q").alias("q"))
    n, dims = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    dims = max(1, dims)
    blocks = max(1, -(-n * dims // BLOCK_VALUES))
    index = written(build_index(q, blocks, dims), "slices")
    chunks = max(1, -(-asked.count() // CHUNK))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block = right.slice(0, 1).to_pylist()[0]
            weights = padded(left["q"].to_pylist(), dims)
            found = search_block(list(zip(left["query_id"].to_pylist(), weights)), block["n"], np.frombuffer(block["ids"], "<i8"), block["low"], block["bits"], block["slices"], k)
        cols = list(zip(*found)) if found else [[], [], []]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), cols)})

    # each chunk of queries meets each block of rows once
    by_block = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    by_chunk = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    partial = by_block.groupBy("block", "chunk").cogroup(by_chunk.groupBy("block", "chunk")).applyInArrow(search, PARTIAL)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

"""Quality classifier: histogram gradient-boosted trees over document statistics.

A scan turns each whole text into a short row of statistics. Trees are grown
by numpy on a bounded sample of labelled rows (``max_rows``), their inputs cut
to at most ``BINS`` bins, and flattened into arrays of perfect trees, which a
batch of documents descends level by level without a Python loop over rows.

Defined results: null texts score as empty ones; with no label, or labels of
one class only, every score is the share of label 1 (0.5 without labels);
rows with a null id or a null label are never learned from; an id with several
labels is learned with their mean, and one with several texts with that of the
least statistics; repeated rows each give a row, and equal texts score alike; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold
from loomgraph.session import written

BINS = 128
FEATURES = (
    "chars", "words", "mean_word", "sd_word", "long_words", "short_words", "distinct_words", "top_word", "once_words", "lines", "mean_line", "short_lines", "repeated_lines",
    "closed_lines", "alpha", "digit", "upper", "space", "punct", "symbol", "wide", "entropy", "sentence", "repeated_pairs", "capital_words", "pipes", "url_marks", "all_upper", "longest_word", "odd_words",
)
_KIND = np.zeros(256, np.int8)  # of a byte: 1 letter, 2 digit, 3 space, 4 punctuation of prose, 5 symbol, 6 part of a wide character
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 6 if _i > 127 else 1 if _c.isalpha() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:!?'\"()-" else 5
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words, lines = text.split(), text.split("\n")
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, nw, nl = max(1, len(raw)), max(1, len(words)), len(lines)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=7) / n
    p = counts[counts > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    by_word, by_line = Counter(words), Counter(x for x in lines if x)
    pairs = Counter(zip(words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes > 12).mean(), (sizes <= 3).mean(),
        len(by_word) / nw, max(by_word.values(), default=0) / nw, sum(c == 1 for c in by_word.values()) / nw,
        np.log1p(nl), np.log1p(len(text) / nl), sum(len(x) < 30 for x in lines) / nl, 1 - len(by_line) / max(1, sum(by_line.values())),
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / nl, *kinds[1:3], counts[65:91].sum() / n, *kinds[3:7],
        float(-(p * np.log2(p)).sum()), (counts[46] + counts[33] + counts[63]) / nw, 1 - len(pairs) / max(1, len(words) - 1),
        sum(w[:1].isupper() for w in words) / nw, counts[124] / nw, text.count("http") / nw, sum(w.isupper() and len(w) > 1 for w in words) / nw,
        np.log1p(sizes.max()), sum(1 for w in words if ODD.search(w)) / nw,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [[float(v) for v in statistics(t.as_py())] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, stats array<double>")


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 5, rate: float = 0.1, least: int = 20, ridge: float = 1.0) -> dict:
    """Boosted trees as flat arrays: ``feature`` and ``cut`` (trees x inner nodes), ``leaf`` (trees x leaves), and the base score."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = {"base": np.log(share / (1 - share)), "depth": depth, "feature": np.zeros((0, 2**depth - 1), np.int32), "cut": np.zeros((0, 2**depth - 1)), "leaf": np.zeros((0, 2**depth))}
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], 1)  # bin i: values in (cut i-1, cut i]
    n_rows, n_features = x.shape
    score, trees = np.full(n_rows, model["base"]), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf), np.zeros(n_rows, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            key = (node * BINS)[:, None] + binned
            hist = np.stack([[np.bincount(key[:, f], w, width * BINS) for f in range(n_features)] for w in (g, h, np.ones(n_rows))]).reshape(3, n_features, width, BINS)
            left = hist.cumsum(3)
            total = left[..., -1:]
            right = total - left
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[2] < least) | (right[2] < least)] = -np.inf
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            pick = best.argmax(1)
            for j in np.flatnonzero(best[np.arange(width), pick] > 1e-6):
                f, b = divmod(int(pick[j]), BINS)
                if b < len(cuts[f]):
                    feature[first + j], cut[first + j] = f, cuts[f][b]
            node = 2 * node + (x[np.arange(n_rows), feature[first + node]] > cut[first + node])
        sums = [np.bincount(node, w, 2**depth) for w in (g, h)]
        leaf = -rate * sums[0] / (sums[1] + ridge)
        score += leaf[node]
        trees.append((feature, cut, leaf))
    return model | {k: np.stack([t[i] for t in trees]) for i, k in enumerate(("feature", "cut", "leaf"))}


def traverse(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row: all trees and rows go down a level at a time."""
    trees = np.arange(len(model["leaf"]))[None, :]
    node = np.zeros((len(x), len(model["leaf"])), np.int64)
    rows = np.arange(len(x))[:, None]
    for level in range(model["depth"]):
        at = node + 2**level - 1
        node = 2 * node + (x[rows, model["feature"][trees, at]] > model["cut"][trees, at])
    return 1 / (1 + np.exp(-(model["base"] + model["leaf"][trees, node].sum(1))))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Learns from labels outside the held-out fold (crc32 of the id as text, modulo 5, is 0): at most ``max_rows`` documents, those of the least id hashes.
    """
    stats = written(document_statistics(docs, id_col, text_col), "stats")
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter((fold("doc_id", 5) != 0) & F.col("y").isNotNull())
    # one row a document on both sides, so that repeated ids bring no more rows to the driver
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = stats.join(known, "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.first("y").alias("y")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["stats"].tolist()).reshape(len(rows), len(FEATURES))
    shared = docs.sparkSession.sparkContext.broadcast(grow(x, rows["y"].to_numpy(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = traverse(shared.value, b.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return stats.select("doc_id", held.alias("held_out"), "stats").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")

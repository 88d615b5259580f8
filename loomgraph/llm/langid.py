"""Language identification by word-first backoff.

Known words score by their per-language log frequency. An unseen word falls
back to the longest character n-grams of it that are known, then to shorter
ones. Word and n-gram counts are taken by Spark over a bounded sample of
labelled documents: of each language at most ``max_docs`` documents and
``max_chars`` characters, so that a rare language learns from as many rows as a
common one. All counts of the sample are kept; its bounds bound the model.

Words and n-grams are known by 64-bit hashes. An entry holds only the languages
that it was seen in, and each language has one value for all entries that it
lacks; so the model grows with the languages' samples, not with entries times
languages.

Defined results: null texts and texts without a letter give ``und`` with score
0; a text with letters always gets a learned language, ties going to the first
in order of name; with nothing to learn from, every row is ``und``; repeated
rows each give a row, and repeated labelled rows are learned from each; null ids
are never learned from and count as not held out; very long texts are scored
whole; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import fold
from loomgraph.session import written

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
KEPT_WORDS = 300_000  # entries of a task's cache of scored words
COUNTS = "lang string, is_word boolean, h long, n long"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty where the text has no letter."""
    found = WORD.findall(text.lower()) if text else []
    if found and not any(w.isalpha() for w in found) and not any(c.isalpha() for w in found for c in w):
        return []  # numerals that count as word characters, such as superscripts
    return found


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def hashed(texts: list[str]) -> np.ndarray:
    """Hashes of words or n-grams, as signed longs."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(t.encode("utf-8", "replace")) for t in texts), np.uint64, len(texts)).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for key, counts in words.items():
            grams: Counter = Counter()
            for w, c in counts.items():
                for size in range(1, LONGEST_GRAM + 1):
                    for g in grams_of(w, size):
                        grams[g] += c
            for is_word, found in ((True, counts), (False, grams)):
                n = len(found)
                cols = [pa.array([key] * n, pa.string()), pa.array([is_word] * n, pa.bool_()), pa.array(hashed(list(found))), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "is_word", "h", "n"])
        words.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            words[lang.as_py()].update(words_of(text.as_py()))
            if sum(map(len, words.values())) > 200_000:
                yield from flush()
    yield from flush()


class Frequencies(NamedTuple):
    """Log frequencies by hash: entry ``i`` adds ``gain[first[i] : first[i + 1]]`` to the ``base`` of the languages ``lang[...]``."""

    known: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For entries ``at`` the place in ``at`` of each value they hold, and the place of the value."""
        size = self.first[at + 1] - self.first[at]
        owner = np.repeat(np.arange(len(at)), size)
        return owner, np.arange(len(owner)) + (self.first[at] - np.cumsum(size) + size)[owner]


def frequencies(h: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int) -> Frequencies:
    """From the counts ``n`` of hashes by language, half a count added to each."""
    order = np.lexsort((lang, h))
    h, lang, n = h[order], lang[order], n[order]
    known, first = np.unique(h, return_index=True)
    base = np.log(0.5 / (np.bincount(lang, n, langs) + 0.5 * max(1, len(known))))
    return Frequencies(known, np.append(first, len(h)), lang, np.log((n + 0.5) / 0.5).astype(np.float32), base - (base.mean() if langs else 0))


def fit(labelled: DataFrame) -> dict:
    """A model from the columns ``text`` and ``lang``: names of languages, and the frequencies of words and of n-grams."""
    counts = labelled.select("text", "lang").mapInArrow(_count, COUNTS)
    total = written(counts.groupBy("is_word", "h", "lang").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r.lang for r in total.select("lang").distinct().collect())
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1 if langs else F.lit(0)
    model: dict = {"langs": langs}
    for name, kind in (("words", F.col("is_word")), ("grams", ~F.col("is_word"))):
        found = total.filter(kind).select("h", place.cast("int").alias("lang"), "n").toArrow()
        model[name] = frequencies(*[found[c].to_numpy() for c in ("h", "lang", "n")], len(langs))
    return model


def rows_in(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row of each wanted hash, -1 where it isn't known."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


class Scorer:
    """Scores texts against a model; the distinct words of a batch are looked up together, and cached."""

    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.table = np.zeros((4096, len(self.langs)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words: their own, or the mean over their longest known n-grams."""
        langs = len(self.langs)
        out = np.zeros((len(words), langs))
        at = rows_in(self.words.known, hashed(words))
        mine = np.flatnonzero(at >= 0)
        owner, value = self.words.rows(at[mine])
        out[mine] = self.words.base
        out[mine[owner], self.words.lang[value]] += self.words.gain[value]  # an entry has a language once
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST_GRAM, 0, -1):
            grams = [grams_of(words[i], n) for i in left]
            sizes = np.fromiter(map(len, grams), np.int64, len(left))
            at = rows_in(self.grams.known, hashed([g for found in grams for g in found]))
            word = np.repeat(np.arange(len(left)), sizes)[at >= 0]
            hits = np.bincount(word, minlength=len(left))
            owner, value = self.grams.rows(at[at >= 0])
            gain = np.bincount(word[owner] * langs + self.grams.lang[value], self.grams.gain[value], len(left) * langs).reshape(len(left), langs)
            met = hits > 0
            out[left[met]] = self.grams.base + gain[met] / hits[met, None]
            left = left[~met]
            if not len(left):
                break
        return out

    def _learn(self, new: list[str]) -> None:
        rows, used = self.rows(new), len(self.seen)
        while used + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[used : used + len(new)] = rows
        self.seen.update(zip(new, range(used, used + len(new))))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words_of(t) for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.seen) > KEPT_WORDS:
            self._reset()
        seen = self.seen
        new = list({w for words in found for w in words if w not in seen})
        if new:
            self._learn(new)
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.table[list(map(seen.__getitem__, words))].sum(0, dtype=np.float64) / np.sqrt(len(words))
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def _scored(scorer: Scorer, column: pa.Array) -> list[tuple[str, float]]:
    """Predictions of a column, some documents at a time, so that their words take bounded memory."""
    return [x for lo in range(0, len(column), 256) for x in scorer.predict_all(column.slice(lo, 256).to_pylist())]


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = _scored(scorer, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(id_col, 4) == 2, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without texts that have no letter (null and empty ones, too) or whose language scores below ``least``.

    Rows pass through as they are, without a join: ids may repeat or be null, and
    columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in _scored(scorer, b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 8_000) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold, at most ``max_docs`` of each language, and predict all documents."""
    return identify(docs, fit_on(docs, id_col, text_col, lang_col, max_docs), id_col, text_col)


def sample_by_language(labelled: DataFrame, max_docs: int, max_chars: int) -> DataFrame:
    """Of each language of ``id, text, lang`` the rows of the least id hashes, each once: at most ``max_docs``, and no more once there are ``max_chars`` characters.

    Which rows these are is found on hashes and lengths alone. A share of the
    hash range that surely holds them is cut off first, so that no task gets more
    of a language than a few times the bound.
    """
    place, order = F.pmod(F.xxhash64("id"), F.lit(1 << 30)), F.xxhash64("id", F.xxhash64("text"))
    rows = labelled.withColumns({"at": F.struct(place.alias("place"), order.alias("order")), "chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    keys = rows.select("lang", "at", "chars")
    sizes = written(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars")), "langs")
    share = F.lit(4.0) * F.greatest(F.least(F.lit(max_docs) / F.col("rows"), F.lit(max_chars) / F.greatest(F.col("chars"), F.lit(1))), F.lit(100.0) / F.col("rows"))
    near = keys.join(sizes.select("lang", share.alias("share")), "lang").filter(F.col("at.place") < F.col("share") * (1 << 30)).groupBy("lang", "at").agg(F.max("chars").alias("chars"))
    w = Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumns({"nth": F.count(F.lit(1)).over(w), "before": F.sum("chars").over(w) - F.col("chars")})
    last = written(near.filter((F.col("nth") <= max_docs) & (F.col("before") < max_chars)).groupBy("lang").agg(F.max("at").alias("last")), "sample")  # one row a language
    return rows.join(last, "lang").filter(F.col("at") <= F.col("last")).groupBy("lang", "at").agg(F.first("text").alias("text")).select("text", "lang")


def fit_on(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int = 8_000, max_chars: int = 40_000_000) -> dict:
    """A model from the labelled documents outside the held-out fold; ``max_docs`` and ``max_chars`` bound the sample of each language."""
    named: dict[str, Column] = {"id": F.col(f"`{id_col}`"), "text": F.col(f"`{text_col}`"), "lang": F.col(f"`{lang_col}`").cast("string")}
    labelled = docs.filter((fold(id_col, 4) != 2) & F.col(f"`{lang_col}`").isNotNull()).select(*[c.alias(k) for k, c in named.items()])
    return fit(sample_by_language(labelled, max_docs, max_chars))

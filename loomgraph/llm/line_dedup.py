"""Line dedup with a log-template tree of fixed depth.

A line goes down the tree by its token count and its leading tokens, variable
ones (those with a digit) masked. Each of the leading levels also has a field
branch, which holds the lines of whatever token at that place. A line goes down
every path that takes one leading token as it is and the field branch at the
other levels, and the leaf is told further by one of four parts of the rest of
the line; so fields at any three places leave some leaf common to all lines of a
template, unless they are just the leading ones. In a leaf the tokens are counted by place. The
places of a line whose tokens are as frequent there as the ``constant`` share of
its most frequent ones are constants, the others become fields: lines with the
same constants are one template. So a leaf has any number of templates, and
other lines in it, however many, don't hide one.

A template (or a line as it stands) that recurs in ``min_docs`` documents or
more is dropped from all of them but the first (the least id), so that what a
passage says stays in the corpus once. A long line (``long_tokens``) is dropped
as soon as a second document holds it, but not from a document that shares more
than half of its lines with one earlier document: that is a copy, which dedup of
documents is to judge as a whole.

Lines travel as hashes; only lines of leaves that several forms and enough
documents share are looked at again by token. Everything is grouped counts and
equi-joins: a scan marks the first of each form it meets, so that a form, leaf or
template that a third of all lines share meets no single task.

Defined results: null texts have no lines and stay null; blank lines and lines
of fewer than ``min_tokens`` tokens have no template and stay; rows that repeat
an id and text get the same result, rows of one id with other texts count as
one document; null ids count as one document that comes last; very long texts
are cut whole; an empty table gives an empty result; all other columns pass
through, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import free_names
from loomgraph.session import written

DIGIT = re.compile(r"\d")
FIELD = "<*>"
PARTS = 4  # of the tokens after the leading ones
TAKEN = 2  # leaves in which the tokens of a form are counted
ALIKE = 0.75  # share of the count that a line's constants have at least, which a token needs to be one
LINES = "doc long, tag long, line int, tokens int, form long, fresh boolean, lead array<long>, parts array<long>"
LAST = (1 << 63) - 1
SEEN = 400_000  # forms that a task remembers to mark the first of each


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), seed) - (1 << 63)


def masked_tokens(line: str) -> list[str]:
    tokens = line.split()
    found = DIGIT.search
    if not (any(map(line.__contains__, "0123456789")) if line.isascii() else found(line)):
        return tokens
    return [t if t.isalpha() or not found(t) else FIELD for t in tokens]  # letters alone, as most, need no search


@lru_cache
def part_bounds(size: int, depth: int) -> tuple[tuple[int, int, int], ...]:
    """First and last place of the parts of the tokens after the leading ones, none empty, and a seed of each place and token count."""
    cuts = [depth + (size - depth) * i // PARTS for i in range(PARTS + 1)]
    return tuple((cuts[i], cuts[i + 1], size * PARTS + i) for i in range(PARTS) if cuts[i] < cuts[i + 1])


def _signed(values: array) -> np.ndarray:
    """Digests as ``_hash`` gives them."""
    return (np.frombuffer(values, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int32)]).astype(np.int32)), pa.array(values))


def _lines(depth: int, min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, seen = xxhash.xxh3_64_intdigest, set()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                of_doc, place, tokens_, fresh_, n_lead, n_parts = [], [], [], [], [], []
                form_, lead, parts = array("Q"), array("Q"), array("Q")
                if len(seen) > SEEN:
                    seen.clear()
                for text in part.column(2).to_pylist():
                    before = len(place)
                    for i, line in enumerate((text or "").split("\n")):
                        tokens = masked_tokens(line)
                        size = len(tokens)
                        if size < min_tokens:
                            continue
                        deep = size > depth
                        if deep:  # what a line and its parts say is put together once
                            said = [" ".join(tokens[:depth]).encode("utf-8", "replace")]
                            for first, last, seed in part_bounds(size, depth):
                                x = " ".join(tokens[first:last]).encode("utf-8", "replace")
                                parts.append(digest(x, seed))
                                said.append(x)
                            form = digest(b" ".join(said))
                        else:
                            form = digest(" ".join(tokens).encode("utf-8", "replace"))
                        fresh = form not in seen
                        place.append(i)
                        tokens_.append(size)
                        form_.append(form)
                        fresh_.append(fresh)
                        n_parts.append(len(said) - 1 if deep else 0)
                        n_lead.append(depth if fresh and deep else 0)
                        if fresh:
                            seen.add(form)
                            if deep:
                                lead.extend([digest(t.encode("utf-8", "replace")) for t in tokens[:depth]])
                    of_doc.append(len(place) - before)
                docs, tags = (pa.array(np.repeat(c.to_numpy(), of_doc), pa.int64()) for c in part.columns[:2])
                cols = [docs, tags, pa.array(place, pa.int32()), pa.array(tokens_, pa.int32()), pa.array(_signed(form_)), pa.array(fresh_, pa.bool_()), _lists(_signed(lead), n_lead), _lists(_signed(parts), n_parts)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in LINES.split(", ")])

    return run


def _keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.col(f"`{text_col}`")
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)), F.xxhash64(text), text


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):  # a few documents at a time bound the memory
            part = b.slice(lo, 64)
            form, hashes, sizes = [], array("q"), []
            for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                lines = text.split("\n")
                for w in wanted:
                    tokens = masked_tokens(lines[w["line"]])
                    form.append(w["form"])
                    hashes.extend([_hash(t) for t in tokens])
                    sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.int64()), _lists(np.frombuffer(hashes, np.int64), sizes)], names=["form", "hashes"])


def leaves(lines: DataFrame, holders: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """``key, form, doc, tag, line`` of the forms of each leaf that several forms and ``min_docs`` documents share; of the fullest leaf of each part a form takes the two fullest."""
    part = lines.select("form", "fresh", F.explode("parts").alias("part"))
    often = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    forms = part.filter("fresh").select("form", "part").join(often, "part", "left_semi").select("form").distinct()
    # the least marked line of each such form, at most one row a task came here
    forms = lines.filter("fresh").join(forms, "form", "left_semi").groupBy("form").agg(F.min(F.struct("doc", "tag", "line", "lead", "parts")).alias("at"))
    forms = written(forms.join(holders.select("form", "docs"), "form", "left").select("form", F.coalesce("docs", F.lit(1)).alias("docs"), "at"), "forms")
    key = F.array(*[F.xxhash64(F.lit(i), F.col("at.lead")[i], F.col("part")) for i in range(depth)])
    keys = forms.select("form", "docs", "at", F.explode("at.parts").alias("part")).select("form", "docs", "part", F.explode(key).alias("key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("forms"), F.sum("docs").alias("docs")).filter((F.col("forms") > 1) & (F.col("docs") >= min_docs)).select("key", "forms")
    taken = keys.join(full, "key").groupBy("form", "part").agg(F.max(F.struct("forms", "key")).alias("leaf"))  # a part has one leaf for each leading token
    taken = taken.groupBy("form").agg(F.slice(F.sort_array(F.collect_list("leaf"), asc=False), 1, TAKEN).alias("leaf")).select("form", F.explode("leaf.key").alias("key")).distinct()
    return taken.join(forms.select("form", "at.doc", "at.tag", "at.line"), "form")


def templates(docs: DataFrame, lines: DataFrame, holders: DataFrame, id_col: str, text_col: str, depth: int, min_docs: int, constant: float) -> DataFrame:
    """``form, template`` for the forms that share the constants of a template; a form may be in several."""
    taken = written(leaves(lines, holders, depth, min_docs), "leaves")
    wanted = taken.select("form", "doc", "tag", "line").distinct().groupBy("doc", "tag").agg(F.collect_list(F.struct("form", "line")).alias("wanted"))
    doc, tag, text = _keys(docs, id_col, text_col)
    texts = docs.filter(text.isNotNull()).select(doc.alias("doc"), tag.alias("tag"), text.alias("text"))
    tokens = texts.join(wanted.hint("merge"), ["doc", "tag"]).select("text", "wanted").mapInArrow(_tokens_of, "form long, hashes array<long>")
    tokens = tokens.groupBy("form").agg(F.first("hashes").alias("hashes"))  # repeated rows bring a form again
    placed = written(taken.select("key", "form").join(tokens, "form").select("key", "form", F.posexplode("hashes").alias("place", "token")), "tokens")
    placed = placed.withColumn("slot", F.xxhash64("key", "place", "token"))  # one number: cheaper to sort than three
    counts = placed.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = placed.join(counts, "slot", "left").withColumn("n", F.coalesce("n", F.lit(1))).groupBy("key", "form").agg(F.sort_array(F.collect_list(F.struct("n", "place", "token")), asc=False).alias("items"))
    enough = F.ceil(F.size("items") * F.lit(constant))
    least = F.greatest(F.lit(2.0), F.element_at("items", enough.cast("int"))["n"] * F.lit(ALIKE))
    same = F.array_sort(F.transform(F.filter("items", lambda x: x["n"] >= F.col("least")), lambda x: F.struct(x["place"], x["token"])))
    rows = rows.withColumn("least", least).select("form", F.size("items").alias("tokens"), same.alias("same"), enough.alias("enough"))
    return rows.filter(F.size("same") >= F.col("enough")).select("form", F.xxhash64("tokens", "same").alias("template")).distinct()


def recurring(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, depth: int, min_docs: int, constant: float, long_tokens: int) -> DataFrame:
    """``form, first, pair``: forms to drop behind the first document that holds them; ``pair`` for long ones of too few documents to be dropped otherwise."""
    held = lines.select("form", "doc", "tokens").distinct()
    holders = held.groupBy("form").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first"), F.first("tokens").alias("tokens")).filter("docs > 1")
    holders = written(holders, "holders")
    named = written(templates(docs, lines, holders, id_col, text_col, depth, min_docs, constant), "templates")
    often = lines.select("form", "doc").join(named, "form").select("template", "doc").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first")).filter(F.col("docs") >= min_docs)
    by_template = named.join(often, "template").select("form", "first", F.lit(False).alias("pair"))
    as_is = holders.filter((F.col("docs") >= min_docs) | (F.col("tokens") >= long_tokens)).select("form", "first", (F.col("docs") < min_docs).alias("pair"))
    both = as_is.unionByName(by_template).groupBy("form").agg(F.min(F.when(~F.col("pair"), F.col("first"))).alias("firm"), F.min("first").alias("first"))
    return both.select("form", F.coalesce("firm", "first").alias("first"), F.col("firm").isNull().alias("pair"))


def recurring_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, min_docs: int, constant: float, long_tokens: int) -> DataFrame:
    """``doc, tag, gone``: of each document the lines to drop, with the earlier document where it is a long line of few documents."""
    doc, tag, text = _keys(docs, id_col, text_col)
    rows = docs.filter(text.isNotNull()).select(doc.alias("doc"), tag.alias("tag"), text.alias("text"))
    lines = written(rows.mapInArrow(_lines(depth, min_tokens), LINES), "lines")
    known = written(recurring(docs, lines, id_col, text_col, depth, min_docs, constant, long_tokens), "recurring")
    gone = lines.select("doc", "tag", "line", "form").join(known, "form").filter(F.col("doc") > F.col("first"))
    return gone.groupBy("doc", "tag").agg(F.collect_set(F.struct("line", F.when(F.col("pair"), F.col("first")).alias("pair"))).alias("gone"))


def dropped_lines(lines: list[str], gone: list[dict] | None, min_tokens: int) -> set[int]:
    """Places of the lines to drop; long lines shared with one earlier document stay where they are more than half of what has tokens enough."""
    if not gone:
        return set()
    shared = Counter(g["pair"] for g in gone if g["pair"] is not None)
    n = sum(len(x.split()) >= min_tokens for x in lines) if shared else 0
    return {g["line"] for g in gone if g["pair"] is None or 2 * shared[g["pair"]] <= n}


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_tokens: int = 3, min_docs: int = 3, constant: float = 0.7, long_tokens: int = 40, counts: tuple[str, str] | None = None
) -> DataFrame:
    """``docs`` with recurring lines taken out of their texts; with two names as ``counts``, also the numbers of lines and of dropped ones."""
    doc_, tag_, gone_ = free_names(docs, "doc", "tag", "gone")
    gone = recurring_lines(docs, id_col, text_col, depth, min_tokens, min_docs, constant, long_tokens)
    gone = gone.select(F.col("doc").alias(doc_), F.col("tag").alias(tag_), F.col("gone").alias(gone_))
    doc, tag, text = _keys(docs, id_col, text_col)
    names = docs.columns
    joined = docs.join(gone.hint("merge"), (doc == F.col(doc_)) & (tag == F.col(tag_)), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in names], gone_)
    at = names.index(text_col)
    added = list(counts or ())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            texts, dropped = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            lines, n_gone, out = [], [], []
            for t, g in zip(texts, dropped):
                parts = t.split("\n") if t is not None else []
                g = dropped_lines(parts, g, min_tokens)
                lines.append(len(parts))
                n_gone.append(len(g))
                out.append("\n".join([x for i, x in enumerate(parts) if i not in g]) if g else t)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(out, pa.string())
            if added:
                cols += [pa.array(lines, pa.int64()), pa.array(n_gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(cut, schema + "".join(f", `{c}` long" for c in added))

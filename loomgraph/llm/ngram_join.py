"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. A scan turns each text into its set of word n-grams (64-bit hashes) and a
   MinHash signature of ``bands`` x ``rows`` values. Documents with the same
   set form a class; only its representative (the least id) goes further, so
   copies never meet each other in a join.
2. The shuffle is on band hashes: each class goes to the least class of each of
   its buckets, one row per band. These star edges link every class with all
   classes it shares a bucket with, whatever the bucket's size.
3. Classes that share buckets, directly or in a chain, form a cluster. Their
   sets are cut into blocks by set size, and pairs of blocks are verified by a
   sparse product: exact intersections of full sets, in bounded memory. Block
   pairs whose sizes alone rule out the threshold are left out.
4. Verified links are counted per class; of the links themselves each block
   pair keeps a spanning forest, from which groups are formed. All pairs within
   a group are compared where they may link, but never written out.

The chance that a pair of exactly the threshold shares no band is
(1 - 0.8^rows)^bands: 3e-5 for 20 bands of 4 rows; and a pair that shares none
is still verified where a chain of buckets joins the two.

Defined results: n-grams are of lower-cased words between white space; a text of
fewer words than ``n`` has one n-gram of all its words; null, empty and blank
texts have none, link with nothing (not even each other) and stay alone;
null ids stay alone, too; rows that repeat an
id are copies of it, and other texts under the same id form a class of their own
that bears that id; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import free_names
from loomgraph.llm.components import connected_components
from loomgraph.session import written

BLOCK = 1024  # classes in a block, at most
SETS = "doc_id long, digest binary, size int, bands array<long>"
BLOCK_GRAMS = 1 << 20  # n-grams in a block
FOUND = "a long, b long, links long"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of n-gram hashes, with a cache of word hashes."""

    def __init__(self, n: int, bands: int, rows: int):
        self.n, self.bands, self.rows = n, bands, rows
        seeds = _mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * _MIX)
        self.mul, self.add = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows :]
        self.words: dict[str, int] = {}

    def grams(self, text: str | None) -> np.ndarray:
        found = text.lower().split() if text else []
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.words) > 1_000_000:
            self.words.clear()
        words, ids = self.words, []
        for w in found:
            h = words.get(w)
            if h is None:
                h = words[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            ids.append(h)
        h = np.array(ids, np.uint64)
        width = min(self.n, len(h))
        out = np.full(len(h) - width + 1, np.uint64(width))
        for i in range(width):
            out = _mixed(out * _MIX + h[i : len(h) - width + 1 + i])
        return np.unique(out)

    def band_hashes(self, grams: np.ndarray) -> list[int]:
        low = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(grams), 4096):
            part = grams[lo : lo + 4096, None] * self.mul[None, :] + self.add[None, :]
            low = np.minimum(low, (part ^ (part >> np.uint64(32))).min(0))
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            out = _mixed(out * _MIX + low[r :: self.rows])
        return out.view(np.int64).tolist()


def gram_sets(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, a digest of the set, its size and band hashes; the set itself isn't kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(n, bands, rows)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [s.grams(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None for g in sets], pa.binary()), pa.array(map(len, sets), pa.int32()),
                        pa.array([s.band_hashes(g) if len(g) else None for g in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "digest", "size", "bands"],
                )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SETS)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by a product over the hashes that both sides hold."""
    sizes_l, sizes_r = [len(x) for x in left], [len(x) for x in right]
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(flat_l, flat_r)
    out = np.zeros((len(left), len(right)), np.float32)
    row_l, row_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    keep_l, keep_r = np.isin(flat_l, shared), np.isin(flat_r, shared)
    at_l, at_r = np.searchsorted(shared, flat_l[keep_l]), np.searchsorted(shared, flat_r[keep_r])
    row_l, row_r = row_l[keep_l], row_r[keep_r]
    step = 4096
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    at_l, row_l, at_r, row_r = at_l[order_l], row_l[order_l], at_r[order_r], row_r[order_r]
    for lo in range(0, len(shared), step):
        parts = []
        for at, row, n in ((at_l, row_l, len(left)), (at_r, row_r, len(right))):
            i, j = np.searchsorted(at, [lo, lo + step])
            m = np.zeros((n, min(step, len(shared) - lo)), np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def forest(linked: np.ndarray, ids_l: np.ndarray, ids_r: np.ndarray) -> list[tuple[int, int]]:
    """Star edges of the components of the links, so that a large group yields no more edges than members."""
    seen_l, seen_r, out = np.zeros(len(ids_l), bool), np.zeros(len(ids_r), bool), []
    for i in np.flatnonzero(linked.any(1)):
        if seen_l[i]:
            continue
        seen_l[i] = True
        found, new_r = [], linked[i] & ~seen_r
        while new_r.any():
            seen_r |= new_r
            new_l = linked[:, new_r].any(1) & ~seen_l
            seen_l |= new_l
            found += [ids_r[new_r], ids_l[new_l]]
            new_r = linked[new_l].any(0) & ~seen_r
        out += [(int(ids_l[i]), int(x)) for part in found for x in part if x != ids_l[i]]
    return out


def verify(ids_l: np.ndarray, sets_l: list, copies_l: np.ndarray, ids_r: np.ndarray, sets_r: list, copies_r: np.ndarray, threshold: float, same: bool) -> list[tuple]:
    """Rows ``(a, b, None)`` of a spanning forest and ``(a, None, links)`` of link counts, in documents."""
    inter = overlaps(sets_l, sets_r).astype(np.float64)
    total = np.array([len(x) for x in sets_l])[:, None] + np.array([len(x) for x in sets_r])[None, :] - inter
    linked = inter >= threshold * total - 1e-9
    if same:
        np.fill_diagonal(linked, False)
    out: list[tuple] = [(a, b, None) for a, b in forest(linked, ids_l, ids_r)]
    out += [(int(i), None, int(n)) for i, n in zip(ids_l, linked @ copies_r) if n]
    if not same:
        out += [(int(i), None, int(n)) for i, n in zip(ids_r, linked.T @ copies_l) if n]
    return out


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, class_id, group_id, n_links``.

    ``class_id`` is the least id with the same n-gram set, ``group_id`` the
    least id of those joined by links, and ``n_links`` the number of other
    documents of similarity ``threshold`` or more.
    """
    sets = gram_sets(docs, id_col, text_col, n, bands, rows)
    sets = written(sets, "grams")
    known = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    classes = sets.filter(known).groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    # star edges on band hashes: the least class of a bucket stands for it
    in_band = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    least = in_band.groupBy("band", "hash").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = in_band.join(least.select("band", "hash", "a"), ["band", "hash"]).select("a", F.col("key").alias("b")).filter("a <> b").distinct()
    clusters = written(connected_components(stars).withColumnRenamed("node", "key").withColumnRenamed("root", "cluster"), "clusters")

    # blocks by set size within a cluster; one block for all but the largest
    members = classes.select("key", "digest", "class_id", "copies", "size").join(clusters, "key")
    members = written(_numbered(members, block), "members")
    spans = members.groupBy("cluster", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    l, r = spans.alias("l"), spans.alias("r")
    pairs = l.join(r, (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.block") <= F.col("r.block")) & (F.col("l.high") >= threshold * F.col("r.low")))
    pairs = pairs.select(F.col("l.cluster").alias("cluster"), F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    sides = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # n-gram sets of members alone, made again from the representatives' texts
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("class_id"), F.col(f"`{text_col}`").alias("text"))
    # merged, not broadcast: members grow with the corpus, so the plan is the same at every size
    own = texts.join(members.select("class_id", "key", "digest", "cluster", "block", "copies").hint("merge"), "class_id")
    rows_ = _with_grams(own, n).join(sides, ["cluster", "block"])

    def check(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        _, once = np.unique(t["key"].to_numpy(), return_index=True)  # repeated rows are alike
        t = t.take(once)
        blocks, ids, copies = t["block"].to_numpy(), t["key"].to_numpy(), t["copies"].to_numpy()
        sets_ = [np.frombuffer(g, np.uint64) for g in t["grams"].to_pylist()]
        at = [np.flatnonzero(blocks == x) for x in (i, j)]
        part = [(ids[a], [sets_[x] for x in a], copies[a]) for a in at]
        found = verify(*part[0], *part[1], threshold, i == j) if all(len(a) for a in at) else []
        cols = list(zip(*found)) if found else [[], [], []]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("a", "b", "links"), cols)})

    found = written(rows_.groupBy("cluster", "i", "j").applyInArrow(check, FOUND), "links")
    links = found.filter("links is not null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    with_root = classes.select("key", "digest", "class_id", "copies").join(roots, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = with_root.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = with_root.join(least_id, "root").select("digest", "class_id", "group_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = sets.filter(~known).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return sets.filter(known).select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "group_id", "n_links").unionByName(alone)


def _with_grams(own: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(n, 1, 1)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [s.grams(t) for t in part.column(1).to_pylist()]
                mine = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() == d for g, d in zip(sets, part.column(2).to_pylist())]
                cols = [part.column(0), *part.columns[3:], pa.array([g.tobytes() for g in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "cluster", "block", "copies", "grams"]).filter(pa.array(mine))

    return own.select("key", "text", "digest", "cluster", "block", "copies").mapInArrow(run, "key long, cluster long, block long, copies long, grams binary")


def _numbered(members: DataFrame, block: int) -> DataFrame:
    """``block`` within the cluster, by set size: exact totals per (cluster, size) give each size its first place, and places inside a size come from the key's hash."""
    sizes = members.groupBy("cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster").orderBy("size")
    weight = F.greatest(F.lit(1.0 / block), F.col("size") / BLOCK_GRAMS)  # a member's share of a block
    sizes = sizes.withColumn("before", F.sum(F.col("n") * weight).over(w) - F.col("n") * weight)
    place = F.col("before") + F.pmod(F.xxhash64("key", F.lit(7)), F.col("n")) * weight
    return members.join(sizes, ["cluster", "size"]).withColumn("block", F.floor(place)).drop("n", "before")


def keep_one_row_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without near duplicates: one row of each group stays, and all rows that are in none.

    Groups are of rows, each for itself: repeated rows, other texts of an id and
    null ids, too. The least id of a group stays, null ids come last, and texts
    under one id are taken in the order of their hash. Null, empty and blank
    texts are in no group and stay. Columns may have any names.
    """
    row, group, key = free_names(docs, "row", "group", "key")
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # numbered once, as a second scan may be split otherwise
    groups = ngram_jaccard_join(rows, row, text_col, **how).select(F.col("doc_id").alias(row), F.col("group_id").alias(group))
    keys = rows.select(row, F.struct(id_.isNull().alias("last"), id_.alias("id"), F.xxhash64(text).alias("tag"), F.col(row).alias("row")).alias(key))
    first = groups.join(keys.hint("merge"), row).groupBy(group).agg(F.min(key).alias(key)).select(F.col(f"{key}.row").alias(row))
    return rows.join(first.hint("merge"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

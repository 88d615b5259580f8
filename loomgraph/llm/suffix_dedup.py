"""Suffix-array dedup: bytes covered by a string of ``width`` bytes that starts earlier are removed.

Two equal strings of ``width`` bytes hold the same least k-gram (by hash) at the
same place: their anchor. So strings are compared only under a common anchor.

1. A scan cuts each text into anchors with the range of starts they stand for.
   Regions that repeat within a task are resolved there: all but the first are
   certain repeats, and only the first is shuffled.
2. Rows are shuffled by anchor and sorted; a streaming pass marks equal regions
   and passes on the firsts of anchors that have several different regions,
   holding one row at a time, however many an anchor has.
3. These regions are fetched and gathered in blocks. For each block a collection
   Burrows-Wheeler transform and the common prefixes of neighbours are built
   column-wise: every round inserts one symbol of every region, from the last to
   the first. Neighbours with a common prefix of ``width`` are the same string.
   Anchors too frequent for a block are dealt over several; the first of each
   string per block then meets the others by a digest.
4. Covered ranges come back to their documents, whose texts are cut.

The transform and prefixes of a block are arrays read and rewritten in sequence
once a round, in memory, as a block's size is fixed.

Defined results: a null text counts as empty; rows that repeat an id and text
count as one document and get the same result; texts that share an id are taken
in the order of a hash of their bytes; null ids come last, in that order; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import written

WIDTH, GRAM = 100, 44  # widths up to 254; a short gram anchors many strings that only share a few words
FLUSH = 400_000  # anchors that a task resolves among themselves
BLOCK = 2048  # regions in a block
STEPS = (5, 4, 2, 1)  # bytes that a symbol of the transform may have, the first that divides the width
SHORT = 1 << 16  # powers that a worker keeps, for texts of up to so many bytes
RUN = 32  # values that are looked up by their least one
TASK_BLOCKS = 8  # blocks in a task
LAST = (1 << 63) - 1
ANCHORS = "anchor long, region long, check long, doc long, tag long, at long, sure boolean"
RANGES = "anchor long, doc long, tag long, at long, several boolean"
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BASE = np.uint64(_BASES[0])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` bytes, by doubling: O(n log k)."""
    h = _mix(raw.astype(np.uint64) + np.uint64(1))
    out, done, size = None, 0, 1
    while True:
        if k & size:
            out = h[: len(raw) - size + 1].copy() if out is None else out[: len(raw) - done - size + 1] * _power(size) + h[done : done + len(raw) - done - size + 1]
            done += size
        if done == k:
            return _mix(out)
        h = h[:-size] * _power(size) + h[size:]
        size *= 2


def leftmost_min(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value of each window of ``w``, the leftmost among equals, by doubling."""
    place, size = np.arange(len(x), dtype=np.int32), 1

    def better(x: np.ndarray, place: np.ndarray, n: int, by: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places ``i`` and ``i + by``, ``n`` in all, the better one and its value."""
        a, b = x[:n], x[by : by + n]
        return np.minimum(a, b), np.where(b < a, place[by : by + n], place[:n])

    n = len(x) - w + 1
    while size * 2 <= w:
        x, place = better(x, place, len(x) - size, size)
        size *= 2
    return better(x, place, n, w - size)[1]


_BYTES = [_mix(np.arange(256, dtype=np.uint64) + np.uint64(first)) for first in (77, 5077)]  # two independent values of each byte


def prefix_hash(raw: np.ndarray, powers: np.ndarray, which: int) -> np.ndarray:
    """Hashes of all prefixes, so that any region's hash is one difference."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[which][raw] * powers[:-1], out=sums[1:])
    return sums


@lru_cache
def _first_powers(base: int) -> np.ndarray:
    return _powers_upto(base, SHORT)


def _powers_upto(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, out=out)


def _powers(base: int, n: int) -> np.ndarray:
    return _first_powers(base)[: n + 1] if n <= SHORT else _powers_upto(base, n)


def anchors(raw: np.ndarray, width: int = WIDTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of a text of at least ``width`` bytes: anchor hashes, two region hashes (128 bits together), first starts and last starts."""
    h = gram_hashes(raw, k)
    where = leftmost_min(h, width - k + 1)  # of each start
    n = len(where)
    cut = np.flatnonzero(np.diff(where)) + 1
    begin = np.concatenate([[0], cut])
    end = np.concatenate([cut - 1, [n - 1]])
    place = where[begin]
    shape = _mix(((place - begin).astype(np.uint64) << np.uint64(32)) + (end - begin).astype(np.uint64))
    regions = []
    for which, base in enumerate(_BASES):
        sums, inverse = prefix_hash(raw, _powers(base, len(raw)), which), _powers(pow(base, -1, 1 << 64), len(raw))
        regions.append(_mix((sums[end + width] - sums[begin]) * inverse[begin] ^ shape))
    return h[place], *regions, begin, end


def pack_at(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Start and number of further starts in one long."""
    return (begin.astype(np.int64) << 8) | (end - begin)


def _resolve(rows: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows in order of (anchor, region, doc, tag, at), each once, and whether an equal region comes before; such repeats need their hashes no more."""
    a, r, c, d, t, p = (np.concatenate([x[i] for x in rows]) for i in range(6))
    order = np.lexsort((p, t, d, c, r, a))
    a, r, c, d, t, p = (x[order] for x in (a, r, c, d, t, p))
    once = np.ones(len(a), bool)  # a repeated row brings the same regions again
    once[1:] = np.any([x[1:] != x[:-1] for x in (a, r, c, d, t, p)], axis=0)
    a, r, c, d, t, p = (x[once] for x in (a, r, c, d, t, p))
    sure = np.zeros(len(a), bool)
    sure[1:] = (a[1:] == a[:-1]) & (r[1:] == r[:-1]) & (c[1:] == c[:-1])
    for x in (a, r, c):
        x[sure] = 0
    return [a, r, c, d, t, p], sure


def scan(texts: DataFrame, width: int = WIDTH, k: int = GRAM) -> DataFrame:
    """Anchors of ``doc, tag, text``; rows that are ``sure`` repeat a region of their own task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            found, sure = _resolve(rows)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found] + [pa.array(sure)], names=[x.split()[0] for x in ANCHORS.split(", ")])

        for b in batches:
            docs, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, text in enumerate(b.column(2)):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                if len(raw) < width:
                    continue
                a, r, c, begin, end = anchors(raw, width, k)
                rows.append((a, r, c, np.full(len(a), docs[i]), np.full(len(a), tags[i]), pack_at(begin, end)))
                held += len(a)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    return texts.select("doc", "tag", "text").mapInArrow(run, ANCHORS)


def sift(found: DataFrame) -> DataFrame:
    """One pass over each partition, sorted by anchor and region: covered ranges, and firsts of anchors with several regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the last row
        waiting: list | None = None  # the last first, until the next one tells whether its anchor has several

        def out(a, d, t, p, several) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, d, t, p)] + [pa.array(np.full(len(a), several))], names=[x.split()[0] for x in RANGES.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            sure = b.column(6).to_numpy(zero_copy_only=False)
            own = [b.column(i).to_numpy() for i in range(6)]
            if sure.any():
                yield out(*(own[i][sure] for i in (0, 3, 4, 5)), False)
            a, r, c, d, t, p = (x[~sure] for x in own)
            if not len(a):
                continue
            like = [x == np.concatenate([[y], x[:-1]]) for x, y in zip((a, r, c, d, t, p), before or (0,) * 6)]
            same = like[0] & like[1] & like[2]
            if before is None:
                same[0] = False
            again = same & like[3] & like[4] & like[5]  # the same place, of a repeated row: not an earlier one
            before = (a[-1], r[-1], c[-1], d[-1], t[-1], p[-1])
            cover = same & ~again
            if cover.any():
                yield out(a[cover], d[cover], t[cover], p[cover], False)
            f = ~cover & ~again
            if not f.any():
                continue
            a, d, t, p = ([np.asarray(w)] + [x[f]] if waiting is not None else [x[f]] for w, x in zip(waiting[0] if waiting is not None else [None] * 4, (a, d, t, p)))
            a, d, t, p = (np.concatenate(x) for x in (a, d, t, p))
            linked = np.zeros(len(a) + 1, bool)  # equal to the one before
            linked[1:-1] = a[1:] == a[:-1]
            several = linked[:-1] | linked[1:]
            if waiting is not None:
                several[0] |= waiting[1]
            keep = several.copy()
            keep[-1] = False
            if keep.any():
                yield out(a[keep], d[keep], t[keep], p[keep], True)
            waiting = ([x[-1:].copy() for x in (a, d, t, p)], bool(several[-1]))
        if waiting is not None and waiting[1]:
            yield out(*waiting[0], True)

    n = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # certain repeats need not meet their first, so they are dealt by document: a frequent region brings its anchor a row per task
    key = F.when(F.col("sure"), F.xxhash64("doc", "tag", "at")).otherwise(F.col("anchor"))
    return found.repartition(int(n), key).sortWithinPartitions("anchor", "region", "check", "doc", "tag", "at").mapInArrow(run, RANGES)


def symbols_of(regions: list[np.ndarray], step: int) -> tuple[list[np.ndarray], int, np.ndarray]:
    """Codes from 1 of the ``step``-byte symbols of each region from each of its first ``step`` places, in the order of their bytes; their number; sizes."""
    flat = np.concatenate(regions)
    key = np.zeros(len(flat) - step + 1, np.uint64)
    for i in range(step):
        key = (key << np.uint64(8)) | flat[i : len(key) + i]
    n = np.array([len(r) for r in regions])
    first = np.cumsum(n) - n
    inside = np.ones(len(key), bool)  # symbols over the end of a region are none
    for i in range(1, step):
        ends = first + n - i
        inside[ends[(ends >= first) & (ends < len(key))]] = False
    symbols, code = np.unique(key[inside], return_inverse=True)
    all_codes = np.zeros(len(key), np.int64)
    all_codes[inside] = code + 1
    strings = [all_codes[f + p : max(f + p, f + k - step + 1) : step] for f, k in zip(first, n) for p in range(step)]
    return strings, len(symbols), np.array([len(x) for x in strings])


def column_wise(regions: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of at least ``width`` bytes in sorted order: region, offset, and whether the prefix of ``width`` equals the one before.

    A symbol is a run of ``step`` bytes, and a region's ``step`` ways to be cut
    into them are strings of their own: a round reads and rewrites all that was
    inserted before, so longer symbols save rounds. Round j inserts the j-th last
    symbol of every string that has one. A row of
    the transform is the symbol before its suffix, 0 where there is none; as
    suffixes that start with a symbol stand in the order of what follows, a new
    suffix's place is the number of smaller symbols plus the number of equal
    ones before it in the transform. Its common prefix with the one above is one
    more than the least common prefix between the two rows they come from.
    """
    step = next(q for q in STEPS if width % q == 0)
    codes, n_symbols, sizes = symbols_of(regions, step)
    m, width = len(codes), width // step
    rounds = int(sizes.max())
    kind = np.uint8 if n_symbols < 255 else np.uint16 if n_symbols < 65535 else np.int32
    grid = np.zeros((rounds + 1, m), kind)  # row j: the j-th last symbol of each string, 0 beyond its first
    for i, r in enumerate(codes):
        grid[: len(r), i] = r[::-1]
    # the empty suffixes, one per region, stand first; ends are alike, and no prefix of `width` holds one
    bwt, lcp, name = grid[0].copy(), np.zeros(m, np.uint8), np.arange(m, dtype=np.int32)  # name: m * length + region
    current = np.arange(m)  # the row of each region's longest suffix so far
    for j in range(rounds):
        live = np.flatnonzero(sizes > j)
        rows, symbol = current[live], grid[j, live]
        order = np.argsort(rows + (symbol.astype(np.int64) << 32))
        live, rows, symbol = live[order], rows[order], symbol[order].astype(np.int64)
        # one pass over the transform: its rows by symbol, and from them the rank of each new row among its symbol's
        by_symbol = np.argsort(bwt, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=n_symbols + 2))])
        at = np.empty(len(bwt), np.int32)
        at[by_symbol] = np.arange(len(bwt), dtype=np.int32)
        at = at[rows].astype(np.int64)
        place = at - starts[1] + m
        above, below = at > starts[symbol], at + 1 < starts[symbol + 1]
        value, under = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.uint8)
        if above.any():
            value[above] = np.minimum(range_min(lcp, by_symbol[at[above] - 1] + 1, rows[above]) + 1, width)
        # merge in one pass: places are final ones, so old rows fill the gaps in order
        total = len(bwt) + len(rows)
        is_old = np.ones(total, bool)
        is_old[place] = False
        nxt = np.minimum(place + 1, total - 1)
        fix = is_old[nxt] & (place + 1 < total)  # the row below was there before: its common prefix with the new row
        both = fix & below
        if both.any():
            under[both] = np.minimum(range_min(lcp, rows[both] + 1, by_symbol[at[both] + 1]) + 1, width)
        merged = []
        for x, new in ((bwt, grid[j + 1, live]), (lcp, value), (name, live + m * (j + 1))):
            y = np.empty(total, x.dtype)
            y[is_old] = x
            y[place] = new
            merged.append(y)
        bwt, lcp, name = merged
        lcp[nxt[fix]] = under[fix]
        current[live] = place
    length, owner = np.divmod(name, m)
    keep = length >= width
    # between kept rows no shorter one can part equal prefixes: it would sort before both
    owner, at = owner[keep], (sizes[owner[keep]] - length[keep]) * step
    return owner // step, at + owner % step, lcp[keep] >= width


def range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``x[lo..hi]`` for each pair: runs of ``RUN`` that lie within a range are read as their least values, by the same means, the rest in sequence."""
    first, last = (lo + RUN - 1) // RUN, (hi + 1) // RUN  # runs within: first to last - 1
    far = np.flatnonzero(last > first)
    if not len(far):
        return _in_sequence(x, lo, hi)
    ends = np.where(last > first, first * RUN, hi)
    out = _in_sequence(x, lo, ends)
    lo, hi, first, last = (v[far] for v in (lo, hi, first, last))
    inner = range_min(np.minimum.reduceat(x, np.arange(0, len(x), RUN)), first, last - 1)
    out[far] = np.minimum(np.minimum(out[far], inner), _in_sequence(x, last * RUN - 1, hi))
    return out  # as small as `width`, so one more fits the type


def _in_sequence(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sizes = hi - lo + 1
    ends = np.cumsum(sizes)
    flat = np.repeat(lo - (ends - sizes), sizes) + np.arange(ends[-1])
    return np.minimum.reduceat(x[flat], ends - sizes)


def covered_starts(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, regions: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every start in the regions: doc, tag, start, whether the same string starts earlier among them, and its region and offset."""
    owner, offset, same = column_wise(regions, width)
    group = np.cumsum(~same)
    d, t, s = doc[owner], tag[owner], start[owner] + offset
    order = np.lexsort((s, t, d, group))
    later = np.zeros(len(order), bool)
    g = group[order]
    later[1:] = g[1:] == g[:-1]
    return d[order], t[order], s[order], later, np.stack([owner[order], offset[order]])


def _fetched(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``anchor, doc, tag, start, region`` for the wanted ranges, from the texts of their documents."""
    by_doc = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "at")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, 128) for x in batches for lo in range(0, x.num_rows, 128)):
            cols: list[list] = [[] for _ in range(5)]
            for doc, tag, text, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                raw = text.as_buffer().to_pybytes()
                flat = ranges.values.flatten()
                for a, at in zip(flat[0].to_pylist(), flat[1].to_pylist()):
                    lo, hi = at >> 8, (at >> 8) + (at & 255)
                    for c, v in zip(cols, (a, doc, tag, lo, raw[lo : hi + width])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.binary(),))], names=["anchor", "doc", "tag", "start", "region"])

    # merged, not broadcast: what is wanted grows with the corpus; repeated rows are fetched once
    return texts.dropDuplicates(["doc", "tag"]).join(by_doc.hint("merge"), ["doc", "tag"]).select("doc", "tag", "text", "wanted").mapInArrow(run, "anchor long, doc long, tag long, start long, region binary")


def compared(regions: DataFrame, counts: DataFrame, n: int, width: int, block: int) -> DataFrame:
    """``doc, tag, at`` of starts whose string starts earlier, over all regions of an anchor."""
    blocks = max(1, -(-n // (block // 2)))
    heavy = counts.filter(F.col("n") > block // 2).select("anchor", F.ceil(F.col("n") / (block // 2)).alias("parts"))
    dealt = regions.join(heavy, "anchor", "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc", "tag", "start"), F.col("parts"))).otherwise(F.lit(0)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("anchor", "salt"), F.lit(blocks))).withColumn("split", F.col("parts").isNotNull())

    def run(t: pa.Table) -> pa.Table:
        found = [x.as_py() for x in t["region"]]
        d, g, s = (t[c].to_numpy() for c in ("doc", "tag", "start"))
        split = t["split"].to_numpy(zero_copy_only=False)
        doc, tag, start, later, where = covered_starts(d, g, s, [np.frombuffer(x, np.uint8) for x in found], width)
        firsts = np.flatnonzero(~later & split[where[0]])
        keep = np.concatenate([np.flatnonzero(later), firsts])
        digest = [None] * int(later.sum()) + [hashlib.blake2b(found[r][o : o + width], digest_size=16).digest() for r, o in where[:, firsts].T]
        return pa.table({"doc": doc[keep], "tag": tag[keep], "start": start[keep], "digest": pa.array(digest, pa.binary())})

    # a block takes about the same time whatever its bytes, so tasks are counted in blocks and not by size
    tasks = max(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // TASK_BLOCKS)
    starts = dealt.repartition(tasks, "block").groupBy("block").applyInArrow(run, "doc long, tag long, start long, digest binary")
    starts = written(starts, "starts")
    w = Window.partitionBy("digest").orderBy("doc", "tag", "start")
    merged = starts.filter("digest is not null").withColumn("nth", F.row_number().over(w)).filter("nth > 1")
    return starts.filter("digest is null").select("doc", "tag", "start").unionByName(merged.select("doc", "tag", "start")).select("doc", "tag", F.shiftleft("start", 8).alias("at"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = GRAM, block: int = BLOCK, texts_out: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; with ``texts_out``, also the remaining bytes as ``kept``."""
    raw = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "utf-8")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), raw.alias("text"))
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    long = F.length("text") >= width
    texts = keyed.filter(long).select("doc", "tag", "text")

    found = written(sift(scan(texts, width, k)), "ranges")
    wanted = found.filter("several")
    counts = wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    n = wanted.count()
    starts = compared(_fetched(wanted, texts, width), counts, n, width, block)
    ranges = found.filter(~F.col("several")).select("doc", "tag", "at").unionByName(starts)
    by_doc = written(ranges.groupBy("doc", "tag").agg(F.collect_set("at").alias("covered")), "covered")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            size, removed, spans, sha, kept = [], [], [], [], []
            for text, covered in zip(b.column(1), b.column(2)):
                raw_ = np.frombuffer(text.as_buffer(), np.uint8)
                gone = np.zeros(len(raw_) + 1, np.int32)
                if covered.is_valid:
                    at = covered.values.to_numpy()
                    lo = at >> 8
                    gone = np.bincount(lo, minlength=len(raw_) + 1).astype(np.int32)
                    gone -= np.bincount(lo + (at & 255) + width, minlength=len(raw_) + 1).astype(np.int32)
                mask = np.cumsum(gone)[:-1] > 0
                left = raw_[~mask].tobytes()
                size.append(len(raw_))
                removed.append(int(mask.sum()))
                spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if texts_out else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if texts_out else []))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts_out else "")
    return keyed.join(by_doc.hint("merge"), ["doc", "tag"], "left").select("doc_id", "text", "covered").mapInArrow(cut, schema)

"""Hard negatives by an inverted-list search that is exact.

K-means centroids are fitted on a bounded sample (at most ``SAMPLE_ROWS``
vectors and ``SAMPLE_VALUES`` components, by least hash of the id); every row
goes to the list of its nearest centroid, and each list stores its radius, the
largest distance of a row from the centroid. By Cauchy and Schwarz no row of a
list scores outside ``a.c - |a| r`` to ``a.c + |a| r`` with an anchor ``a``.
An anchor visits lists in falling order of the upper bound; it skips lists whose
range misses its window of scores, and is done with a window once the bound is
strictly below its k-th score, as equal scores may still win by a smaller id.
Visits are made in three waves, each a Spark job over (list, block, bundle of
anchors); the k-th scores of a wave prune the next one. The sample steers only
which lists are visited first: results don't depend on it.

Lists are cut into blocks of about ``BLOCK_ROWS`` rows by hash of the id, so a
list that holds a third of all rows is many tasks; anchors travel in chunks of
``CHUNK`` and meet a block in bundles. Only each block's best rows leave it.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part; shorter vectors count as padded by zeros; an
anchor id that repeats is asked once, with its least label and vector; rows
with the anchor's id are its own; another id that repeats takes part with all
its rows and counts once, by its best; equal scores go to the smaller id; an
anchor without other rows of its label gives no rows, nor does a negative
positive score, whose window is empty; an empty table gives an empty result;
other columns are ignored, whatever their names. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import written

SAMPLE_ROWS, SAMPLE_VALUES, MOST_LISTS, ROUNDS = 16_384, 4_000_000, 1024, 8
BLOCK_ROWS, CHUNK, BUNDLE = 4096, 256, 16_384
ASSIGNED = "vec_id long, label long, v binary, list int, distance double"
LISTS = "list int, block long, ids binary, labels binary, vectors binary"
ROUTES = "bundle long, list int, ids binary, labels binary, vectors binary, windows binary"
FOUND = "anchor_id long, key long, vec_id long, score long"
NONE = -(1 << 62)  # below every score


def quantised(column: pa.Array | pa.ChunkedArray, scale: int, dims: int) -> np.ndarray:
    """Components as floor(scale * x), a row for each vector, padded to ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths())
    out = np.zeros((len(size), dims), np.int64)
    flat = np.floor(np.asarray(column.flatten()).astype(np.float64) * scale)
    out[np.arange(dims)[None, :] < size[:, None]] = flat.astype(np.int64)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every sum stays an integer that it holds."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def fit(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds from the first distinct vectors of the sample."""
    x = sample.astype(np.float64)
    c = np.unique(x[: 4 * k], axis=0) if len(x) else np.zeros((1, sample.shape[1]))
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)]
    for _ in range(rounds if len(x) else 0):
        of = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Lists:
    """The inverted lists of a table: ``table`` of blocks, centroids, radii, and the kind of integer that holds a component."""

    def __init__(self, rows: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", lists: int | None = None):
        self.scale, self.spark = scale, rows.sparkSession
        good = self._good(rows, id_col, label_col, vector_col)
        n, self.dims, most = good.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("x", lambda x: F.abs(x.cast("double"))))), F.lit(0.0))).first()
        self.dims = max(1, self.dims)
        self.kind = next((k for k, b in (("<i2", 15), ("<i4", 31)) if most * scale + 1 < 2.0**b), "<i8")
        sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // self.dims))).select("x").toArrow()
        self.centroids = fit(quantised(sample["x"], scale, self.dims), lists or max(1, min(MOST_LISTS, int(np.sqrt(n)))))
        assigned = written(good.mapInArrow(self._assign(), ASSIGNED), "assigned")
        known = {r["list"]: r for r in assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r")).collect()}  # at most MOST_LISTS rows
        self.radii = np.array([known[i]["r"] if i in known else -1.0 for i in range(len(self.centroids))])
        self.blocks = np.array([-(-known[i]["n"] // BLOCK_ROWS) if i in known else 0 for i in range(len(self.centroids))], np.int64)
        sizes = self.spark.createDataFrame([(i, int(b)) for i, b in enumerate(self.blocks) if b], "list int, blocks long")
        self.table = written(assigned.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).groupBy("list", "block").applyInArrow(self._build(), LISTS), "lists")

    @staticmethod
    def _good(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
        i, label, v = (F.col(f"`{c}`") for c in (id_col, label_col, vector_col))
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return rows.filter(i.isNotNull() & label.isNotNull() & v.isNotNull() & fine).select(i.cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("x"))

    def _assign(self):
        scale, dims, kind, c = self.scale, self.dims, self.kind, self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = quantised(b.column("x"), scale, dims)
                x = q.astype(np.float64)
                of = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
                far = np.sqrt(((x - c[of]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in q.astype(kind)], pa.binary()), pa.array(of, pa.int32()), pa.array(far)], names=["vec_id", "label", "v", "list", "distance"])

        return run

    def _build(self):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("vec_id")
            cols = [t["vec_id"].to_numpy().astype("<i8").tobytes(), t["label"].to_numpy().astype("<i8").tobytes(), b"".join(t["v"].to_pylist())]
            return pa.table({"list": t["list"][:1], "block": t["block"][:1], **{n: pa.array([c], pa.binary()) for n, c in zip(("ids", "labels", "vectors"), cols)}})

        return run

    def anchors(self, rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
        """``anchor_id, label, x``, an id once."""
        good = self._good(rows, id_col, label_col, vector_col)
        return good.groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "x")).alias("m")).select("anchor_id", "m.label", "m.x")

    def search(self, requests: DataFrame, k: int, same_label: bool) -> DataFrame:
        """``anchor_id, key, vec_id, score, rank``: for each window the ``k`` best rows of the anchor's label, or of others, whose score lies in it.

        ``requests(anchor_id, label, x, windows array<struct<key, lo, hi>>)``.
        """
        total = len(self.centroids)
        chunks = max(1, -(-requests.count() // CHUNK))
        asked = requests.withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)))
        best, start = None, 0
        for stop in dict.fromkeys(min(total, max(4, p)) for p in (total // 16, total // 4, total)):
            if best is None:
                with_kth = asked.withColumn("windows", F.transform("windows", lambda w: F.struct(w["key"].alias("key"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.lit(NONE).alias("kth"))))
            else:
                kth = best.groupBy("anchor_id", "key").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth")).filter("kth is not null")
                kth = kth.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "kth"))).alias("known"))  # a window of an anchor each
                told = lambda w: F.struct(w["key"].alias("key"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.coalesce(F.element_at("known", w["key"]), F.lit(NONE)).alias("kth"))
                with_kth = asked.join(kth, "anchor_id", "left").withColumn("windows", F.transform("windows", told)).drop("known")
            routes = written(with_kth.groupBy("chunk").applyInArrow(self._route(start, stop, -(-chunks * CHUNK // BUNDLE)), ROUTES), "routes")
            found = written(self._visited(routes, k, same_label), "visited")
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            w = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
            once = found.groupBy("anchor_id", "key", "vec_id").agg(F.max("score").alias("score"))
            best = written(once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "best")
            start = stop
        return best

    def _route(self, start: int, stop: int, bundles: int):
        """The lists at places ``start`` to ``stop`` of each anchor's order that a window still needs."""
        scale, dims, kind, c, r = self.scale, self.dims, self.kind, self.centroids, self.radii

        def run(t: pa.Table) -> pa.Table:
            q = quantised(t["x"], scale, dims)
            a = q.astype(np.float64)
            size = np.linalg.norm(a, axis=1)[:, None]
            slack = 1e-9 * size * (np.linalg.norm(c, axis=1) + np.maximum(r, 0))[None, :] + 1e-6
            mid, reach = a @ c.T, size * np.maximum(r, 0)[None, :]
            upper, lower = mid + reach + slack, mid - reach - slack
            place = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1)
            windows = t["windows"].to_pylist()
            w = np.full((len(q), max(map(len, windows)), 4), [0, 1, 0, NONE], np.int64)  # lo over hi: no window
            for i, found in enumerate(windows):
                for j, x in enumerate(found):
                    w[i, j] = x["key"], x["lo"], x["hi"], x["kth"]
            key, lo, hi, kth = (w[:, :, None, j] for j in range(4))
            need = ((upper[:, None, :] >= np.maximum(lo, kth)) & (lower[:, None, :] <= hi) & (lo <= hi)).any(1)
            need &= (r >= 0)[None, :] & (place >= start) & (place < stop)
            ids, labels, bundle = t["anchor_id"].to_numpy(), t["label"].to_numpy(), t["chunk"][0].as_py() % bundles
            out = []
            for at in np.flatnonzero(need.any(0)):
                m = np.flatnonzero(need[:, at])
                out.append((bundle, int(at), ids[m].astype("<i8").tobytes(), labels[m].astype("<i8").tobytes(), q[m].astype(kind).tobytes(), w[m].astype("<i8").tobytes()))
            cols = list(zip(*out)) if out else [[]] * 6
            types = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
            return pa.table([pa.array(x, y) for x, y in zip(cols, types)], names=["bundle", "list", "ids", "labels", "vectors", "windows"])

        return run

    def _visited(self, routes: DataFrame, k: int, same_label: bool) -> DataFrame:
        dims, kind = self.dims, self.kind

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[np.ndarray] = []
            if left.num_rows and right.num_rows:
                ids, labels = (np.frombuffer(right[n][0].as_py(), "<i8") for n in ("ids", "labels"))
                x = np.frombuffer(right["vectors"][0].as_py(), kind).reshape(-1, dims)
                for i in range(left.num_rows):
                    own, of = (np.frombuffer(left[n][i].as_py(), "<i8") for n in ("ids", "labels"))
                    q = np.frombuffer(left["vectors"][i].as_py(), kind).reshape(-1, dims)
                    windows = np.frombuffer(left["windows"][i].as_py(), "<i8").reshape(len(own), -1, 4)
                    out += visit(q, own, of, windows, x, ids, labels, k, same_label)
            rows = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "key", "vec_id", "score"), rows)})

        wanted = routes.groupBy("list", F.col("bundle").alias("to")).agg(F.first("bundle").alias("bundle")).drop("to")
        blocks = self.table.join(wanted, "list")  # a block for each bundle that visits its list
        sizes = self.spark.createDataFrame([(i, int(b)) for i, b in enumerate(self.blocks) if b], "list int, blocks long")
        visits = routes.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        return visits.groupBy("list", "block", "bundle").cogroup(blocks.groupBy("list", "block", "bundle")).applyInArrow(run, FOUND)


def visit(q: np.ndarray, own: np.ndarray, of: np.ndarray, windows: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, same_label: bool) -> list[np.ndarray]:
    """Rows of ``anchor, key, id, score``: each window's best of a block whose rows stand in order of id."""
    s, out = products(q, x), []
    fits = (of[:, None] == labels[None, :]) == same_label
    fits &= own[:, None] != ids[None, :]
    repeats = len(ids) > 1 and bool((ids[1:] == ids[:-1]).any())
    for j in range(windows.shape[1]):
        key, lo, hi, kth = windows[:, j].T
        inside = fits & (s >= np.maximum(lo, kth)[:, None]) & (s <= hi[:, None])
        for i in np.flatnonzero(inside.any(1)):
            at = np.flatnonzero(inside[i])
            score = s[i, at]
            if repeats:
                at = at[np.lexsort((-score, ids[at]))]
                at = at[np.unique(ids[at], return_index=True)[1]]
                score = s[i, at]
            if len(at) > k:
                edge = np.partition(score, len(at) - k)[len(at) - k]
                over = np.flatnonzero(score > edge)
                pick = np.concatenate([over, np.flatnonzero(score == edge)[: k - len(over)]])
                at, score = at[pick], score[pick]
            out.append(np.stack([np.full(len(at), own[i]), np.full(len(at), key[i]), ids[at], score]))
    return out


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", lists: int | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its ``positives`` best other rows of the same
    label; for each, the ``negatives`` best rows of other labels whose score is
    ``least`` to ``most`` hundredths of the positive's.
    """
    index = Lists(rows, scale, id_col, label_col, vector_col, lists)
    anchors = written(index.anchors(rows.filter(is_anchor), id_col, label_col, vector_col), "anchors")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(NONE + 1).alias("lo"), F.lit(-NONE).alias("hi")))
    near = index.search(anchors.withColumn("windows", everything), positives, same_label=True)
    window = F.struct(F.col("vec_id").alias("key"), F.expr(f"({least} * cast(score as decimal(20,0)) + 99) div 100").alias("lo"), F.expr(f"({most} * cast(score as decimal(20,0))) div 100").alias("hi"))
    asked = near.filter("score >= 0").groupBy("anchor_id").agg(F.collect_list(window).alias("windows"))  # one for each positive
    found = index.search(anchors.join(asked, "anchor_id"), negatives, same_label=False)
    pairs = near.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor_id", "key"]).select(
        "anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """The query's labels: ids divisible by 7 take the next of ten labels."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""

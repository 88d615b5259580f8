"""Retrieval over any tables of vectors and texts: nearest rows in blocks, keyword and hybrid scores, context, citations, and the modes that answer questions.

Vector search deals both sides into blocks and meets them by ``(query block,
row block)``: each pair of blocks is a matrix product in one group of bounded
size, a strip of queries at a time, of which only each query's best rows leave. Tasks grow with queries times
rows, nothing is broadcast, and no pair is written out that can't be a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.operators.registries import mode
from loomgraph.session import dealt, spread, written

QUERY_ROWS, ROWS, LEAST_ROWS, STRIP = 8192, 8192, 256, 64  # vectors in a block: of queries, and of rows at most and (where cores would idle) at least; queries scored at a time


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of each length: their places and the matrix of them; null components become NaN."""
    sizes = pc.list_value_length(column).to_numpy()
    places = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
    values = lambda at: pc.cast(pc.list_flatten(column.take(pa.array(at))), pa.float64()).to_numpy()
    return {n: (at, values(at).reshape(len(at), n)) for n, at in places.items()}


def cosines(q: np.ndarray, r: np.ndarray, digits: int) -> np.ndarray:
    """Cosines clipped to [0, 1]; 0 where a norm is 0 or a component isn't finite."""
    finite = np.isfinite(q).all(1)[:, None] & np.isfinite(r).all(1)[None, :]
    with np.errstate(invalid="ignore"):
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None, :]
        return np.round(np.clip(np.divide(q @ r.T, size, out=np.zeros_like(size), where=(size > 0) & finite), 0, 1), digits)


def distances(q: np.ndarray, r: np.ndarray, digits: int) -> np.ndarray:
    """Euclidean distances; infinite where a component isn't finite."""
    finite = np.isfinite(q).all(1)[:, None] & np.isfinite(r).all(1)[None, :]
    with np.errstate(invalid="ignore"):
        square = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * (q @ r.T)
        return np.where(finite, np.round(np.sqrt(np.maximum(0, square)), digits), np.inf)


def _scores(q: pa.ChunkedArray, rows: dict[int, tuple[np.ndarray, np.ndarray]], n_rows: int, metric: str, digits: int) -> np.ndarray:
    """Larger is nearer: cosines, or negative distances; vectors of different lengths score 0, or are at no distance."""
    out = np.full((len(q), n_rows), -np.inf if metric == "l2" else 0.0)
    for n, (i, a) in _by_length(q).items():
        if n in rows:
            j, b = rows[n]
            out[np.ix_(i, j)] = -distances(a, b, digits) if metric == "l2" else cosines(a, b, digits)
    return out


def _top_cosines(q: np.ndarray, r: np.ndarray, q_ids: np.ndarray | None, r_ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``q`` and ``r`` and scores of the ``k`` best rows of each query, ties to the earlier row, and the queries left out: those whose ``k``-th score may be 0.

    Single precision tells which rows come near the ``k``-th; their scores are
    taken in double precision. With ``q_ids``, rows of a query's own id are left out.
    """
    def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.linalg.norm(x, axis=1)
        good = np.isfinite(x).all(1) & (size > 0) & np.isfinite(size)
        return size, np.divide(x, size[:, None], out=np.zeros_like(x), where=good[:, None]).astype(np.float32)

    (q_size, qu), (r_size, ru) = units(q), units(r)
    off = 10.0**-digits + 2.4e-7 * max(4, q.shape[1])
    found, left = [], []
    for at in range(0, len(q), STRIP):
        s = qu[at : at + STRIP] @ ru.T
        if q_ids is not None:
            s[q_ids[at : at + STRIP, None] == r_ids[None, :]] = -2
        kth = np.partition(s, len(r) - k, axis=1)[:, len(r) - k]
        left.append(at + np.flatnonzero(kth <= off))
        i, j = np.nonzero(s >= np.where(kth > off, kth - off, 3)[:, None])
        i = i + at
        score = np.round(np.clip(np.einsum("nd,nd->n", q[i], r[j]) / (q_size[i] * r_size[j]), 0, 1), digits)
        by = np.lexsort((j, -score, i))
        i, j, score = i[by], j[by], score[by]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[keep], j[keep], score[keep]))
    return (*(np.concatenate(x) for x in zip(*found)), np.concatenate(left))


def _blocks(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, query_rows: int, row_rows: int) -> tuple[DataFrame, DataFrame]:
    n_q, n_r = queries.count(), rows.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_blocks = max(1, -(-n_q // query_rows))
    r_blocks = max(1, -(-n_r // row_rows), min(-(-n_r // LEAST_ROWS), -(-tasks // q_blocks)))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    of = lambda c, n: F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(n))
    return queries.withColumn("_q", of(query_id, q_blocks)).withColumn("_r", to_all(r_blocks)), rows.withColumn("_r", of(row_id, r_blocks)).withColumn("_q", to_all(q_blocks))


def nearest(
    queries: DataFrame, rows: DataFrame, k: int, *, query_id: str = "query_id", row_id: str = "vec_id", query_vector: str = "qe", vector: str = "embedding", metric: str = "cosine", digits: int = 6,
    same: tuple[str, str] | None = None, least: str | None = None, best_per: str | None = None, others: bool = True, query_rows: int = QUERY_ROWS, row_rows: int = ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of each query with ``score`` and ``rank``, ties to the smaller row id; all columns of both sides but the vectors.

    ``k`` of 0 takes every row whose score reaches the query's column ``least``.
    ``same`` names a column of each side that must be equal, ``best_per`` a row
    column of which the best row of each value is a candidate too (then ``rank``
    counts candidates, and the caller cuts). With ``others``, a row isn't its own
    neighbour. For ``l2`` the score is the distance, the least first. Null vectors
    take no part. Cosines are 0 where a vector is all zeros, holds a null or a
    component that isn't finite, or the lengths differ; for ``l2`` such pairs have
    no distance and are no hits.
    """
    queries, rows = queries.filter(F.col(query_vector).isNotNull()), rows.filter(F.col(vector).isNotNull())
    names_q, names_r = [c for c in queries.columns if c != query_vector], [c for c in rows.columns if c != vector]
    q, r = _blocks(queries, rows, query_id, row_id, query_rows, row_rows)
    fields = [queries.schema[c] for c in names_q] + [rows.schema[c] for c in names_r]
    schema = StructType(fields).add("score", "double")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by(row_id)  # so that the first of equal scores has the smaller id
        out = pa.schema([a.schema.field(c) for c in names_q] + [b.schema.field(c) for c in names_r] + [("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        rows = _by_length(b[vector])
        b, parts = b.select(names_r), []
        if metric == "cosine" and k and k < b.num_rows and not (same or least or best_per) and len(rows) == 1:
            (n, (_, r)), asked = next(iter(rows.items())), _by_length(a[query_vector])
            if set(asked) == {n} and n:
                i, j, score, left = _top_cosines(asked[n][1], r, a[query_id].to_numpy() if others else None, b[row_id].to_numpy(), k, digits)
                parts.append(pa.table([*[a[c].take(pa.array(i)) for c in names_q], *[b[c].take(pa.array(j)) for c in names_r], pa.array(score)], schema=out))
                a = a.take(pa.array(left))
        return pa.concat_tables([out.empty_table(), *parts, *(strip(a.slice(at, STRIP), b, rows) for at in range(0, a.num_rows, STRIP))])

    def strip(a: pa.Table, b: pa.Table, rows: dict) -> pa.Table:
        s = _scores(a[query_vector], rows, b.num_rows, metric, digits)
        if others:
            s[a[query_id].to_numpy()[:, None] == b[row_id].to_numpy()[None, :]] = -np.inf
        if same:
            s[a[same[0]].to_numpy()[:, None] != b[same[1]].to_numpy()[None, :]] = -np.inf
        keep = s > -np.inf
        if least:
            keep &= s >= a[least].to_numpy()[:, None] - 1e-9
        if k:
            top = np.zeros_like(keep)
            np.put_along_axis(top, np.argsort(-s, axis=1, kind="stable")[:, :k], True, axis=1)
            if best_per:
                value = b[best_per].to_numpy()
                for v in np.unique(value):
                    at = np.flatnonzero(value == v)
                    top[np.arange(len(s)), at[s[:, at].argmax(1)]] = True
            keep &= top
        i, j = np.nonzero(keep)
        cols = [a[c].take(i) for c in names_q] + [b[c].take(j) for c in names_r]
        return pa.table([*cols, pa.array(s[i, j])], names=[*names_q, *names_r, "score"])

    found = spread(q, "_q", "_r").groupBy("_q", "_r").cogroup(spread(r, "_q", "_r").groupBy("_q", "_r")).applyInArrow(meet, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)))
    if k and not best_per:
        ranked = ranked.filter(F.col("rank") <= k)
    return ranked.withColumn("score", -F.col("score")) if metric == "l2" else ranked


def retrieve(queries: DataFrame, rows: DataFrame, k: int, least: float = 0.0, keep: Column | None = None, **how) -> DataFrame:
    """Threshold search: the ``k`` nearest rows that pass ``keep`` and score ``least`` or more. The filter is on rows before the search, so ``k`` of them come where there are so many."""
    return nearest(queries, rows if keep is None else rows.filter(keep), k, **how).filter(F.col("score") >= least)


def fan_out(hits: DataFrame, query_id: str = "query_id", row_id: str = "vec_id") -> DataFrame:
    """Hits of many queries with each row once, for the first query that brought it."""
    w = Window.partitionBy(row_id).orderBy(query_id, "rank")
    return hits.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


WORD = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct lower-cased words of letters and digits of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WORD), lambda w: w != ""))


COMMON, TERMS = 20_000, 50  # terms that a broadcast may hold, and terms that a text is taken to have when texts are dealt to tasks


def best_terms(rows: DataFrame, row_id: str, text: str, separator: str, k: int, least_length: int = 4) -> DataFrame:
    """``row_id, term, weight, rank``: the ``k`` terms of highest tf-idf of each id, ties to the first term.

    Texts are dealt by id once, and their terms are counted and ranked there.
    The numbers of the ``COMMON`` commonest terms are broadcast; of those, only
    an id's best ``k`` go on. Only rarer terms meet their numbers by a shuffle.
    """
    rows = rows.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    word = F.explode(F.split(F.lower("text"), separator)).alias("term")
    n = rows.count()
    tf = dealt(rows, TERMS * n, "id").select("id", word).filter(F.length("term") >= least_length).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = written(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    common = df.filter("df > 1").orderBy(F.desc("df"), "term").limit(COMMON)
    weight = F.round(F.col("tf") * F.log((1.0 + n) / (1.0 + F.col("df"))), 6)
    best = lambda w: w.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "term"))).filter(F.col("rank") <= k)
    marked = tf.join(F.broadcast(written(common, "common")), "term", "left")
    few = best(marked.filter("df is not null").select("id", "term", weight.alias("weight"))).drop("rank")
    rare = marked.filter("df is null").select("id", "term", "tf").join(df, "term").select("id", "term", weight.alias("weight"))
    return best(few.unionByName(rare)).select(F.col("id").alias(row_id), "term", "weight", "rank")


def keyword_scores(queries: DataFrame, rows: DataFrame, k: int, question: str, text: str, query_id: str = "query_id", row_id: str = "vec_id") -> DataFrame:
    """``query_id, row_id, score``: the ``k`` rows of each query that hold most of its words, by an equi-join on words."""
    asked = queries.select(F.col(query_id), F.explode(terms(F.col(question))).alias("word"))
    held = rows.select(F.col(row_id), F.explode(terms(F.col(text))).alias("word"))
    hits = held.join(asked, "word").groupBy(query_id, row_id).agg(F.count(F.lit(1)).cast("double").alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid(first: DataFrame, second: DataFrame, query_id: str = "query_id", row_id: str = "vec_id") -> DataFrame:
    """Two lists of hits as one: scores over their query's best, a row takes the larger."""
    def scaled(hits: DataFrame) -> DataFrame:
        best = F.max("score").over(Window.partitionBy(query_id))
        return hits.select(query_id, row_id, F.when(best > 0, F.col("score") / best).otherwise(0.0).alias("score"))

    both = scaled(first).unionByName(scaled(second)).groupBy(query_id, row_id).agg(F.round(F.max("score"), 5).alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)))


def pack_context(hits: DataFrame, most: int, text: str = "text", query_id: str = "query_id", row_id: str = "vec_id", separator: str = "\n----\n") -> DataFrame:
    """``query_id, used, context, sources``: a query's ``most`` best texts as one, and whence they come as citations of row and score."""
    top = hits.filter(F.col("rank") <= most)
    parts = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text"), F.struct(F.col(row_id).alias("id"), F.round("score", 4).alias("score")).alias("source"))))
    packed = top.groupBy(query_id).agg(F.count(F.lit(1)).alias("used"), parts.alias("parts"))
    return packed.select(query_id, "used", F.array_join(F.transform("parts", lambda p: p["text"]), separator).alias("context"), F.array_distinct(F.transform("parts", lambda p: p["source"])).alias("sources"))


def citations(hits: DataFrame, row_id: str = "vec_id") -> DataFrame:
    """Distinct ``id, score`` of hits, scores at four digits."""
    return hits.select(F.col(row_id).alias("id"), F.round("score", 4).alias("score")).distinct()


def hop_budget(score: Column) -> tuple[Column, Column]:
    """Steps and neighbours that a similarity allows: two and 40 above .9, one and 20 from .3 on or where it is unknown, else none."""
    far, near = score > 0.9, score.isNull() | (score >= 0.3)
    return F.when(far, 2).when(near, 1).otherwise(0), F.when(far, 40).when(near, 20).otherwise(0)


def neighbourhood(entities: DataFrame, links: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``query_id, entity_id, neighbour, hops`` for ``entities(query_id, entity_id, score)`` along ``links(src, dst)`` either way, within the budget of the score; nearer ones first, then smaller ids."""
    both = links.select(F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(links.select(F.col("dst").alias("at"), F.col("src").alias("to"))).distinct()
    steps, most = hop_budget(F.col("score"))
    start = entities.select(query_id, "entity_id", steps.alias("steps"), most.alias("most")).filter("steps > 0")
    one = start.join(both, F.col("entity_id") == F.col("at")).select(query_id, "entity_id", "steps", "most", F.col("to").alias("neighbour"))
    two = one.filter("steps > 1").join(both, F.col("neighbour") == F.col("at")).select(query_id, "entity_id", "most", F.col("to").alias("neighbour"), F.lit(2).alias("hops"))
    reached = one.select(query_id, "entity_id", "most", "neighbour", F.lit(1).alias("hops")).unionByName(two).filter(F.col("neighbour") != F.col("entity_id"))
    reached = reached.groupBy(query_id, "entity_id", "most", "neighbour").agg(F.min("hops").alias("hops"))
    w = Window.partitionBy(query_id, "entity_id").orderBy("hops", "neighbour")
    return reached.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= F.col("most")).select(query_id, "entity_id", "neighbour", "hops")


@dataclass(frozen=True)
class Corpus:
    """Tables that modes search; a mode needs only its own.

    ``chunks(chunk_id, doc_id, text, embedding)``, ``entities(entity_id, name,
    community_id, embedding)``, ``communities(community_id, summary,
    embedding)``, ``mentions(chunk_id, entity_id)``, ``links(src, dst)``.
    """

    chunks: DataFrame | None = None
    entities: DataFrame | None = None
    communities: DataFrame | None = None
    mentions: DataFrame | None = None
    links: DataFrame | None = None


def _indexed(queries: DataFrame, rows: DataFrame, k: int, text: str, keyword: bool) -> DataFrame:
    """Hits by vector, and by keyword as well where the mode has such an index: ``query_id, id, text, score, rank``."""
    asked = queries.select("query_id", F.col("embedding").alias("qe"))
    hits = nearest(asked, rows.select("id", "embedding"), k, row_id="id", others=False)
    if keyword:
        hits = hybrid(hits, keyword_scores(queries, rows, k, "question", text, row_id="id"), row_id="id").filter(F.col("rank") <= k)
    return hits.join(rows.select("id", F.col(text).alias("text")), "id").select("query_id", "id", "text", "score", "rank")


def _entities_of(queries: DataFrame, hits: DataFrame, corpus: Corpus, most: int = 40) -> DataFrame:
    """A query's entities by the number of hits that mention them, with their similarity to it."""
    often = hits.join(corpus.mentions, hits["id"] == corpus.mentions["chunk_id"]).groupBy("query_id", "entity_id").agg(F.countDistinct("id").alias("freq"))
    often = often.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("freq"), "entity_id"))).filter(F.col("nth") <= most)
    e, q = corpus.entities.select("entity_id", "embedding"), queries.select("query_id", F.col("embedding").alias("qe"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("qe"), F.col("qe")))
    score = F.when(size > 0, F.round(dot(F.col("embedding"), F.col("qe")) / size, 6))
    return often.join(e, "entity_id").join(q, "query_id").select("query_id", "entity_id", "freq", score.alias("score"))


def answer(name: str | None, corpus: Corpus, queries: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Run a retrieval mode on ``queries(query_id, question, embedding)``: ``query_id, kind, id, text, score``, the kind being chunk, entity, neighbour or community.

    ``documents(doc_id)`` limits modes that allow it to chunks of those.
    """
    m = mode(name)
    out = lambda df, kind: df.select("query_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "text", F.col("score").cast("double").alias("score"))
    named = lambda df: df.join(corpus.entities.select(F.col("entity_id").alias("id"), F.col("name").alias("text")), "id")
    if m.search in ("vector", "graph_vector"):
        chunks = corpus.chunks.withColumnRenamed("chunk_id", "id")
        if documents is not None and m.document_filter:
            chunks = chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
        hits = _indexed(queries, chunks, m.top_k, "text", m.keyword_index is not None)
        if m.search == "vector":
            return out(hits, "chunk")
        entities = _entities_of(queries, hits, corpus)
        near = neighbourhood(entities, corpus.links).groupBy("query_id", F.col("neighbour").alias("id")).agg(F.min("hops").alias("score"))
        return out(hits, "chunk").unionByName(out(named(entities.withColumnRenamed("entity_id", "id")), "entity")).unionByName(out(named(near), "neighbour"))
    if m.search == "local_community":
        rows = corpus.entities.select(F.col("entity_id").alias("id"), "name", "community_id", "embedding")
        hits = _indexed(queries, rows, m.top_k, "name", False).join(rows.select("id", "community_id"), "id")
        freq = hits.groupBy("query_id", "community_id").agg(F.count(F.lit(1)).alias("freq"), F.max("score").alias("score"))
        top = freq.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("freq"), F.desc("score"), "community_id"))).filter("nth <= 3")
        top = top.join(corpus.communities.select("community_id", F.col("summary").alias("text")), "community_id").withColumnRenamed("community_id", "id")
        return out(hits, "entity").unionByName(out(top, "community"))
    if m.search == "global":
        return out(_indexed(queries, corpus.communities.withColumnRenamed("community_id", "id"), m.top_k, "summary", m.keyword_index is not None), "community")
    # the graph alone: entities that the question names, and what is linked to them
    asked = queries.select("query_id", F.explode(terms(F.col("question"))).alias("word"))
    met = corpus.entities.select("entity_id", F.lower("name").alias("word")).join(asked, "word").select("query_id", "entity_id", F.lit(None).cast("double").alias("score"))
    near = neighbourhood(met, corpus.links).groupBy("query_id", F.col("neighbour").alias("id")).agg(F.min("hops").alias("score"))
    return out(named(met.withColumnRenamed("entity_id", "id")), "entity").unionByName(out(named(near), "neighbour"))

"""A keyword index as stored posting lists, scored by BM25, with block maxima.

Rows are dealt into blocks of about ``BLOCK_ROWS`` by hash of the id; a posting
row holds a term's rows of one block, with their term weights (BM25 without the
inverse document frequency) and the largest of them. So a term that every row
holds is as many postings as there are blocks, and no list grows with the table.

A search first reads terms, blocks and maxima only: a query's bound on a block
is the sum of its terms' maxima there, times their frequencies' weight. It
scores the ``FIRST`` blocks of the highest bounds whole, which gives a k-th
score, and then only those other blocks whose bound reaches it. Blocks that
can't hold a result are never read; the rows are those of a full scan.

Words are runs of letters and digits in lower case. Rows with a null id or text
take no part, nor do texts without words, though texts without words count in
the mean length; repeated words of a question count once; ties go to the
smaller id; of rows that repeat an id all words count together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.operators.retrieval import TERMS, WORD, terms
from loomgraph.session import dealt, shared_dir, spread, written

BLOCK_ROWS, FIRST, PIECES, QUERIES = 256, 2, 16, 1024
K1, B = 1.2, 0.75  # fixed values: the usual constants of BM25


@dataclass
class KeywordIndex:
    """``postings(term, block, most, rows array<struct<id, weight>>)``, ``terms(term, df)`` and ``stats(n, mean)`` under a folder."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, rows: DataFrame, row_id: str = "doc_id", text: str = "text", path: str | None = None, block_rows: int | None = None) -> KeywordIndex:
        spark = rows.sparkSession
        path = path or f"{shared_dir(spark)}/loom-keywords-{uuid.uuid4().hex}"
        words = F.filter(F.split(F.lower(F.col(f"`{text}`")), WORD), lambda w: w != "")
        good = rows.filter(F.col(f"`{row_id}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{row_id}`").alias("id"), words.alias("words"))
        sizes = good.groupBy("id").agg(F.sum(F.size("words")).alias("length"))
        stats = written(sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")), "stats")
        n, mean = stats.first()
        stats.write.parquet(f"{path}/stats")
        blocks = max(1, -(-n // (block_rows or BLOCK_ROWS)))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / max(mean, 1e-9)))
        # texts go to their block's task once; words are counted, weighed and listed there
        texts = dealt(good.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), TERMS * n, "block")
        per_term = texts.select("block", "id", F.explode("words").alias("term")).groupBy("block", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
        per_term = per_term.withColumn("length", F.sum("tf").over(Window.partitionBy("block", "id")))
        weighed = per_term.select("term", "block", F.struct("id", weight.alias("weight")).alias("row"))
        postings = weighed.groupBy("term", "block").agg(F.max("row.weight").alias("most"), F.array_sort(F.collect_list("row")).alias("rows"), F.count(F.lit(1)).alias("df"))  # a block's rows at most
        postings.write.parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        stored.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{path}/terms")
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def asked(self, queries: DataFrame, query_id: str = "query_id", question: str = "question") -> DataFrame:
        """``query_id, term, idf`` of the words that the index knows."""
        n = self._table("stats").first()["n"]
        words = queries.filter(F.col(f"`{query_id}`").isNotNull()).select(F.col(f"`{query_id}`").alias("query_id"), F.explode(terms(F.col(f"`{question}`"))).alias("term")).distinct()
        return words.join(self._table("terms"), "term").select("query_id", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def bounds(self, asked: DataFrame) -> DataFrame:
        """``query_id, block, bound``: no row of the block scores more. A term's blocks are dealt in pieces, so common terms are many tasks."""
        heads = self._table("postings").select("term", "block", "most").withColumn("piece", F.pmod(F.col("block"), F.lit(PIECES)))
        dealt = asked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long"))))
        return heads.join(dealt, ["term", "piece"]).groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))

    def _scored(self, asked: DataFrame, chosen: DataFrame, digits: int) -> DataFrame:
        """Scores of all rows of the chosen blocks: a block's postings of asked terms meet the queries that want it in one group, which sums there; postings are dealt once, whatever the queries."""
        stored = self._table("postings")
        held = stored.join(asked.select("term").distinct(), "term", "left_semi").select("block", "term", "rows")
        groups = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
        group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).alias("group")
        wanted = chosen.select("query_id", "block").join(asked, "query_id").select("block", group("query_id"), "query_id", "term", "idf")
        held = held.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        schema = StructType().add("query_id", asked.schema["query_id"].dataType).add("id", stored.schema["rows"].dataType.elementType["id"].dataType).add("score", "double")

        def score(q: pa.Table, p: pa.Table) -> pa.Table:
            ids = lambda: p["rows"].combine_chunks().flatten()
            if not q.num_rows or not p.num_rows:
                return pa.table([q["query_id"].combine_chunks()[:0], ids().field("id")[:0], pa.array([], pa.float64())], names=["query_id", "id", "score"])
            size, rows = pc.list_value_length(p["rows"]).to_numpy(), ids()
            named, row = np.unique(rows.field("id").to_numpy(zero_copy_only=False), return_inverse=True)
            weight = rows.field("weight").to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            at = pc.index_in(q["term"], p["term"].combine_chunks()).to_pandas().to_numpy(np.float64)
            asks = pc.dictionary_encode(q["query_id"].combine_chunks())
            who, idf = asks.indices.to_numpy(), q["idf"].to_numpy()
            total, met = np.zeros((len(asks.dictionary), len(named))), np.zeros((len(asks.dictionary), len(named)), bool)
            for i in np.flatnonzero(~np.isnan(at)):  # a term's rows are of distinct ids
                one = slice(ends[int(at[i])] - size[int(at[i])], ends[int(at[i])])
                total[who[i], row[one]] += idf[i] * weight[one]
                met[who[i], row[one]] = True
            i, j = np.nonzero(met)
            return pa.table([asks.dictionary.take(pa.array(i)), pa.array(named[j]), pa.array(total[i, j])], names=["query_id", "id", "score"])

        keys = ("block", "group")
        hits = spread(wanted, *keys).groupBy(*keys).cogroup(spread(held, *keys).groupBy(*keys)).applyInArrow(score, schema)
        return hits.select("query_id", "id", F.round("score", digits).alias("score"))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", question: str = "question", digits: int = 6) -> DataFrame:
        """``query_id, id, score, rank``: each query's ``k`` best rows."""
        asked = written(self.asked(queries, query_id, question), "asked")
        bound = written(self.bounds(asked).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))), "bounds")
        best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        top = lambda scored: scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
        first = written(top(self._scored(asked, bound.filter(F.col("nth") <= FIRST), digits)), "first")
        kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        open_ = bound.filter(F.col("nth") > FIRST).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0**-digits))
        return top(first.drop("rank").unionByName(self._scored(asked, open_, digits)))

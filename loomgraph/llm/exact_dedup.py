"""Exact dedup with a heavy-hitter split, in DataFrame and SQL functions only.

Texts are equal when identical after lower-casing A-Z. One scan reduces every
document to ``(id, digest)``; the text goes no further. A mergeable
frequent-items sketch (the Misra-Gries family, ``approx_top_k``) names at most
``k`` candidate digests. They are counted exactly, and the verified winners (at
most ``k`` rows, whatever the input) are broadcast: their rows are resolved on
the map side and never shuffled. The remaining digests go through an ordinary
shuffle, in which no group can be frequent any more.

Defined results: a null text equals an empty one; rows with a null id keep
their own row and rank lowest in their group; an empty table gives an empty
result; repeated (id, text) rows each give a row, and one row per group (the
largest id) is kept, all rows that carry that id and text counting as it; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import free_names
from loomgraph.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z. ``lower`` does just that on pure ASCII and has a fast path for it; other texts go by table."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(lower_ascii(text), 256).alias("text_sha256"))


def frequent(rows: DataFrame, k: int, tracked: int) -> DataFrame:
    """At most ``k`` digests that may be frequent: a row of the digest each, from the merged sketches of all partitions."""
    top = rows.select(F.expr(f"approx_top_k(text_sha256, {k}, {tracked})").alias("top"))
    return top.select(F.explode("top.item").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024, tracked: int = 16384, least: int = 8) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``k`` bounds the broadcast (about 100 bytes a row); ``tracked`` is the
    number of counters of the sketch, so that any digest with more than about
    ``n / tracked`` copies is found; a candidate with fewer than ``least``
    verified copies isn't worth the map-side path.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    totals = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = (
        rows.join(F.broadcast(frequent(rows, k, tracked)), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(*totals)
        .filter(F.col("group_size") >= least)
    )
    heavy = written(heavy, "heavy")  # at most k rows
    seen = rows.join(F.broadcast(heavy), "text_sha256")
    light = (
        rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
        .withColumns({"keep_id": F.max("doc_id").over(w := Window.partitionBy("text_sha256")), "group_size": F.count(F.lit(1)).over(w)})
    )
    return seen.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts: of the largest id, a null id only where the group has no other.

    Rows are told apart by id and text, so other texts under an id of the group
    stay; of rows that repeat both, one stays. Columns may have any names.
    """
    name, sha = free_names(docs, "id", "sha")
    gone = exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    keyed = docs.withColumns({name: F.col(f"`{id_col}`").cast("long"), sha: F.sha2(lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 256)})
    left = keyed.alias("d").join(gone.alias("g"), F.col(f"d.{name}").eqNullSafe(F.col("g.gone_id")) & (F.col(f"d.{sha}") == F.col("g.gone_sha")), "left_anti")
    return left.dropDuplicates([name, sha]).drop(name, sha)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

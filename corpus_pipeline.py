"""The corpus pipeline: documents in, packed token windows out.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that its
predecessor kept; its result is written as Parquet in the shared folder and
read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, line_dedup, ngram_join, packing, secrets
from loomgraph.llm.common import free_names
from loomgraph.llm.queries import tokenizer_file
from loomgraph.session import written
from loomgraph.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or a score below one half) go."""
    return langid.keep_identified(docs, langid.fit_on(docs, "doc_id", "text", "lang"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; a document of which nothing else is left goes with them. Null and empty texts stay."""
    counts = free_names(docs, "n_lines", "n_dropped")
    cleaned = line_dedup.line_dedup(docs, counts=counts)
    left = cleaned.filter((F.col(counts[1]) == 0) | (F.trim(F.translate("text", "\n\t", "  ")) != ""))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns]).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays."""
    return ngram_join.keep_one_row_of_each_group(docs)


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked in place; every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("secret_scans", credentials), ("packing", pack)]

#: SQL can't express the trained, similarity and tokenizer stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

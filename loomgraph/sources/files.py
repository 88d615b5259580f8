"""File and stream adapters: plain text, object stores, statute XML, unit and rule JSON, training and evaluation sinks, embedded corpora, topics.

All of them are Spark readers and writers, so a path may name a file, a glob or
a folder in any store that Spark reads.
"""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# Marks at the start of a file and the encodings they stand for.
MARKS = (("EFBBBF", "UTF-8", 3), ("FFFE", "UTF-16LE", 2), ("FEFF", "UTF-16BE", 2))

# Element names of the statute service's XML.
ARTICLE, ARTICLE_NUMBER, ARTICLE_TITLE, ARTICLE_TEXT = "조문단위", "조문번호", "조문제목", "조문내용"


def objects(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length`` of the files below a path; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", "modificationTime", "length")


def decoded(content: Column) -> Column:
    """Text of bytes: by the mark at their start, else UTF-8 where valid, else Latin-1, which takes any byte."""
    out = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    for mark, name, size in reversed(MARKS):
        out = F.when(F.hex(F.substring(content, 1, size)) == mark, F.decode(F.substring(content, size + 1, 2_147_483_647), name)).otherwise(out)
    return out


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``path, file_name, text`` of whole text files, whatever their encoding."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), decoded(F.col("content")).alias("text"))


def web_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``url, host, text`` of fetched pages."""
    from loomgraph.functions.text import strip_tags

    return pages.select(F.col(url_col).alias("url"), F.regexp_extract(url_col, "^[a-z]+://([^/:?#]+)", 1).alias("host"), strip_tags(F.col(html_col)).alias("text"))


def statute_xml(spark: SparkSession, path: str) -> DataFrame:
    """``law, seq, number, title, content`` of the article elements of statute files; ``seq`` counts a file's elements in their order, and headings of chapters are rows like articles, without a title."""
    fields = ", ".join(f"`{x}` string" for x in (ARTICLE_NUMBER, ARTICLE_TITLE, ARTICLE_TEXT))
    rows = spark.read.format("xml").option("rowTag", ARTICLE).schema(fields).load(path)
    clean = [F.trim(F.regexp_replace(F.col(f"`{x}`"), "<[^>]*>", "")) for x in (ARTICLE_NUMBER, ARTICLE_TITLE, ARTICLE_TEXT)]
    named = rows.select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.[^.]*)?$", 1).alias("law"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), *[c.alias(a) for c, a in zip(clean, ("number", "title", "content"))])
    # the article's own text holds the full number; the element holds only its first part
    full = F.regexp_extract(F.coalesce("content", F.lit("")), "^제(\\d+조(?:의\\d+)?)", 1)
    named = named.filter(F.coalesce("number", F.lit("")) != "").withColumn("number", F.when(full != "", full).otherwise(F.concat("number", F.lit("조"))))
    # a file may be read in several blocks; rows are numbered upwards within each
    place = F.row_number().over(Window.partitionBy("at.file").orderBy("at.block", "at.row"))
    return named.select("law", place.alias("seq"), "number", "title", "content")


UNITS = "unit_type string, unit_number string, title string, content string, unit_path string, full_id string, parent_id string, `order` int, revision_dates array<string>"


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units of statute files ``{law_info: {law_name}, units: [...]}``, a row each."""
    schema = f"law_info struct<law_name: string>, units array<struct<{UNITS.replace(' string', ': string').replace(' int', ': int').replace(' array', ': array')}>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.col("law_info.law_name").alias("law_name"), F.inline("units"))


def write_units(units: DataFrame, path: str) -> None:
    """The same files, one line for each law; a law's units are as many as its text has, not as many as the corpus."""
    fields = [c.split(" ")[0].strip("`") for c in UNITS.split(", ")]
    by_law = units.groupBy("law_name").agg(F.array_sort(F.collect_list(F.struct("order", "full_id", F.struct(*[F.col(f"`{f}`") for f in fields]).alias("unit")))).alias("u"))
    by_law.select(F.struct("law_name").alias("law_info"), F.transform("u", lambda x: x["unit"]).alias("units")).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str, source: str, rules: str, fields: str, defaults: dict[str, object]) -> DataFrame:
    """Rules of files ``{<source>: {...}, <rules>: [...]}`` with defaults where a rule doesn't name a field. A file without either key is an error."""
    schema = f"`{source}` string, `{rules}` array<string>"
    files = spark.read.schema(schema).option("multiLine", "true").json(path)
    for key in (source, rules):
        files = files.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"missing key {key}"))).otherwise(F.col(key)))
    each = files.select(F.explode(rules).alias("rule"), F.col(source).alias("_source")).filter(F.length("_source") >= 0)
    each = each.select(F.from_json("rule", fields).alias("r"))
    names = each.schema["r"].dataType.fieldNames()
    return each.select(*[F.coalesce(F.col(f"r.{n}"), F.lit(defaults[n])).alias(n) if n in defaults else F.col(f"r.{n}").alias(n) for n in names])


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, fields that are null left out."""
    rows.write.mode("overwrite").json(path)


def messages(rows: DataFrame, system: str, asked: str, answered: str) -> DataFrame:
    """Training examples: ``messages``, an array of role and content."""
    turns = F.array(*[F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", F.lit(system)), ("user", F.col(asked)), ("assistant", F.col(answered)))])
    return rows.select(turns.alias("messages"))


def write_report(metrics: DataFrame, path: str) -> None:
    """Evaluation results as CSV with a header, and as JSON, side by side."""
    metrics.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    metrics.write.mode("overwrite").json(f"{path}/json")


def append_results(rows: DataFrame, path: str) -> int:
    """Append to a Parquet table; the number of rows that were written, counted as they went. A write that fails isn't fatal: it is logged and gives 0."""
    seen = Observation()
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    except (PySparkException, Py4JJavaError) as e:
        logging.getLogger(__name__).warning("append to %s failed: %s", path, str(e)[:200])
        return 0
    return seen.get["n"]


def save_corpus(corpus: DataFrame, path: str) -> None:
    """An embedded corpus, texts and vectors together."""
    corpus.write.mode("overwrite").parquet(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def topics(spark: SparkSession, servers: str, names: tuple[str, ...], starting: str = "latest") -> DataFrame:
    """``topic, value, ts`` of message topics as a stream; needs Spark's connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(names)).option("startingOffsets", starting).load()
    return raw.select("topic", F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"))


def topic_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from a folder of JSON lines ``{topic, value, ts}`` that grows."""
    return spark.readStream.schema("topic string, value string, ts timestamp").json(path)

"""Text of pages."""

import time

import duckdb
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_tags
from loomgraph.plans import catalogue, text


def text_of(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r.t for r in df.orderBy("i").select(strip_tags(F.col("html")).alias("t")).collect()]


def test_scripts_tags_and_ends(spark):
    pages = ["<p>a<script>x<script>y</SCRIPT >b<style>z</style>c", "a<script>b", "a < b", "a<b>c < d", "<style><script></style>k</script>", None, "", "<scripture>a</scripture>", ">a<", "a\n\t b"]
    assert text_of(spark, *pages) == ["a b c", "a", "a < b", "a c < d", "k", None, "", "a", ">a<", "a b"]


def test_linear_time(spark):
    pages = ["<script " * 130_000, "<" * 1_000_000, "<script></style>" * 65_000, "</script" * 125_000 + " " * 200_000, "<style>a</style " * 60_000]
    text_of(spark, "<p>warm</p>")
    for page in pages:
        began = time.time()
        text_of(spark, page)
        assert time.time() - began < 10


def test_similar_names_by_blocks(spark, tmp_path, monkeypatch):
    """Blocks of a few rows give each pair of a brand once, and their pairs are spread over all tasks."""
    names = ["hot bolt", "hot ring", "Hot Bolt", "", None, "small hot bolt"]
    rows = [(i, names[i % 6], ("A", "B", None)[i % 7 % 3]) for i in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLES["string_similarity"]).fetchall()
    monkeypatch.setattr(text, "SIMILARITY_ROWS", 7)
    df = catalogue.QUERIES["string_similarity"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_similar_names_in_runs(spark, tmp_path):
    """All pairs of a brand are written in an order that a file holds as runs: far less than a byte a pair."""
    names = ["hot bolt", "hot ring", "cold bolt", "blue plate"]
    spark.range(12_000).selectExpr("id as p_partkey", f"element_at(array({str(names)[1:-1]}), cast(pmod(xxhash64(id), 4) + 1 as int)) as p_name", "concat('B', id % 3) as p_brand").write.parquet(f"{tmp_path}/part.parquet")
    catalogue.QUERIES["string_similarity"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 3 * 4000 * 3999 // 2
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 0.4 * 3 * 4000 * 3999 // 2

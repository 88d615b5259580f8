"""Table functions against the DataFrame calls, and the read-through cache."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import procedures as P
from loomgraph.operators.retrieval import nearest
from loomgraph.sources import cache

SF = "/root/testdata/sf0.001"


def test_vector_query_equals_the_dataframe_call(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e.select(F.col("vec_id").alias("row id"), F.col("embedding").alias("v")).createOrReplaceTempView("odd_names")
    P.register_vector_query(spark, "vq", "odd_names", "row id", "v")
    for query in (0, 7, 40):
        asked = e.filter(f"vec_id = {query}").selectExpr("vec_id as query_id", "embedding as qe")
        want = [(r.vec_id, r.score) for r in nearest(asked, e.select("vec_id", "embedding"), 6, others=False).orderBy("rank").collect()]
        vector = asked.first().qe
        got = spark.sql("SELECT * FROM vq(:v, 6) ORDER BY rank", {"v": F.array(*[F.lit(float(x)) for x in vector])})
        assert [(r["row id"], r.score) for r in got.collect()] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.sql("SELECT * FROM vq(array(1D), 6)").collect() == []  # no vector of that length


def test_neighbours_and_merge(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 1), (2, 5), (5, 5), (6, 2), (7, None), (2, 3)]
    spark.createDataFrame(edges, "a long, b long").createOrReplaceTempView("links")
    P.register_neighbours(spark, "near_by", "links", "a", "b", most_hops=3)
    near = lambda start, hops: sorted(map(tuple, spark.sql(f"SELECT * FROM near_by({start}, {hops})").collect()))
    assert near(1, 2) == [(1, 0), (2, 1), (3, 2), (5, 2)] and near(1, 0) == [(1, 0)] and near(9, 3) == [(9, 0)]
    assert near(1, 9) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 2)]
    P.register_merge(spark, "merged", "links", "a", "b")
    got = {tuple(r) for r in spark.sql("SELECT * FROM merged(2, array(3L, 6L))").collect()}
    assert got == {(1, 2), (2, 4), (4, 1), (2, 5), (5, 5)}


def test_names_are_quoted(spark):
    assert P.quoted("a`b.c") == "`a``b`.`c`"
    with pytest.raises(Exception):
        P.register_vector_query(spark, "f", "no_such_view; DROP TABLE x", "a", "b")


def test_cache_asks_once_and_keeps_failures(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "asked"
    log.mkdir()

    def ask(places):
        (log / f"{len(list(log.iterdir()))}-{places[0]}").write_text(repr(places))
        if any(x == 9.0 for x, _ in places):
            raise RuntimeError("service")
        return [None if y == 0.5 else x + y for x, y in places]

    def points(*rows):
        return spark.createDataFrame(rows, "i int, x double, y double, value2 int").coalesce(1)

    def run(df, **how):
        before = len(list(log.iterdir()))
        got = {r.i: (r.value, r.origin) for r in cache.read_through(df, path, cache.batched(ask, 1), lambda p: p.select("x", "y", F.when(F.col("x") == 2.0, 1.25).alias("value")), **how).collect()}
        return got, len(list(log.iterdir())) - before

    first = points((1, 1.0, 2.0, 0), (2, 1.000001, 2.0, 0), (3, 2.0, 0.5, 0), (4, 3.0, 0.5, 0), (5, None, 1.0, 0), (6, 9.0, 1.0, 0))
    want = {1: (3.0, "primary"), 2: (3.0, "primary"), 3: (1.25, "fallback"), 4: (None, "failed"), 5: (None, "none"), 6: (None, "failed")}
    assert run(first) == (want, 4)  # two points are one place
    assert run(first) == (want, 0)  # nothing is asked again
    got, asked = run(points((1, 1.0, 2.0, 0), (7, 4.0, 4.0, 0)))
    assert got == {1: (3.0, "primary"), 7: (8.0, "primary")} and asked == 1
    assert run(first, ask_failed_again=True) == (want, 2)
    assert cache.read_through(first.limit(0), path, cache.batched(ask)).collect() == []

from pyspark.sql import functions as F

from loomgraph.streaming import events as S

SCHEMA = "user_id long, event_id long, event_type string, ts timestamp"


def stream(spark, folder, batches):
    """A file stream with one file, and so one micro-batch, for each list of rows."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, s long").select("user_id", "event_id", "event_type", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_rate_limit_keeps_its_state_over_batches(spark, tmp_path):
    rows = [(u, 10 * i + u, "view", 1000 + 100 * i) for i in range(40) for u in (1, 2)]
    batches = [rows[:30], rows[30:34], rows[34:]]
    got = S.run_to_end(S.rate_limit_stream(stream(spark, tmp_path / "in", batches).withWatermark("ts", "1 hour"), "user_id", 3, 700_000_000), "append")
    at = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, s long").select("user_id", "event_id", (F.col("s") * 1_000_000).alias("at"))
    want = S.rate_limited(at, "user_id", 3, 700_000_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.filter("not accepted").count() > 0


def test_late_rows_are_left_out(spark, tmp_path):
    hour = 3600
    batches = [[(1, 1, "view", 10 * hour)], [(1, 2, "view", 20 * hour)], [(1, 3, "view", 21 * hour)], [(1, 4, "view", 10 * hour + 60), (1, 5, "view", 19 * hour + 1800), (1, 6, "view", 40 * hour)], [(1, 7, "view", 60 * hour)]]
    counts = S.window_counts(stream(spark, tmp_path / "in", batches).withColumn("value", F.lit(1.0)), "1 hour", late="1 hour")
    out = S.run_to_end(counts, "append").select((F.unix_timestamp("window.start") / hour).cast("int").alias("h"), "n").collect()
    # rows behind the watermark of the batch before (19 h) are dropped, as 10:01 is; 19:30 isn't; the last hour is still open
    assert {r.h: r.n for r in out} == {10: 1, 19: 1, 20: 1, 21: 1, 40: 1}


def test_route_to_sinks(spark, tmp_path):
    rows = [(1, i, kind, 1000 + i) for i, kind in enumerate(["view", "click", "purchase", "other", "signup", "view"])]
    got = {}

    def sink(name):
        return lambda batch, epoch: got.setdefault(name, []).extend(r.event_id for r in batch.collect())

    q = S.route_stream(stream(spark, tmp_path / "in", [rows[:3], rows[3:]]), {n: sink(n) for n in ("topic.read", "topic.billing")}, str(tmp_path / "c"))
    q.awaitTermination()
    assert {k: sorted(v) for k, v in got.items()} == {"topic.read": [0, 1, 5], "topic.billing": [2]}


def test_a_tee_goes_on_without_its_side_sink(spark, tmp_path):
    got, told = {"main": [], "side": []}, []

    def sink(name, fail_at=None):
        def take(batch, epoch):
            if epoch == fail_at:
                raise RuntimeError("service")
            got[name] += [r.event_id for r in batch.collect()]

        return take

    q = S.tee_stream(stream(spark, tmp_path / "in", [[(1, 1, "view", 1000)], [(1, 2, "view", 2000)], [(1, 3, "view", 3000)]]), sink("main"), sink("side", 1), str(tmp_path / "c"), lambda epoch, e: told.append((epoch, str(e))))
    q.awaitTermination()
    assert sorted(got["main"]) == [1, 2, 3] and len(got["side"]) == 2 and told == [(1, "service")]

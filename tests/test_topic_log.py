"""Topics that outlive restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import topic_log
from loomgraph.streaming import events as S
from tests.test_streams import stream


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    topic_log.register(spark)


def messages(spark, folder, batches):
    e = stream(spark, folder, batches)
    return e.select(S.topic(F.col("event_type")).alias("topic"), F.col("event_id").cast("string").alias("value"), "ts")


def write(spark, tmp_path, rows):
    s = messages(spark, tmp_path / "in", rows).writeStream.format("topic_log").option("path", str(tmp_path / "log")).option("topics", "topic.read,topic.billing").option("writer", "a")
    s.option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start().awaitTermination()


def read(spark, tmp_path, got, checkpoint="r", starting="earliest"):
    def keep(batch, epoch):
        got.extend((r.topic, r.value) for r in batch.collect())

    s = spark.readStream.format("topic_log").option("path", str(tmp_path / "log")).option("startingOffsets", starting).load()
    q = s.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / checkpoint)).start()
    q.processAllAvailable()
    q.stop()


KINDS = ["view", "click", "purchase", "other", "signup", "view"]


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    got = []
    write(spark, tmp_path, [[(1, i, k, 100 + i) for i, k in enumerate(KINDS)], [(1, 10, "view", 200)]])
    read(spark, tmp_path, got)
    assert sorted(got) == sorted([("topic.read", "0"), ("topic.read", "1"), ("topic.billing", "2"), ("topic.read", "5"), ("topic.read", "10")])  # unknown and unserved ones are dropped
    read(spark, tmp_path, got)
    assert len(got) == 5
    spark.createDataFrame([(1, 20, "click", 300)], "user_id long, event_id long, event_type string, s long").select("user_id", "event_id", "event_type", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    s = spark.readStream.schema("user_id long, event_id long, event_type string, ts timestamp").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    s = s.select(S.topic(F.col("event_type")).alias("topic"), F.col("event_id").cast("string").alias("value"), "ts")
    s.writeStream.format("topic_log").option("path", str(tmp_path / "log")).option("topics", "topic.read").option("checkpointLocation", str(tmp_path / "w")).option("writer", "a").trigger(availableNow=True).start().awaitTermination()
    read(spark, tmp_path, got)
    assert got[5:] == [("topic.read", "20")]
    late = []
    read(spark, tmp_path, late, "r2", "latest")
    assert late == []
    batch = spark.read.format("topic_log").option("path", str(tmp_path / "log")).option("topics", "topic.billing").load().collect()
    assert [(r.topic, r.value, r.ts) for r in batch] == [("topic.billing", "2", batch[0].ts)] and batch[0].ts.replace(tzinfo=dt.UTC).timestamp() == 102


def test_an_epoch_counts_once(tmp_path):
    w = topic_log._Writer(str(tmp_path), None, "a")
    stamp = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [("t", "x", stamp), ("u", None, None), (None, "y", stamp)]
    w.commit([w.write(iter(rows)), None], 0)
    w.commit([w.write(iter(rows))], 0)  # the same epoch after a failure
    w.commit([w.write(iter(rows[:1]))], 1)
    topic_log._Writer(str(tmp_path), None, "b").commit([w.write(iter(rows[:1]))], 0)  # another writer's
    lost = w.write(iter(rows))
    w.abort([lost], 2)
    assert topic_log._count(str(tmp_path)) == 3 and len(list((tmp_path / "data").iterdir())) == 4
    r = topic_log._Stream(str(tmp_path), None, "earliest")
    found = [m for p in r.partitions({"next": 0}, r.latestOffset()) for m in r.read(p)]
    assert sorted(found, key=str) == sorted([("t", "x", stamp), ("u", None, None), ("t", "x", stamp), ("t", "x", stamp)], key=str)


def test_an_empty_log(spark, tmp_path):
    assert spark.read.format("topic_log").option("path", str(tmp_path / "none")).load().collect() == []

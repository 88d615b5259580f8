"""Streaming operators; those that need no clock work on batches as well."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.session import shared_dir

# Event types and the topics they go to.
TOPICS = {"view": "topic.read", "click": "topic.read", "purchase": "topic.billing", "signup": "topic.users"}


def topic(event_type: Column, topics: dict[str, str] = TOPICS, unknown: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for kv in topics.items() for x in kv])
    return F.coalesce(F.element_at(table, event_type), F.lit(unknown))


def read_events(spark: SparkSession, sf_dir: str, per_trigger: int | None = None) -> DataFrame:
    """The event table as a file stream. Its timestamps carry no zone, so they are cast (UTC) for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is and read what it wrote from the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        # complete mode rewrites the whole result, append adds to it; a repeated epoch overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out" if mode == "complete" else f"{base}/out/epoch=*")


def sessions(events: DataFrame, key: str, ts: str, seq: str, text: str, gap_seconds: int) -> DataFrame:
    """Gap-flushed buffers: ``key, session, fragments, transcript`` in arrival order."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    late = F.col(ts) >= F.lag(ts).over(w) + F.expr(f"INTERVAL {gap_seconds} SECONDS")
    s = events.withColumn("brk", F.coalesce(late, F.lit(True)).cast("int")).withColumn("session", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ts, seq, text))), lambda x: x[text])
    return s.groupBy(key, "session").agg(F.count(F.lit(1)).alias("fragments"), F.array_join(ordered, " ").alias("transcript"))


def session_stream(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """The same by Spark's session windows, on a stream: ``session_window, key, fragments``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("fragments"))


def rate_limit_stream(events: DataFrame, key: str, most: int, window_us: int) -> DataFrame:
    """``rate_limited`` with state: of each key the stamps accepted within the window, dropped once the watermark has left them behind.

    Messages of a key are taken in the order of their stamps within a micro-batch.
    """
    kind = dict(events.dtypes)

    def run(who, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        p = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        out = []
        for at in p["at"]:
            kept = [x for x in kept if x > at - window_us]
            out.append(len(kept) < most)
            if out[-1]:
                kept.append(int(at))
        state.update((kept,))
        latest = max(state.getCurrentWatermarkMs(), max(kept, default=0) // 1000)
        state.setTimeoutTimestamp(int(latest + window_us // 1000 + 1))
        yield pd.DataFrame({key: who[0], "event_id": p["event_id"].to_numpy(), "accepted": out})

    rows = events.withColumn("at", F.unix_micros("ts")).select(key, "event_id", "at", "ts")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, event_id {kind['event_id']}, accepted boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def route_stream(events: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, topics: dict[str, str] = TOPICS):
    """Start a query that hands each micro-batch to the sinks of its topics; unknown types are dropped. A sink gets the batch and its number, by which a repeated batch can be told."""

    def hand_on(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        for name, sink in sinks.items():
            sink(kept.filter(F.col("topic") == name).drop("topic"), epoch)
        kept.unpersist()

    routed = events.withColumn("topic", topic(F.col("event_type"), topics)).filter(F.col("topic").isin(*sinks))
    return routed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(hand_on).start()


def tee_stream(events: DataFrame, main: Callable[[DataFrame, int], None], side: Callable[[DataFrame, int], None], checkpoint: str, failed: Callable[[int, Exception], None] = lambda epoch, e: None):
    """Start a query that hands each micro-batch whole to ``main`` and then to ``side``. If ``main`` fails the batch is repeated; if ``side`` does, ``failed`` is told and the stream goes on."""

    def hand_on(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            main(kept, epoch)
            try:
                side(kept, epoch)
            except Exception as e:  # noqa: BLE001 - whatever the side sink raises must not stop the stream
                failed(epoch, e)
        finally:
            kept.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(hand_on).start()


def rate_limited(messages: DataFrame, key: str, most: int, window_us: int) -> DataFrame:
    """``messages(key, event_id, at)`` with ``accepted``: fewer than ``most`` accepted ones within the window before. Acceptance depends on earlier acceptance, so each key is scanned in order, holding at most ``most`` stamps.

    Keys are spread by hash and sorted in their partitions; the scan streams
    over batches, so a key of any size needs no group in memory.
    """
    kind = dict(messages.dtypes)

    def run(batches):
        now, kept = None, []
        for p in batches:
            out = []
            for k, at in zip(p[key], p["at"]):
                if k != now:
                    now, kept = k, []
                kept = [x for x in kept if x > at - window_us]
                ok = len(kept) < most
                if ok:
                    kept.append(at)
                out.append(ok)
            yield pd.DataFrame({key: p[key], "event_id": p["event_id"], "accepted": out})

    ordered = messages.select(key, "event_id", "at").repartition(key).sortWithinPartitions(key, "at", "event_id")
    return ordered.mapInPandas(run, f"{key} {kind[key]}, event_id {kind['event_id']}, accepted boolean")

"""Event streams: routing, sessions, rate limits, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.registry import registry
from loomgraph.sources.tables import Tables
from loomgraph.streaming import events as S
from loomgraph.streaming import joins, timers

QUERIES, ORACLES, query = registry()


@query("""SELECT CASE event_type WHEN 'view' THEN 'topic.read' WHEN 'click' THEN 'topic.read' WHEN 'purchase' THEN 'topic.billing' WHEN 'signup' THEN 'topic.users' ELSE 'unknown' END AS topic, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def cdc_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to topics by type; unknown types to a bucket of their own."""
    e = Tables(spark, sf_dir).events.withColumn("topic", S.topic(F.col("event_type")))
    return e.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH g AS (SELECT *, (ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS fragments, string_agg(event_type, ' ' ORDER BY ts, event_id) AS transcript FROM s GROUP BY 1, 2""")
def session_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments less than the gap apart are one transcript, in order; a gap of the timeout itself flushes."""
    return S.sessions(Tables(spark, sf_dir).events, "user_id", "ts", "event_id", "event_type", 30 * 60)


@query("""WITH g AS (SELECT *, (ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS fragments FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a streaming query run to its end over the table."""
    s = S.run_to_end(S.session_stream(S.read_events(spark, sf_dir), "user_id", "30 minutes", "1 hour"), "complete")
    return s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "fragments")


@query()
def rate_limit_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages accepted under a sliding limit; rejected ones don't count."""
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return S.rate_limited(e, "user_id", most=3, window_us=6 * 3600 * 1_000_000)


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours by a streaming query run to its end over the table."""
    return S.run_to_end(S.window_counts(S.read_events(spark, sf_dir), "1 hour"), "complete").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("bucket"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT event_id, event_type FROM events GROUP BY ALL")
def stream_dedupe_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive again are dropped within the watermark."""
    e = S.read_events(spark, sf_dir)
    return S.run_to_end(e.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "append")


@query("""WITH b AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{bad' ELSE props END AS raw FROM events) SELECT json_valid(raw) AS valid, count(*) AS n, sum(CASE WHEN json_valid(raw) THEN (raw->>'k')::BIGINT END)::BIGINT AS total FROM b GROUP BY 1""")
def cdc_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed payloads go to the side; the rest is read on."""
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).otherwise(F.col("props"))
    e = Tables(spark, sf_dir).events.select(raw.alias("raw"))
    e = e.select(F.try_parse_json("raw").isNotNull().alias("valid"), F.get_json_object("raw", "$.k").cast("long").alias("k"))
    return e.groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("valid"), F.col("k"))).alias("total"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gen, count(*) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, gen, event_id, gen = last AS terminal, gen - coalesce(lag(gen) OVER (PARTITION BY user_id ORDER BY gen), 0) AS delta FROM p WHERE gen % 10 = 0 OR gen = last""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth state and the last one, with the number since the previous."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = Tables(spark, sf_dir).events.select("user_id", "event_id", F.row_number().over(w).alias("gen"), F.lead("event_id").over(w).isNull().alias("terminal")).filter("gen % 10 = 0 OR terminal")
    return p.withColumn("delta", F.col("gen") - F.coalesce(F.lag("gen").over(Window.partitionBy("user_id").orderBy("gen")), F.lit(0)))


@query("""SELECT conv_id, string_agg(turn || ':' || role, ' > ' ORDER BY turn) AS replay FROM conversations GROUP BY 1""")
def replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.concat(F.col("turn").cast("string"), F.lit(":"), "role")
    return Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", step.alias("s")))), lambda x: x["s"]), " > ").alias("replay"))


@query("""WITH c AS (SELECT user_id, event_id AS click, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id AS purchase, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTES AS mark),
j AS (SELECT c.user_id, click, purchase, c.ts FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOURS)
SELECT user_id, click, purchase FROM j, m WHERE purchase IS NOT NULL OR ts + INTERVAL 2 HOURS < mark""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the same user's purchases of the next two hours, by a join of two streams; clicks without any come out once their time is over, those of the last hours are still open."""
    of = lambda kind, name, ts: S.read_events(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(ts))
    joined = joins.interval_join(of("click", "click", "clicked"), of("purchase", "purchase", "bought"), "user_id", "clicked", "bought", "0 SECONDS", "2 HOURS", "10 minutes", "leftOuter")
    return S.run_to_end(joined.select("user_id", "click", "purchase"), "append")


@query("""WITH g AS (SELECT *, (ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
t AS (SELECT user_id, session::BIGINT AS session, count(*) AS fragments, string_agg(event_type, ' ' ORDER BY ts, event_id) AS transcript, max(ts) AS last FROM s GROUP BY 1, 2)
SELECT user_id, session, fragments, transcript FROM t WHERE session < (SELECT max(session) FROM t u WHERE u.user_id = t.user_id) OR last + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def stream_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts of ``session_buffer`` by a stream with state and timers; buffers whose time-out the watermark hasn't reached stay open."""
    stream = timers.transcript_stream(S.read_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", 30 * 60, "10 minutes")
    return timers.run_with_timers(stream, S.run_to_end)


@query()
def token_limit_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event of a user may go under a limit of 300 units in six hours, first come first served."""
    e = Tables(spark, sf_dir).events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("tokens", F.ceil("value"))
    found = timers.token_limited(e, "user_id", "ts", "event_id", "tokens", 300, 6 * 3600)
    return found.select("user_id", F.col("id").alias("event_id"), (F.col("released") - F.col("at")).alias("waited_ms"))

"""Credits, usage and billing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import ledger
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()


@query("""SELECT c_custkey AS user_id, round(coalesce(sum(value) FILTER (WHERE event_type <> 'error'), 0), 2) AS balance, count(DISTINCT event_type) AS channels FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""")
def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances over live records, nothing counting as zero."""
    t = Tables(spark, sf_dir)
    e = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.sum(F.when(F.col("event_type") != "error", F.col("value"))).alias("b"), F.countDistinct("event_type").alias("c"))
    j = t.customer.select("c_custkey").join(e, "c_custkey", "left")
    return j.select(F.col("c_custkey").alias("user_id"), F.round(F.coalesce("b", F.lit(0.0)), 2).alias("balance"), F.coalesce("c", F.lit(0)).alias("channels"))


@query("""WITH c AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY (event_type <> 'signup')::INT, ts, event_id) AS cum FROM events WHERE event_type <> 'error')
SELECT user_id, event_id, round(greatest(0, least(value, 500 - (cum - value))), 4) AS used FROM c WHERE greatest(0, least(value, 500 - (cum - value))) > 0""")
def ledger_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An amount of 500 taken from each user's credits: daily ones first, then by expiry."""
    e = Tables(spark, sf_dir).events.filter("event_type <> 'error'")
    credits = e.select("user_id", "event_id", F.col("value").alias("balance"), F.struct((F.col("event_type") != "signup").cast("int").alias("late"), "ts", "event_id").alias("priority"))
    return ledger.consume(credits, F.lit(500.0)).select("user_id", "event_id", F.round("used", 4).alias("used"))


@query("""SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 2) AS views, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 2) AS clicks, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 2) AS purchases FROM events GROUP BY 1""")
def usage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).events.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.sum("value"))
    return p.select("user_id", *[F.round(F.coalesce(c, F.lit(0.0)), 2).alias(a) for c, a in (("view", "views"), ("click", "clicks"), ("purchase", "purchases"))])


@query("""WITH u AS (SELECT user_id, date_trunc('month', ts) AS m, count(*) AS qty FROM events GROUP BY 1, 2), t(lo, hi, price) AS (VALUES (0, 5, 10.0), (5, 20, 8.0), (20, 1000000000, 5.0))
SELECT user_id, strftime(m, '%Y-%m') AS month, qty, sum(greatest(0, least(qty, hi) - lo) * price)::DOUBLE AS tiered, (qty * max(CASE WHEN qty >= lo AND qty < hi THEN price ELSE 0 END))::DOUBLE AS volume FROM u CROSS JOIN t GROUP BY user_id, m, qty""")
def tiered_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiered price (each tier for its part) and volume price (the tier reached, for all), per user and month."""
    u = Tables(spark, sf_dir).events.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("qty"))
    tiers = ((0, 5, 10.0), (5, 20, 8.0), (20, 1_000_000_000, 5.0))
    return u.select("user_id", "month", "qty", ledger.tiered_price(F.col("qty"), tiers).alias("tiered"), ledger.volume_price(F.col("qty"), tiers).alias("volume"))

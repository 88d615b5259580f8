"""Filters, aggregates, sorts, sets and mutations over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.registry import registry
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()


@query("""SELECT source, count(*) AS docs, count(l.doc_id) AS labelled, round(100.0 * count(l.doc_id) / count(*), 4) AS pct, round(100.0 * sum((coalesce(quality, 0) = 1)::INT) / count(*), 4) AS good_pct
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    j = t.documents.select("doc_id", "source").join(t.labels.withColumn("l", F.lit(1)), "doc_id", "left")
    n = F.count(F.lit(1))
    return j.groupBy("source").agg(n.alias("docs"), F.count("l").alias("labelled"), F.round(F.count("l") * 100.0 / n, 4).alias("pct"), F.round(F.count_if(F.col("quality") == 1) * 100.0 / n, 4).alias("good_pct"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events WHERE value > 10 GROUP BY 1")
def execution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.filter("value > 10")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.round(f("value"), 4).alias(a) for f, a in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"))])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS GROUP BY 1")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of the data; the bound is one value, taken from the column's statistics."""
    t = Tables(spark, sf_dir)
    last = t.events.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    return t.events.join(F.broadcast(last), F.col("ts") > F.col("since")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT conv_id, turn, role, length(text) AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return Tables(spark, sf_dir).conversations.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("conv_id", "turn", "role", F.length("text").alias("size"))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, arg_max(role, turn) AS last_role, round(avg(length(text)), 4) AS mean_size FROM conversations GROUP BY 1")
def turn_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.round(F.avg(F.length("text")), 4).alias("mean_size")
    )


@query("""SELECT o_orderkey, o_orderpriority, date_diff('hour', o_orderdate, TIMESTAMP '1999-01-01') AS hours_left, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, hours_left, o_orderkey LIMIT 100""")
def pending_by_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tasks by priority and whole hours left, the first hundred."""
    t = Tables(spark, sf_dir)
    hours = F.expr("timestampdiff(HOUR, o_orderdate, TIMESTAMP_NTZ '1999-01-01')")
    o = t.orders.filter("o_orderstatus = 'O'").withColumn("hours_left", hours).orderBy("o_orderpriority", "hours_left", "o_orderkey").limit(100)
    return o.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderpriority", "hours_left", "c_name")


@query("""SELECT 'orders without customer' AS name, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS actual, 0::BIGINT AS expected
UNION ALL SELECT 'duplicate order keys', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)), 0
UNION ALL SELECT 'negative discount', (SELECT count(*) FROM lineitem WHERE l_discount < 0), 0
UNION ALL SELECT 'regions', (SELECT count(*) FROM region), 5""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared checks as rows: name, actual and expected count."""
    t = Tables(spark, sf_dir)
    checks = (
        ("orders without customer", t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), 0),
        ("duplicate order keys", t.orders.groupBy("o_orderkey").count().filter("count > 1"), 0),
        ("negative discount", t.lineitem.filter("l_discount < 0"), 0),
        ("regions", t.region, 5),
    )
    out = None
    for name, df, expected in checks:
        row = df.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("name"), "actual", F.lit(expected).cast("long").alias("expected"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT n_regionkey, n_name, grouping(n_regionkey) AS g1, grouping(n_name) AS g2, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)""")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_name").agg(F.grouping("n_regionkey").alias("g1"), F.grouping("n_name").alias("g2"), F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("balance"))


@query("""SELECT c_custkey AS k, 'both' AS side FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders UNION ALL (SELECT c_custkey, 'customer' FROM customer EXCEPT SELECT o_custkey, 'customer' FROM orders)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c, o = t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    return c.intersect(o).withColumn("side", F.lit("both")).unionByName(c.subtract(o).withColumn("side", F.lit("customer")))


@query("""SELECT p_partkey FROM part WHERE contains(p_type, 'STEEL') OR starts_with(p_name, 'a') OR ends_with(p_brand, '5') OR lower(p_name) LIKE '%green%' OR regexp_matches(p_name, '(?i)blue$')""")
def pattern_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    keep = F.contains("p_type", F.lit("STEEL")) | name.startswith("a") | F.col("p_brand").endswith("5") | F.lower(name).like("%green%") | name.rlike("(?i)blue$")
    return Tables(spark, sf_dir).part.filter(keep).select("p_partkey")


@query("""SELECT s_suppkey, s_name, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS parts FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 30)""")
def association_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a qualifying association, and the count of all of theirs: one grouped pass over the association table."""
    t = Tables(spark, sf_dir)
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_partkey").alias("parts"), F.max("l_quantity").alias("q")).filter("q > 30")
    return t.supplier.join(g, "s_suppkey").select("s_suppkey", "s_name", "parts")


@query("""WITH i AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*) AS orders, string_agg(o_orderkey || '(' || coalesce(items, '') || ')', ';' ORDER BY o_orderkey) AS nested FROM orders LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered nested lists: items within orders within customers."""
    t = Tables(spark, sf_dir)
    item = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("s")))), lambda x: x["s"]), ",").alias("items"))
    one = F.concat(F.col("o_orderkey").cast("string"), F.lit("("), F.coalesce("items", F.lit("")), F.lit(")"))
    o = t.orders.join(items, "o_orderkey", "left").select("o_custkey", "o_orderkey", one.alias("s"))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "s"))), lambda x: x["s"]), ";").alias("nested"))


@query("""WITH o AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT n, count(*) AS orders, round(avg(q), 4) AS mean_quantity, max(q) AS most FROM o GROUP BY n""")
def aggregate_of_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return o.groupBy("n").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("q"), 4).alias("mean_quantity"), F.max("q").alias("most"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, nullif(o_totalprice, 0) DESC NULLS LAST, regexp_extract(o_orderpriority, '[0-9]+')::INT, o_orderkey DESC) AS pos FROM orders""")
def custom_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place by a custom rank, a descending value with nulls last, a numeric part of a string, and id descending."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    w = Window.partitionBy("o_orderpriority").orderBy(rank, F.nullif(F.col("o_totalprice"), F.lit(0.0)).desc_nulls_last(), F.regexp_extract("o_orderpriority", "[0-9]+", 0).try_cast("int"), F.desc("o_orderkey"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.row_number().over(w).alias("pos"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'READ' WHEN 'purchase' THEN 'WRITE' ELSE upper(event_type) END AS relation, CASE WHEN value > 100 THEN 'STRONG' ELSE 'GENERAL' END AS semantic_type FROM events""")
def rename_by_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation types renamed by a mapping table; unmapped ones in upper case."""
    m = spark.createDataFrame([("view", "READ"), ("click", "READ"), ("purchase", "WRITE")], "event_type string, relation string")
    j = Tables(spark, sf_dir).events.join(F.broadcast(m), "event_type", "left")
    return j.select("event_id", F.coalesce("relation", F.upper("event_type")).alias("relation"), F.when(F.col("value") > 100, "STRONG").otherwise("GENERAL").alias("semantic_type"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1 AS preferred, value < 5 AS deleted FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS""")
def ttl_and_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired rows go; one preferred row per user, all others reset; small ones soft-deleted."""
    t = Tables(spark, sf_dir)
    last = t.events.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("since"))
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = t.events.join(F.broadcast(last), F.col("ts") >= F.col("since"))
    return e.select("event_id", "user_id", (F.row_number().over(w) == 1).alias("preferred"), (F.col("value") < 5).alias("deleted"))


@query("""WITH m AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1)
SELECT p_partkey, round(CASE WHEN hi = lo THEN 0.5 ELSE (p_retailprice - (lo - 0.05 * (hi - lo))) / (1.1 * (hi - lo)) END, 6) AS scaled FROM part JOIN m USING (p_brand)""")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max scaling per group with five per cent of room at both ends."""
    p = Tables(spark, sf_dir).part
    m = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return p.join(m, "p_brand").select("p_partkey", F.round(F.when(span == 0, 0.5).otherwise((F.col("p_retailprice") - (F.col("lo") - 0.05 * span)) / (1.1 * span)), 6).alias("scaled"))


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, list_sort(json_keys(props)) AS names, to_json({'id': event_id, 'type': event_type})::VARCHAR AS packed FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sort_array(F.json_object_keys("props")).alias("names"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("packed"))


@query("""WITH n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, max(value) AS peak, count(*) AS n FROM events GROUP BY 1)
SELECT coalesce(c_custkey, user_id) AS id, coalesce(latest, 'none') AS latest, coalesce(peak, 0) AS peak, coalesce(n, 0) AS updates, c_custkey IS NULL AS created FROM customer FULL JOIN n ON user_id = c_custkey""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert: new keys are created, known ones take the newest values, others stay."""
    t = Tables(spark, sf_dir)
    n = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
    j = t.customer.select("c_custkey").join(n, F.col("c_custkey") == F.col("user_id"), "full")
    return j.select(
        F.coalesce("c_custkey", "user_id").alias("id"), F.coalesce("latest", F.lit("none")).alias("latest"), F.coalesce("peak", F.lit(0.0)).alias("peak"), F.coalesce("n", F.lit(0)).alias("updates"), F.col("c_custkey").isNull().alias("created"),
    )


@query("SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (3, 7, 11) GROUP BY ALL")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a label by equal properties, with what hangs on them; the keys reach the scan."""
    t = Tables(spark, sf_dir)
    found = t.customer.filter((F.col("c_mktsegment") == "BUILDING") & F.col("c_nationkey").isin(3, 7, 11)).select("c_custkey", "c_name", "c_mktsegment")
    return found.join(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left").groupBy("c_custkey", "c_name", "c_mktsegment").agg(F.count("o_orderkey").alias("orders"))

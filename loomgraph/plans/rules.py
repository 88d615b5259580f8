"""Regulation rules, overlays, limits, datum and other lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import site
from loomgraph.functions.text import half_up_spaces
from loomgraph.operators import spatial
from loomgraph.plans.registry import registry
from loomgraph.session import shared_dir
from loomgraph.sources import cache
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()


@query("""WITH m AS (SELECT p_brand, p_type, min(p_partkey) AS pos FROM part GROUP BY 1, 2)
SELECT p.p_brand AS parcel, min(p_retailprice) AS coverage_limit, max(p_size) AS setback, bool_or(p_size > 40) AS needs_cutoff, (SELECT string_agg(p_type, '; ' ORDER BY pos) FROM m WHERE m.p_brand = p.p_brand) AS articles,
arg_min(p_name, p_partkey) AS first_rule FROM part p GROUP BY p.p_brand""")
def strictest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several zones on a parcel: least limit, largest setback, any requirement, articles in order without repeats, the first zone's rules."""
    p = Tables(spark, sf_dir).part
    art = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("pos")).groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p_type"))), lambda x: x["p_type"]), "; ").alias("articles"))
    g = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("coverage_limit"), F.max("p_size").alias("setback"), F.bool_or(F.col("p_size") > 40).alias("needs_cutoff"), F.min_by("p_name", "p_partkey").alias("first_rule"))
    return g.join(art, "p_brand").withColumnRenamed("p_brand", "parcel")


_OVERLAY = "(VALUES ('ECO', 'light'), ('ECONOMY', 'medium'), ('STEEL', 'heavy'), ('A', 'any'), ('BRASS', 'noise'), ('STANDARD', 'core'))"


@query(f"""WITH o(key, rule) AS {_OVERLAY}, m AS (SELECT p_partkey, key, rule, row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC, key) AS r FROM part JOIN o ON contains(p_type, key))
SELECT p_partkey, key, rule FROM m WHERE r = 1""")
def overlay_longest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest overlay key within a name wins. The keys are six fixed rows."""
    o = spark.createDataFrame([("ECO", "light"), ("ECONOMY", "medium"), ("STEEL", "heavy"), ("A", "any"), ("BRASS", "noise"), ("STANDARD", "core")], "key string, rule string")
    j = Tables(spark, sf_dir).part.select("p_partkey", "p_type").join(F.broadcast(o), F.contains("p_type", "key"))
    return j.groupBy("p_partkey").agg(F.min_by(F.struct("key", "rule"), F.struct(-F.length("key"), "key")).alias("b")).select("p_partkey", "b.key", "b.rule")


@query("""WITH o(k, bal, nm) AS (VALUES (3, 100.0, NULL), (7, NULL, 'renamed'), (500, 1.0, 'x'))
SELECT s_suppkey, coalesce(o.bal, s_acctbal) AS balance, coalesce(o.nm, s_name) AS name, o.k IS NOT NULL AS overridden FROM supplier LEFT JOIN o ON k = s_nationkey""")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override fields where present, base fields elsewhere."""
    o = spark.createDataFrame([(3, 100.0, None), (7, None, "renamed"), (500, 1.0, "x")], "s_nationkey int, bal double, nm string")
    j = Tables(spark, sf_dir).supplier.join(F.broadcast(o.withColumn("hit", F.lit(True))), "s_nationkey", "left")
    return j.select("s_suppkey", F.coalesce("bal", "s_acctbal").alias("balance"), F.coalesce("nm", "s_name").alias("name"), F.coalesce("hit", F.lit(False)).alias("overridden"))


@query("""WITH r(prefix, rule) AS (VALUES ('Customer#', 'national'), ('Customer#00000001', 'local'), ('Customer#000000012', 'district'), ('Customer#0000', 'province')),
m AS (SELECT c_custkey, rule, row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC, rule) AS n FROM customer JOIN r ON starts_with(c_name, prefix)) SELECT c_custkey, rule FROM m WHERE n = 1""")
def prefix_rule_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of the longest prefix."""
    r = spark.createDataFrame([("Customer#", "national"), ("Customer#00000001", "local"), ("Customer#000000012", "district"), ("Customer#0000", "province")], "prefix string, rule string")
    j = Tables(spark, sf_dir).customer.select("c_custkey", "c_name").join(F.broadcast(r), F.startswith("c_name", "prefix"))
    return j.groupBy("c_custkey").agg(F.min_by("rule", F.struct(-F.length("prefix"), "rule")).alias("rule"))


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_retailprice / 150 WHEN p_size <= 30 THEN 1 + (p_retailprice - 50) / 100 ELSE p_retailprice / 67 END AS x FROM part),
s AS (SELECT p_partkey, CASE WHEN x < 1 THEN 0 ELSE floor(x + 0.5) END::BIGINT AS spaces FROM v)
SELECT p_partkey, spaces, CASE WHEN spaces >= 10 THEN ceil(spaces * 2 / 100.0) ELSE 0 END::BIGINT AS accessible_min, CASE WHEN spaces >= 10 THEN ceil(spaces * 4 / 100.0) ELSE 0 END::BIGINT AS accessible_max FROM s""")
def piecewise_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required spaces by class of use, rounded half up (below one: none), and the accessible share of two to four per cent from ten on."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    x = F.when(size <= 10, price / 150).when(size <= 30, 1 + (price - 50) / 100).otherwise(price / 67)
    s = Tables(spark, sf_dir).part.select("p_partkey", half_up_spaces(x).alias("spaces"))

    def share(pct: int) -> Column:
        return F.when(F.col("spaces") >= 10, F.ceil(F.col("spaces") * pct / 100)).otherwise(0).cast("long")

    return s.select("p_partkey", "spaces", share(2).alias("accessible_min"), share(4).alias("accessible_max"))


@query("""SELECT l_orderkey, ceil(greatest(round(sum(l_quantity) / 75, 6), count(*) * 0.7))::BIGINT AS required FROM lineitem GROUP BY 1""")
def schedule_max_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of an area ratio and a household minimum, rounded up."""
    need = F.greatest(F.round(F.sum("l_quantity") / 75, 6), F.count(F.lit(1)) * F.lit(0.7))
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.ceil(need).cast("long").alias("required"))


_LIMITS = (("quantity", "l_quantity", 45.0), ("discount", "l_discount", 0.08), ("tax", "l_tax", 0.07))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'quantity' AS type, l_quantity AS v, 45.0 AS lim FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'discount', l_discount, 0.08 FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'tax', l_tax, 0.07 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, type, v AS value, CASE WHEN v > lim * 1.2 THEN 3 WHEN v > lim * 1.1 THEN 2 ELSE 1 END AS severity FROM u WHERE v > lim""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values over their limits, with severity bands at 10 and 20 per cent; an array per row, no extra scan."""
    each = F.array(*[F.struct(F.lit(n).alias("type"), F.col(c).alias("value"), F.lit(x).alias("lim")) for n, c, x in _LIMITS])
    over = F.explode(F.filter(each, lambda v: v["value"] > v["lim"])).alias("v")
    d = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", over)
    severity = F.when(F.col("v.value") > F.col("v.lim") * 1.2, 3).when(F.col("v.value") > F.col("v.lim") * 1.1, 2).otherwise(1)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v.type", "v.value", severity.alias("severity"))


@query("""WITH s AS (SELECT user_id, value, event_id, epoch(ts) AS x, lead(epoch(ts)) OVER w AS nx, lag(epoch(ts)) OVER w AS px, lag(value) OVER w AS pv, lead(value) OVER w AS nv, first_value(value) OVER w AS fv,
last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, (coalesce(nx, x) - coalesce(px, x)) / 2 AS wt, list_sort([coalesce(pv, lv), value, coalesce(nv, fv)])[2] AS med FROM s)
SELECT user_id, round(sum(value * event_id) / sum(event_id), 4) AS weighted, round(coalesce(sum(value * wt) / nullif(sum(wt), 0), 0), 4) AS trapezoid, round(avg(med), 4) AS median_mean FROM m GROUP BY user_id""")
def weighted_datum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-weighted mean, trapezoid mean along a line, and a circular median of three."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = Tables(spark, sf_dir).events.withColumn("x", x)
    before, after = F.coalesce(F.lag("value").over(w), F.last("value").over(whole)), F.coalesce(F.lead("value").over(w), F.first("value").over(whole))
    e = e.withColumns({"wt": (F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))) / 2, "med": F.sort_array(F.array(before, F.col("value"), after))[1]})
    trapezoid = F.coalesce(F.sum(F.col("value") * F.col("wt")) / F.nullif(F.sum("wt"), F.lit(0.0)), F.lit(0.0))
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("event_id")) / F.sum("event_id"), 4).alias("weighted"), F.round(trapezoid, 4).alias("trapezoid"), F.round(F.avg("med"), 4).alias("median_mean"))


@query("""WITH s AS (SELECT user_id, event_id, least(value, nv) AS lo, greatest(value, nv) AS hi FROM (SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nv FROM events) WHERE nv IS NOT NULL)
SELECT user_id, b AS band, count(*) AS segments, round(sum(least(hi, (b + 1) * 30.0) - greatest(lo, b * 30.0)), 4) AS covered FROM s, range(floor(lo / 30)::BIGINT, floor(hi / 30)::BIGINT + 1) AS r(b) GROUP BY 1, 2""")
def elevation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut into bands of fixed height, with the covered part of each band."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = Tables(spark, sf_dir).events.withColumn("nv", F.lead("value").over(w)).filter("nv IS NOT NULL").select("user_id", F.least("value", "nv").alias("lo"), F.greatest("value", "nv").alias("hi"))
    b = s.withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / 30), F.floor(F.col("hi") / 30))))
    part = F.least("hi", (F.col("band") + 1) * 30.0) - F.greatest("lo", F.col("band") * 30.0)
    return b.groupBy("user_id", "band").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(part), 4).alias("covered"))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'structure' WHEN contains(p_type, 'BRASS') THEN 'finish' WHEN contains(p_type, 'TIN') THEN 'roof' ELSE 'other' END AS use_class,
[x FOR x IN [CASE WHEN p_size > 10 THEN 'fire' END, CASE WHEN p_size > 25 THEN 'lift' END, CASE WHEN p_retailprice > 1200 THEN 'audit' END, 'base'] IF x IS NOT NULL] AS items FROM part""")
def extended_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class by ordered substring tests; items that depend on scale or always hold."""
    kind = F.when(F.contains("p_type", F.lit("STEEL")), "structure").when(F.contains("p_type", F.lit("BRASS")), "finish").when(F.contains("p_type", F.lit("TIN")), "roof").otherwise("other")
    items = F.array_compact(F.array(F.when(F.col("p_size") > 10, "fire"), F.when(F.col("p_size") > 25, "lift"), F.when(F.col("p_retailprice") > 1200, "audit"), F.lit("base")))
    return Tables(spark, sf_dir).part.select("p_partkey", kind.alias("use_class"), items.alias("items"))


_SITES = """s AS (SELECT user_id, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM events GROUP BY 1),
x AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 3.0 END AS pilotis, CASE WHEN user_id % 4 > 0 THEN (m - 50) / 10 END AS above, (hi - lo) / (1 + user_id % 60) AS span,
  CASE WHEN user_id % 3 > 0 THEN lo + user_id % 7 * 10 END AS road, (hi - m) / 100 AS road_span, CASE WHEN user_id % 5 = 0 THEN hi END AS neighbour FROM s)"""


@query(f"""WITH {_SITES}, h AS (SELECT *, greatest(0, (hi - lo) / 4 - coalesce(pilotis, 0) - coalesce(above, 0) * CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 1 END) AS height FROM x),
d AS (SELECT *, CASE WHEN user_id % 10 = 0 AND neighbour IS NOT NULL THEN 'neighbor_avg_86' WHEN user_id % 2 = 0 AND road IS NOT NULL AND m > road + 0.1 THEN 'site_above_road'
  WHEN user_id % 2 = 0 AND road IS NOT NULL AND road_span >= 0.5 THEN 'road_sloped' WHEN user_id % 2 = 0 AND road IS NOT NULL THEN 'road_flat' WHEN span < 0.5 THEN 'flat' WHEN span <= 3 THEN 'slope_le3m' ELSE 'slope_gt3m' END AS datum_case FROM h)
SELECT user_id, round(height + 1e-9, 4) AS height, round(CASE WHEN height <= 10 THEN 1.5 ELSE height * 0.5 END + 1e-9, 4) AS setback, datum_case,
round(1e-9 + CASE datum_case WHEN 'neighbor_avg_86' THEN (m + neighbour) / 2 WHEN 'site_above_road' THEN (m + road) / 2 WHEN 'road_sloped' THEN road WHEN 'road_flat' THEN road ELSE m END, 4) AS elevation FROM d""")
def height_and_datum_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective height with its sunlight setback, and the datum by seven cases in order, over sites made from the values of a user."""
    u = F.col("user_id")
    x = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"))
    span = F.col("hi") - F.col("lo")
    height = site.effective_height(span / 4, F.when(u % 3 == 0, 3.0), F.when(u % 4 > 0, (F.col("m") - 50) / 10), u % 2 == 0)
    road, neighbour = F.when(u % 3 > 0, F.col("lo") + u % 7 * 10), F.when(u % 5 == 0, F.col("hi"))
    found = site.datum(F.col("m"), span / (1 + u % 60), road, (F.col("hi") - F.col("m")) / 100, neighbour, u % 10 == 0, u % 2 == 0)
    x = x.withColumns({"h": height, "d": found})
    rounded = lambda c: F.round(c + 1e-9, 4)  # noqa: E731  a mean's last bit depends on the order of its rows, so halves are moved off the edge
    return x.select("user_id", rounded(F.col("h")).alias("height"), rounded(site.sunlight_setback(F.col("h"))).alias("setback"), F.col("d.case").alias("datum_case"), rounded(F.col("d.elevation")).alias("elevation"))


#: Building types by part key, for the rules that read them.
BUILDINGS = ("단독주택", "다세대주택", "제1종근린생활시설", "업무시설", "위락시설", "창고시설", "공장", "숙박시설", "오피스텔", "제2종 무엇", "교정시설", "", "판매 및 위락", "운동시설")
_BUILDING = "[" + ", ".join(f"'{x}'" for x in BUILDINGS) + f"][p_partkey % {len(BUILDINGS)} + 1]"


@query(f"""WITH b AS (SELECT p_partkey, {_BUILDING} AS kind FROM part)
SELECT p_partkey, CASE WHEN kind = '' THEN NULL WHEN kind LIKE '%위락%' THEN 1 WHEN regexp_matches(kind, '근린생활|생활시설|숙박') THEN 3 WHEN regexp_matches(kind, '단독|다가구') THEN 4
WHEN regexp_matches(kind, '공동주택|아파트|연립|다세대|오피스텔') THEN 5 WHEN kind LIKE '%창고%' THEN 8 WHEN regexp_matches(kind, '공장|수련') THEN 7
WHEN regexp_matches(kind, '판매|업무|의료|문화|종교|운동|운수|방송|장례') THEN 2 WHEN regexp_matches(kind, '제1종|제2종') THEN 3 ELSE 11 END AS parking_row FROM b""")
def use_class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row of the parking table for each building type; the first word met in order wins."""
    kind = F.element_at(F.array(*[F.lit(x) for x in BUILDINGS]), (F.col("p_partkey") % len(BUILDINGS) + 1).cast("int"))
    return Tables(spark, sf_dir).part.select("p_partkey", site.use_class(kind).alias("parking_row"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN p_size % 12 END AS n, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice % 20 END AS w, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sep FROM part)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'needs_required_count' ELSE 'evaluated' END AS status, coalesce(w < 12 AND NOT sep AND coalesce(n <= 8, true), false) AS road_as_aisle,
coalesce(w >= 12 AND coalesce(sep, true) AND coalesce(n <= 5, true), false) AS perpendicular, coalesce(n <= 5, true) AS tandem FROM x""")
def small_lot_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a small attached lot may do: count the road as its aisle, park across it, or park in tandem."""
    k = F.col("p_partkey")
    found = site.small_lot_relief(F.when(k % 10 > 0, F.col("p_size") % 12), F.when(k % 9 > 0, F.col("p_retailprice") % 20), F.when(k % 3 == 0, True).when(k % 3 == 1, False))
    return Tables(spark, sf_dir).part.select("p_partkey", found.alias("x")).select("p_partkey", "x.*")


@query("""WITH w AS (SELECT p_brand, max(p_size) AS worst FROM part GROUP BY 1) SELECT p_partkey, round(CASE WHEN worst > 45 THEN p_retailprice * 0.95 ELSE p_retailprice * 1.05 END, 4) AS limit_after FROM part JOIN w USING (p_brand)""")
def tighten_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits five per cent tighter where the worst of the group violates, looser elsewhere."""
    p = Tables(spark, sf_dir).part
    worst = p.groupBy("p_brand").agg(F.max("p_size").alias("worst"))
    return p.join(worst, "p_brand").select("p_partkey", F.round(F.when(F.col("worst") > 45, F.col("p_retailprice") * 0.95).otherwise(F.col("p_retailprice") * 1.05), 4).alias("limit_after"))


@query("""SELECT s_suppkey, [x FOR x IN [CASE WHEN s_acctbal < 0 THEN 'balance' END, CASE WHEN s_nationkey % 5 = 0 THEN 'zone' END, CASE WHEN s_suppkey % 7 = 0 THEN 'review' END] IF x IS NOT NULL] AS restrictions,
s_acctbal >= 0 AND s_nationkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS all_pass FROM supplier""")
def restriction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.array_compact(F.array(F.when(F.col("s_acctbal") < 0, "balance"), F.when(F.col("s_nationkey") % 5 == 0, "zone"), F.when(F.col("s_suppkey") % 7 == 0, "review")))
    return Tables(spark, sf_dir).supplier.select("s_suppkey", r.alias("restrictions")).withColumn("all_pass", F.size("restrictions") == 0)


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 5000 THEN s_acctbal END, c.bal, 0.0) AS value, CASE WHEN s_acctbal > 5000 THEN 'primary' WHEN c.bal IS NOT NULL THEN 'fallback' ELSE 'none' END AS origin
FROM supplier LEFT JOIN (SELECT c_nationkey, round(max(c_acctbal), 2) AS bal FROM customer GROUP BY 1) c ON c_nationkey = s_nationkey""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary provider, else the fallback, else zero, with a flag of which."""
    t = Tables(spark, sf_dir)
    fb = t.customer.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.round(F.max("c_acctbal"), 2).alias("bal"))
    first = F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal"))
    j = t.supplier.join(fb, "s_nationkey", "left")
    return j.select("s_suppkey", F.coalesce(first, "bal", F.lit(0.0)).alias("value"), F.when(first.isNotNull(), "primary").when(F.col("bal").isNotNull(), "fallback").otherwise("none").alias("origin"))


@query("""SELECT n_nationkey, i, j, round(n_nationkey + (i - 2) * 10.0 / 2, 4) AS x, round(n_regionkey + (j - 2) * 10.0 / 2, 4) AS y FROM nation, range(0, 5) AS a(i), range(0, 5) AS b(j)""")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of five by five around each centre."""
    g = Tables(spark, sf_dir).nation.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return g.select("n_nationkey", "i", "j", F.round(F.col("n_nationkey") + (F.col("i") - 2) * 10.0 / 2, 4).alias("x"), F.round(F.col("n_regionkey") + (F.col("j") - 2) * 10.0 / 2, 4).alias("y"))


@query("""SELECT l_partkey, arg_max(l_extendedprice, (l_shipdate, l_extendedprice)) AS latest_price, max(year(l_shipdate)) AS latest_year FROM lineitem GROUP BY 1""")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy("l_partkey").agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_extendedprice")).alias("latest_price"), F.max(F.year("l_shipdate")).cast("long").alias("latest_year"))


@query("""WITH p AS (SELECT s_suppkey, s_nationkey AS cell, s_suppkey % 17 AS x, s_suppkey % 13 AS y FROM supplier), l AS (SELECT c_custkey, c_nationkey AS cell, c_custkey % 11 AS x1, c_custkey % 7 AS y1, c_custkey % 19 AS x2, c_custkey % 23 AS y2 FROM customer),
d AS (SELECT s_suppkey, c_custkey, x, y, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))::DOUBLE / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t FROM p JOIN l USING (cell)),
e AS (SELECT s_suppkey, c_custkey, round(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), 6) AS dist FROM d)
SELECT s_suppkey, c_custkey AS line, dist FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY dist, c_custkey) AS r FROM e) WHERE r = 1 AND dist < 2""")
def nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest segment of each point's nation, if it is within two units: only what shares a cell of the grid is measured."""
    t = Tables(spark, sf_dir)
    p = t.supplier.select(F.col("s_suppkey").alias("point"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 17).alias("x"), (F.col("s_suppkey") % 13).alias("y"))
    return spatial.nearest_within(p, segments(t), 2.0, ("nation",)).filter("dist < 2").select(F.col("point").alias("s_suppkey"), "line", "dist")


def segments(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("line"), F.col("c_nationkey").alias("nation"), (k % 11).alias("x1"), (k % 7).alias("y1"), (k % 19).alias("x2"), (k % 23).alias("y2"))


@query("""WITH p AS (SELECT s_suppkey, s_acctbal / 100 AS x, s_suppkey * 7 % 90 AS y FROM supplier), l AS (SELECT c_custkey, c_custkey % 61 AS x1, c_custkey % 37 AS y1, c_custkey % 61 + c_custkey % 5 - 2 AS x2, c_custkey % 37 + c_custkey % 7 - 3 AS y2 FROM customer),
d AS (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))::DOUBLE / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t FROM p CROSS JOIN l),
e AS (SELECT s_suppkey, c_custkey, round(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), 6) AS dist FROM d)
SELECT s_suppkey, c_custkey AS line, dist FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY dist, c_custkey) AS r FROM e) WHERE r = 1""")
def nearest_line_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest segment of each point at whatever distance, by rings over ever coarser grids."""
    t = Tables(spark, sf_dir)
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    p = t.supplier.select(s.alias("point"), (F.col("s_acctbal") / 100).alias("x"), (s * 7 % 90).alias("y"))
    line = t.customer.select(k.alias("line"), (k % 61).alias("x1"), (k % 37).alias("y1"), (k % 61 + k % 5 - 2).alias("x2"), (k % 37 + k % 7 - 3).alias("y2"))
    return spatial.nearest(p, line).select(F.col("point").alias("s_suppkey"), "line", "dist")


@query("""WITH l AS (SELECT c_custkey AS line, c_nationkey AS nation, c_custkey % 11 AS x1, c_custkey % 7 AS y1, c_custkey % 19 AS x2, c_custkey % 23 AS y2 FROM customer),
e AS (SELECT line, nation, 1 AS nth, x1 AS x, y1 AS y FROM l UNION ALL SELECT line, nation, 2, x2, y2 FROM l),
d AS (SELECT e.line, e.nth, l.line AS other, x, y, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))::DOUBLE / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t FROM e JOIN l USING (nation)),
f AS (SELECT line, other, nth FROM d WHERE round(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), 6) <= 1.5)
SELECT line, other FROM f WHERE line <> other GROUP BY 1, 2 HAVING count(DISTINCT nth) = 2""")
def adjacent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a nation both of whose ends lie within 1.5 units of another one."""
    s = segments(Tables(spark, sf_dir))
    return spatial.adjacent(s, s, 1.5, ("nation",)).filter("line <> other").select("line", "other")


@query("""SELECT c_custkey, CASE WHEN kx % 10 = 3 AND ky % 2 = 0 THEN NULL WHEN kx % 10 = 3 THEN 7.0 ELSE (kx * 3 + ky)::DOUBLE END AS value,
CASE WHEN kx IS NULL THEN 'none' WHEN kx % 10 = 3 AND ky % 2 = 0 THEN 'failed' WHEN kx % 10 = 3 THEN 'fallback' ELSE 'primary' END AS origin
FROM (SELECT c_custkey, (c_custkey % 400 + 3)::BIGINT AS kx, round(c_acctbal)::BIGINT AS ky FROM customer)""")
def elevation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of places through a cache that half of them have filled before: each place is asked for once, a fallback tells some, some stay unknown."""
    t = Tables(spark, sf_dir)
    places = t.customer.select("c_custkey", ((F.col("c_custkey") % 400 + 3) / 100000).alias("x"), (F.round("c_acctbal") / 100000).alias("y"))
    odd = F.pmod(F.round(F.col("x") * 100000).cast("long"), F.lit(10)) == 3
    even = F.round(F.col("y") * 100000).cast("long") % 2 == 0
    primary = lambda p: p.select("x", "y", F.when(~odd, F.round(F.col("x") * 100000) * 3 + F.round(F.col("y") * 100000)).alias("value"))
    fallback = lambda p: p.select("x", "y", F.when(~even, 7.0).alias("value"))
    path = f"{shared_dir(spark)}/loom-elevations-{uuid.uuid4().hex}"
    cache.read_through(places.filter("c_custkey % 2 = 0"), path, primary, fallback)
    return cache.read_through(places, path, primary, fallback).select("c_custkey", "value", "origin")

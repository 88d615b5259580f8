"""Multi-objective evaluation, groups in sequence, fits and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.design import design_distance
from loomgraph.operators import design, pareto
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()
FRONT = """front AS (SELECT p_partkey, p_retailprice AS price, p_size AS size FROM part a WHERE NOT EXISTS
(SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size < a.p_size)))"""


def designs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))


@query(f"WITH {FRONT} SELECT * FROM front")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs that no other one dominates in price and size, both to be small; equal designs all stay."""
    return pareto.front_2d(designs(Tables(spark, sf_dir)), "price", "size")


@query()
def front_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every design with the number of its front."""
    return pareto.layers_2d(designs(Tables(spark, sf_dir)), "price", "size")


@query(f"""WITH {FRONT}, g AS (SELECT *, max(price) OVER () - min(price) OVER () AS rp, max(size) OVER () - min(size) OVER () AS rs FROM front),
d AS (SELECT p_partkey, (lead(price) OVER (ORDER BY price, p_partkey) - lag(price) OVER (ORDER BY price, p_partkey)) / nullif(rp, 0) AS a, (lead(size) OVER (ORDER BY size, p_partkey) - lag(size) OVER (ORDER BY size, p_partkey)) / nullif(rs, 0)::DOUBLE AS b FROM g)
SELECT p_partkey, round(a + b, 6) AS crowding FROM d""")
def crowding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the neighbours on the first front, scaled per objective; null stands for the infinite ends."""
    t = Tables(spark, sf_dir)
    return pareto.crowding(pareto.front_2d(designs(t), "price", "size"), "p_partkey", ("price", "size"))


@query(f"""WITH {FRONT}, p AS (SELECT price, min(size) AS size FROM front GROUP BY price), s AS (SELECT price, size, lag(size, 1, 60) OVER (ORDER BY price) AS prev FROM p)
SELECT round(sum(greatest(0, 3000 - price) * greatest(0, prev - size)), 4) AS hypervolume FROM s""")
def hypervolume_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area between the first front and the reference corner (3000, 60)."""
    return pareto.hypervolume_2d(pareto.front_2d(designs(Tables(spark, sf_dir)), "price", "size"), "price", "size", 3000.0, 60.0)


@query("""SELECT l_orderkey, round(sum(greatest(0, l_quantity - 40) / 40 + greatest(0, l_discount - 0.06) / 0.06), 5) AS penalty, bool_and(l_quantity <= 40 AND l_discount <= 0.06) AS feasible FROM lineitem GROUP BY 1""")
def penalty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations relative to their limits, summed; a value on its limit is feasible."""
    p = pareto.penalty({"l_quantity": 40.0, "l_discount": 0.06})
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.round(F.sum(p), 5).alias("penalty"), F.bool_and((F.col("l_quantity") <= 40) & (F.col("l_discount") <= 0.06)).alias("feasible"))


@query()
def farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts of each brand, each as far as can be from those before it by shape, measures, steps and family; the first is the dearest."""
    size = F.col("p_size").cast("double")
    p = Tables(spark, sf_dir).part.select(
        "p_brand", "p_partkey", "p_retailprice", F.array(F.lit(0.0), F.lit(0.0), size, (F.col("p_partkey") % 10 + 1).cast("double")).alias("box"),
        F.array(F.col("p_retailprice") / 2000, size / 50).alias("measures"), F.split("p_type", " ").alias("steps"), F.element_at(F.split("p_name", " "), 1).alias("family"),
    )
    return pareto.farthest_first(p, "p_brand", "p_partkey", 5, design_distance, "p_retailprice")


@query("""WITH e AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM e), s AS (SELECT user_id, grp::BIGINT AS grp, event_type, count(*) AS n, sum(value) AS v FROM g GROUP BY 1, 2, 3)
SELECT user_id, grp, event_type, n, round(sum(v) OVER (PARTITION BY user_id ORDER BY grp), 4) AS cumulative FROM s""")
def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal neighbours with a running total."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = Tables(spark, sf_dir).events.withColumn("brk", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int"))
    g = e.withColumn("grp", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "grp", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    run = Window.partitionBy("user_id").orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("user_id", "grp", "event_type", "n", F.round(F.sum("v").over(run), 4).alias("cumulative"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS cum FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(q, 100 - (cum - q)) AS filled FROM c WHERE 100 - (cum - q) >= 5""")
def fill_until_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors filled one by one up to a cap of 100; a remainder under 5 is dropped."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    left = 100 - F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0))
    c = Tables(spark, sf_dir).lineitem.withColumn("left", left).filter("left >= 5")
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.least("l_quantity", "left").alias("filled"))


@query("""SELECT doc_id, round((contains(lower(text), 'license')::INT + contains(lower(text), 'token')::INT + regexp_matches(text, '[0-9]{4}')::INT) / 3.0, 5) AS rate FROM documents""")
def relevance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.contains(F.lower("text"), F.lit("license")).cast("int") + F.contains(F.lower("text"), F.lit("token")).cast("int") + F.rlike("text", F.lit("[0-9]{4}")).cast("int")
    return Tables(spark, sf_dir).documents.select("doc_id", F.round(hits / 3.0, 5).alias("rate"))


@query("""WITH e AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT l_returnflag, avg(y) AS my FROM e GROUP BY 1)
SELECT l_returnflag, round(1 - sum((y - p) ** 2) / sum((y - my) ** 2), 5) AS r2, round(avg(abs(y - p)), 3) AS mae FROM e JOIN m USING (l_returnflag) GROUP BY 1""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 and mean absolute error of a price model; the deviations come from one pass of variances."""
    t = Tables(spark, sf_dir)
    e = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    err = F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")
    return e.groupBy("l_returnflag").agg(F.round(1 - F.sum(err * err) / (F.var_pop("l_extendedprice") * F.count(F.lit(1))), 5).alias("r2"), F.round(F.avg(F.abs(err)), 3).alias("mae"))


@query("""WITH s AS (SELECT l_orderkey, sum(l_quantity) AS far, count(*) AS floors, max(l_discount) AS cover FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, avg((q <= pq)::INT) AS monotone FROM
(SELECT l_orderkey, l_quantity AS q, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pq FROM lineitem) WHERE pq IS NOT NULL GROUP BY 1)
SELECT l_orderkey, round(0.62 * least(1, far / 150) + 0.38 * least(1, cover / 0.1), 5) AS capacity, round(coalesce(monotone, 1), 5) AS monotone, greatest(least(floors, 4), floor(far / 40))::BIGINT AS stalls FROM s LEFT JOIN m USING (l_orderkey)""")
def design_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted capacity, share of steps that do not grow, and a stall estimate."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = Tables(spark, sf_dir).lineitem.withColumn("step", (F.col("l_quantity") <= F.lag("l_quantity").over(w)).cast("int"))
    s = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("far"), F.count(F.lit(1)).alias("floors"), F.max("l_discount").alias("cover"), F.avg("step").alias("m"))
    return s.select(
        "l_orderkey", F.round(0.62 * F.least(F.lit(1.0), F.col("far") / 150) + 0.38 * F.least(F.lit(1.0), F.col("cover") / 0.1), 5).alias("capacity"),
        F.round(F.coalesce("m", F.lit(1.0)), 5).alias("monotone"), F.greatest(F.least("floors", F.lit(4)), F.floor(F.col("far") / 40)).cast("long").alias("stalls"),
    )


@query("""WITH c AS (SELECT DISTINCT p_size AS x, (p_partkey % 20)::INT AS y, p_brand AS room FROM part)
SELECT a.room AS room_a, b.room AS room_b, count(*) AS touching FROM c a JOIN c b ON ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) AND a.room <> b.room GROUP BY 1, 2""")
def cell_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cell sides two rooms share: each cell looks right and up, by an equi-join on the neighbour's place."""
    c = Tables(spark, sf_dir).part.select(F.col("p_size").alias("x"), (F.col("p_partkey") % 20).cast("int").alias("y"), F.col("p_brand").alias("room")).distinct()
    looks = c.select(F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), "y"), F.struct("x", (F.col("y") + 1).alias("y")))).alias("p"), F.col("room").alias("room_a")).select("p.x", "p.y", "room_a")
    j = looks.join(c.withColumnRenamed("room", "room_b"), ["x", "y"]).filter("room_a <> room_b")
    return j.groupBy("room_a", "room_b").agg(F.count(F.lit(1)).alias("touching"))


@query("""WITH s(strategy, share, per) AS (VALUES ('piloti_ground', 0.62::DOUBLE, 34.0::DOUBLE), ('basement', 0.75, 32), ('semi_basement', 0.75, 32), ('ground_surface', 0.85, 30), ('mixed', 0.7, 30), ('mechanical', 0, 30), ('unknown', 0, 30)),
e AS (SELECT p_partkey, p_retailprice / 20 AS long, p_size::DOUBLE AS short, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice / 20 * p_size * 0.9 END AS area FROM part),
c AS (SELECT p_partkey, strategy, CASE WHEN area > 0 THEN floor(short / 11) * floor(long / 2.5) ELSE 0 END AS single, CASE WHEN area > 0 THEN floor(short / 16) * 2 * floor(long / 2.5) ELSE 0 END AS double, CASE WHEN area > 0 THEN floor(area * share / per) ELSE 0 END AS held, area FROM e CROSS JOIN s)
SELECT p_partkey, strategy, single::BIGINT AS single, double::BIGINT AS double, held::BIGINT AS by_area, CASE WHEN strategy = 'mechanical' AND area > 0 THEN NULL ELSE least(greatest(single, double), held)::BIGINT END AS estimated FROM c""")
def stall_capacity_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces that the envelope of each design holds under every strategy."""
    names = F.explode(F.array(*[F.lit(n) for n in (*design.USABLE, "mechanical", "unknown")]))
    long = F.col("p_retailprice") / 20
    p = Tables(spark, sf_dir).part.select("p_partkey", long.alias("long"), F.col("p_size").cast("double").alias("short"), F.when(F.col("p_partkey") % 9 != 0, long * F.col("p_size") * 0.9).alias("area"), names.alias("strategy"))
    return p.select("p_partkey", "strategy", design.stall_capacity(*map(F.col, ("long", "short", "area", "strategy"))).alias("c")).select("p_partkey", "strategy", "c.*")


@query("""WITH d AS (SELECT p_partkey, p_retailprice - 800 AS site, p_size * 9.0::DOUBLE AS footprint, (p_size - 4) * 40.0::DOUBLE AS area, p_size % 8 AS floors, p_partkey % 2 = 0 AS housing FROM part),
c AS (SELECT *, footprint / 7 AS coverage FROM d)
SELECT p_partkey, CASE WHEN floors <= 0 OR area <= 0 THEN 'none' WHEN site > 0 AND site < 330 AND housing THEN 'piloti_ground,ground_surface,mechanical,semi_basement,basement,mixed'
WHEN coverage >= 55 OR (site > 0 AND greatest(site - footprint, 0) / site < 0.35) THEN 'piloti_ground,basement,mechanical,mixed' WHEN floors >= 5 THEN 'basement,piloti_ground,mixed,mechanical' ELSE 'ground_surface,piloti_ground,semi_basement,mixed' END AS candidates FROM c""")
def parking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parking strategies of each design, the chosen one first."""
    c = F.col
    p = Tables(spark, sf_dir).part.select("p_partkey", (c("p_retailprice") - 800).alias("site"), (c("p_size") * 9.0).alias("footprint"), ((c("p_size") - 4) * 40.0).alias("area"), (c("p_size") % 8).alias("floors"), (c("p_partkey") % 2 == 0).alias("housing"))
    found = design.parking_strategies(c("site"), c("footprint"), c("area"), c("floors"), c("footprint") / 7, c("housing"))
    return p.select("p_partkey", F.array_join(found, ",").alias("candidates"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS nth, min(l_partkey) OVER w % 7 AS status, min(l_suppkey) OVER w % 12 AS required, min(l_partkey) OVER w % 11 AS provided FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)),
x AS (SELECT *, greatest(required - provided, 0) AS unmet, provided % 4 AS frontage, provided % 2 = 1 AS entrance, provided % 3 = 0 AS contiguous FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (unmet = 0)::INT DESC, (required <= 8 AND (provided <= 1 OR contiguous))::INT DESC,
CASE status WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE (unmet = 0)::INT END DESC, frontage DESC, entrance::INT DESC, contiguous::INT DESC, provided DESC, nth) AS r FROM x)
SELECT l_orderkey, nth, required, provided FROM r WHERE r = 1""")
def layout_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best layout of each order's, by what it meets, its state and its ways."""
    li = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("nth")).agg((F.min("l_partkey") % 7).alias("state"), (F.min("l_suppkey") % 12).alias("required"), (F.min("l_partkey") % 11).alias("provided"))
    status = F.element_at(F.array(*[F.lit(n) for n in (*design.STATES, "needs_entrance", "failed", "open")]), (F.col("state") + 1).cast("int"))
    got = F.col("provided")
    rows = li.select("l_orderkey", "nth", status.alias("status"), "required", "provided", F.greatest(F.col("required") - got, F.lit(0)).alias("unmet"), (got % 4).alias("frontage"), (got % 2 == 1).alias("entrance"), (got % 3 == 0).alias("contiguous"))
    return design.best_layouts(rows, "l_orderkey").select("l_orderkey", "nth", "required", "provided")


@query("""WITH t(kind, name, least, share, near) AS (VALUES ('업무시설', 'core', 18.0::DOUBLE, 0.18::DOUBLE, 'lobby,workspace'), ('업무시설', 'lobby', 10, 0.1, 'core,workspace'), ('업무시설', 'workspace', 24, 0.46, 'core,meeting'), ('업무시설', 'meeting', 10, 0.12, 'workspace'), ('업무시설', 'service', 8, 0.08, 'core'),
('공동주택', 'core', 16, 0.16, 'corridor'), ('공동주택', 'corridor', 12, 0.13, 'core,unit_a,unit_b'), ('공동주택', 'unit_a', 24, 0.28, 'corridor'), ('공동주택', 'unit_b', 24, 0.28, 'corridor'), ('공동주택', 'service', 7, 0.06, 'core'),
('창고', 'core', 16, 0.18, 'public'), ('창고', 'public', 18, 0.22, 'core,program'), ('창고', 'program', 28, 0.38, 'public,service'), ('창고', 'service', 8, 0.1, 'core,program')),
f AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '공동주택' WHEN 'MACHINERY' THEN '업무시설' ELSE '창고' END AS kind, greatest((abs(c_acctbal) / 20 + 10) * 0.82, 1) AS usable FROM customer),
r AS (SELECT c_custkey, name, near, usable, greatest(least, usable * share) AS area FROM f JOIN t USING (kind)), s AS (SELECT *, sum(area) OVER (PARTITION BY c_custkey) AS total FROM r)
SELECT c_custkey, name, near AS neighbours, round(CASE WHEN total > usable THEN greatest(1, area * usable / total) ELSE area END, 2) AS area FROM s""")
def program_of_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of a typical floor by kind of building, scaled where they would exceed it."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "공동주택").when(F.col("c_mktsegment") == "MACHINERY", "업무시설").otherwise("창고")
    c = Tables(spark, sf_dir).customer.select("c_custkey", F.inline(design.program_rooms(kind, F.abs("c_acctbal") / 20 + 10)))
    return c.select("c_custkey", "name", "neighbours", F.round("area", 2).alias("area"))

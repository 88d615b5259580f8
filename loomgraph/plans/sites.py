"""Designs and their sites: codes of permutations, step lists, parcel edges, rule items, evidence, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import sequence
from loomgraph.operators import sites
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()


@query("""WITH l AS (SELECT l_orderkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem),
p AS (SELECT l_orderkey, list(i ORDER BY x, i) AS perm FROM l GROUP BY 1)
SELECT l_orderkey, perm AS decoded, [len([x FOR x IN perm[1:list_position(perm, v) - 1] IF x > v]) FOR v IN list_sort(perm)] AS code FROM p""")
def permutation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order by price as a permutation: its inversion code, and the permutation read back from the code."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = Tables(spark, sf_dir).lineitem.withColumn("i", F.row_number().over(w) - 1)
    made = F.transform(F.array_sort(F.collect_list(F.struct("l_extendedprice", "i"))), lambda x: x["i"])
    codes = line.groupBy("l_orderkey").agg(made.alias("perm")).select("l_orderkey", sequence.inversions(F.col("perm")).alias("code"))
    return codes.select("l_orderkey", "code", sequence.permutation(F.col("code")).alias("decoded"))


@query()
def step_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each part's steps from those of the part before it in its brand, with the parts of the sum."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    steps = F.split(F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name"))), " ")
    p = Tables(spark, sf_dir).part.select("p_brand", "p_partkey", steps.alias("a")).withColumn("b", F.lag("a").over(w)).filter("b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return p.select("p_partkey", sequence.common_order(a, b).alias("common_order"), sequence.shared_count(a, b).alias("shared"), sequence.sequence_distance(a, b).alias("distance"))


@query("""WITH p AS (SELECT c_custkey AS k, [0, 10 + c_custkey % 7, 9 + c_custkey % 5, c_custkey % 4 - 2]::DOUBLE[] AS xs, [0, c_custkey % 3, 8 + c_custkey % 11, 6 + c_custkey % 13]::DOUBLE[] AS ys,
CASE WHEN c_custkey % 5 = 0 THEN [c_custkey % 2 = 0, false, c_custkey % 3 = 0, false] END AS marks FROM customer),
s AS (SELECT k, i AS edge, xs[i + 1] AS x1, ys[i + 1] AS y1, xs[(i + 1) % 4 + 1] AS x2, ys[(i + 1) % 4 + 1] AS y2, coalesce(marks[i + 1], false) AS marked FROM p, range(0, 4) AS r(i)),
c AS (SELECT k, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy, bool_or(marked) AS given FROM s GROUP BY 1),
e AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length, CASE WHEN (y1 - y2) * (cx - (x1 + x2) / 2) + (x2 - x1) * (cy - (y1 + y2) / 2) > 0 THEN -1 ELSE 1 END AS turn FROM s JOIN c USING (k)),
f AS (SELECT *, degrees(atan2(turn * (y1 - y2), turn * (x2 - x1))) AS az, row_number() OVER (PARTITION BY k ORDER BY length DESC, edge) AS nth FROM e),
one AS (SELECT k, edge AS e1, length AS most FROM f WHERE nth = 1),
two AS (SELECT k, arg_min(edge, nth) AS e2 FROM f JOIN one USING (k) WHERE edge <> e1 AND abs(edge - e1) IN (1, 3) AND length >= most * 0.7 GROUP BY 1),
r AS (SELECT f.k, f.edge, f.length, abs(az) <= 60 AS north, CASE WHEN given THEN marked ELSE f.edge = e1 OR coalesce(f.edge = e2, false) END AS road FROM f JOIN one USING (k) LEFT JOIN two USING (k))
SELECT k AS c_custkey, edge, round(length, 6) AS length, north, road, NOT road AND NOT north AS adjacent FROM r""")
def parcel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of four-cornered parcels as north, road and adjacent ones; one in five knows its road edges."""
    k = F.col("c_custkey")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(corner(F.lit(0), F.lit(0)), corner(10 + k % 7, k % 3), corner(9 + k % 5, 8 + k % 11), corner(k % 4 - 2, 6 + k % 13))
    roads = F.when(k % 5 == 0, F.array(k % 2 == 0, F.lit(False), k % 3 == 0, F.lit(False)))
    p = Tables(spark, sf_dir).customer.select("c_custkey", ring.alias("ring"), roads.alias("roads"))
    return sites.edge_classes(p, "ring", "roads").withColumn("length", F.round("length", 6)).withColumn("edge", F.col("edge").cast("long"))


_ALL_ITEMS = ", ".join(f"('{g}', '{k}', '{n}', '{a}')" for g, items in (("zone", sites.ZONE_ITEMS), ("scale", sites.SCALE_ITEMS), ("text", sites.TEXT_ITEMS)) for k, n, a in items)


@query(f"""WITH z AS (SELECT 'z' || n_nationkey AS zone, n_name AS allowed, '별표 ' || n_nationkey AS use_article, CASE WHEN n_nationkey % 4 > 0 THEN 50 + n_nationkey * 10 END AS min_area, CASE WHEN n_nationkey % 3 > 0 THEN '조례 §' || (n_nationkey % 5) END AS area_article,
n_nationkey % 2 = 0 AS daylight, '영 §' || n_nationkey AS daylight_article, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey * 1000 END AS permit_area FROM nation WHERE n_nationkey < 20),
s AS (SELECT s_suppkey AS site, pos, 'z' || (s_suppkey * pos * 7 % 25) AS zone FROM supplier, range(1, 5) AS r(pos) WHERE pos <= s_suppkey % 4 + 1),
k AS (SELECT * FROM s JOIN z USING (zone)), a AS (SELECT site, area_article, min(pos) AS pos FROM k WHERE area_article IS NOT NULL GROUP BY 1, 2),
j AS (SELECT site, string_agg(area_article, '; ' ORDER BY pos) AS areas FROM a GROUP BY 1),
g AS (SELECT site, arg_min(allowed, pos) AS allowed, arg_min(use_article, pos) AS uses, max(min_area) AS min_area, bool_or(daylight) AS daylight, arg_min(daylight_article, pos) FILTER (WHERE daylight) AS days, min(permit_area) AS permit FROM k GROUP BY 1),
i(grp, item, name, article) AS (VALUES {_ALL_ITEMS}), o AS (SELECT DISTINCT site FROM s)
SELECT site, item, name, CASE item WHEN 'site_road_requirement' THEN 2 WHEN 'site_subdivision_limit' THEN min_area WHEN 'development_permit' THEN permit END::DOUBLE AS amount, CASE item WHEN 'daylighting_spacing' THEN coalesce(daylight, false) ELSE true END AS applies,
CASE item WHEN 'building_use_restriction' THEN coalesce(allowed, '') END AS note, coalesce(CASE item WHEN 'building_use_restriction' THEN uses WHEN 'site_subdivision_limit' THEN areas WHEN 'daylighting_spacing' THEN days END, article) AS article
FROM o JOIN i ON true LEFT JOIN g USING (site) LEFT JOIN j USING (site)""")
def extended_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 31 further rule items of sites with one to four zones, of which the table knows most."""
    t, n = Tables(spark, sf_dir), F.col("n_nationkey")
    zones = t.nation.filter(n < 20).select(
        F.concat(F.lit("z"), n).alias("zone"), F.col("n_name").alias("allowed"), F.concat(F.lit("별표 "), n).alias("use_article"), F.when(n % 4 > 0, 50 + n * 10).alias("min_area"),
        F.when(n % 3 > 0, F.concat(F.lit("조례 §"), n % 5)).alias("area_article"), (n % 2 == 0).alias("daylight"), F.concat(F.lit("영 §"), n).alias("daylight_article"), F.when(n % 5 > 0, n * 1000).alias("permit_area"),
    )
    s = t.supplier.select(F.col("s_suppkey").alias("site"), F.explode(F.sequence(F.lit(1), (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("pos"))
    return sites.extended_items(s.withColumn("zone", F.concat(F.lit("z"), F.col("site") * F.col("pos") * 7 % 25)), zones)


@query("""WITH c AS (SELECT p_partkey AS design, 'bcr' AS key, 'hard' AS severity, CASE WHEN p_partkey % 10 > 0 THEN p_size END::DOUBLE AS provided, 40.0::DOUBLE AS required, false AS at_least FROM part
UNION ALL SELECT p_partkey, 'far', CASE WHEN p_partkey % 3 = 0 THEN 'soft' ELSE 'hard' END, p_retailprice, 1500.0, false FROM part
UNION ALL SELECT p_partkey, 'setback', 'hard', p_size / 10.0 - 1e-10, CASE WHEN p_partkey % 7 > 0 THEN 1.0 END, true FROM part),
s AS (SELECT *, CASE WHEN provided IS NULL OR required IS NULL THEN 'needs_evidence' WHEN at_least AND provided + 1e-9 >= required OR NOT at_least AND provided <= required + 1e-9 THEN 'pass' ELSE 'fail' END AS st FROM c),
g AS (SELECT design, count(*) AS n_checks, coalesce(list(key ORDER BY key) FILTER (WHERE st = 'fail' AND severity = 'hard'), []) AS failures, coalesce(list(key ORDER BY key) FILTER (WHERE st = 'needs_evidence'), []) AS missing FROM s GROUP BY 1)
SELECT *, CASE WHEN len(failures) > 0 THEN 'fail' WHEN len(missing) > 0 THEN 'needs_evidence' ELSE 'pass' END AS status FROM g""")
def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks a design with their status, the keys that fail or lack evidence, and the decision."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    check = lambda key, severity, provided, required, at_least: F.struct(F.lit(key).alias("key"), severity.alias("severity"), sites.check_status(provided, required, F.lit(at_least)).alias("status"))
    three = F.array(
        check("bcr", F.lit("hard"), F.when(k % 10 > 0, size), F.lit(40.0), False), check("far", F.when(k % 3 == 0, "soft").otherwise("hard"), F.col("p_retailprice"), F.lit(1500.0), False),
        check("setback", F.lit("hard"), size / 10 - 1e-10, F.when(k % 7 > 0, 1.0), True),
    )
    return sites.evidence_bundles(Tables(spark, sf_dir).part.select(k.alias("design"), F.inline(three)))


#: Requests by part key.
REQUESTS = ("북측 상부를 낮춰 주세요", "도로 쪽 저층을 키워 주세요", "코어를 동측으로", "계단 동선을 정리", "더 날씬한 비례", "연면적을 최대로", "", "다시 봐 주세요", "FAR and the east core 코어", "서측 엘리베이터, 전면 포디움")
_REQUEST = "[" + ", ".join(f"'{x}'" for x in REQUESTS) + f"][p_partkey % {len(REQUESTS)} + 1]"
_HIT = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query(f"""WITH q AS (SELECT p_partkey, lower({_REQUEST}) AS t FROM part), m AS (SELECT *, [x FOR x IN [{", ".join(f"CASE WHEN {_HIT(w)} THEN '{n}' END" for n, w in sites.INTENTS)}] IF x IS NOT NULL] AS met FROM q)
SELECT p_partkey, CASE WHEN t = '' THEN [] WHEN len(met) = 0 THEN ['general_design_review'] ELSE met END AS intents,
CASE WHEN list_contains(met, 'core_relocation') THEN CASE {" ".join(f"WHEN {_HIT(w)} THEN '{n}'" for n, w in sites.SIDES)} ELSE 'edge' END END AS core_side FROM m""")
def request_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request in words asks of a design, and to which side its core is to go."""
    text = F.element_at(F.array(*map(F.lit, REQUESTS)), (F.col("p_partkey") % len(REQUESTS) + 1).cast("int"))
    return Tables(spark, sf_dir).part.select("p_partkey", sites.request_intents(text).alias("x")).select("p_partkey", "x.*")


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 > 0 THEN 40 + s_suppkey % 30 END AS bcr, CASE WHEN s_suppkey % 9 > 0 THEN 100 + s_suppkey % 200 END AS far, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 END AS adj, s_suppkey % 4 AS nz,
['녹지지역', '공업지역', '자연환경보전지역', '주거지역', NULL][s_suppkey % 5 + 1] AS cat FROM supplier)
SELECT k AS s_suppkey, [x FOR x IN [CASE WHEN bcr IS NOT NULL THEN '건폐율 상한: ' || bcr || '%' END, CASE WHEN far IS NOT NULL THEN '용적률 상한: ' || far || '%' END, CASE WHEN k % 2 = 0 THEN '일조사선: 정북방향 H/2 이격' END,
CASE WHEN k % 3 = 0 THEN '높이제한: 전면도로폭 × 1.5 (가로구역별 높이 미지정 시, 건축법 시행령 §82)' END, CASE WHEN k % 7 = 0 THEN '가각전제: 8m 미만 도로 모퉁이 (시행령 §31)' END, CASE WHEN adj IS NOT NULL THEN '인접대지 이격: ' || adj || 'm 이상' END,
CASE WHEN k % 6 = 0 THEN '조경: 대지면적의 15% 이상' END, CASE WHEN k % 8 = 0 THEN '건축물 용도 제한: 공장' END, CASE WHEN k % 3 > 0 THEN '대지 분할 제한: 최소 ' || (k % 3 * 30) || 'm²' END, CASE WHEN k % 2 = 1 THEN '채광 인동간격: 공동주택 높이 기준 이격 (건축법 §61②)' END,
CASE WHEN nz > 1 THEN '복수 용도지역 적용 (' || nz || '개) - 최엄격 기준 적용 (국토계획법 제76-77조)' END, CASE cat WHEN '녹지지역' THEN '건축물 용도 제한 (녹지지역) — 시행령 별표 참조' WHEN '공업지역' THEN '환경오염 관련 규제 주의 (공업지역)' WHEN '자연환경보전지역' THEN '건축물 용도 극히 제한 (자연환경보전지역)' END,
CASE WHEN k % 4 = 1 THEN '높이제한: 고도지구 ' || (k % 10) || '~' || (k % 10 + 20) || 'm (조례 §1)' WHEN k % 4 = 2 THEN '높이제한: 고도지구 최고 ' || (k % 10 + 20) || 'm (조례 §1)' WHEN k % 4 = 3 THEN '경관 심의 (조례 §1)' END,
CASE WHEN k % 4 = 0 THEN '미인식 용도지역: 기타, 고도 (수동 확인 필요)' ELSE '미인식 용도지역: 기타 (수동 확인 필요)' END] IF x IS NOT NULL] AS restrictions FROM s""")
def site_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What binds each site in sentences, with overlays and the zones that nothing stands for."""
    k = F.col("s_suppkey")
    no_text = F.lit(None).cast("string")
    rules = F.struct(
        F.when(k % 4 > 0, 40 + k % 30).alias("bcr"), F.when(k % 9 > 0, 100 + k % 200).alias("far"), (k % 2 == 0).alias("sunlight"), F.when(k % 3 == 0, 1.5).alias("road_multiple"), (k % 7 == 0).alias("corner"),
        F.when(k % 5 == 0, k % 3).alias("adjacent"), F.when(k % 6 == 0, 15).alias("landscaping"), F.when(k % 8 == 0, "공장").otherwise("").alias("prohibited"), (k % 3 * 30).alias("min_area"), (k % 2 == 1).alias("daylight"),
        (k % 4).alias("n_zones"), F.element_at(F.array(F.lit("녹지지역"), F.lit("공업지역"), F.lit("자연환경보전지역"), F.lit("주거지역"), no_text), (k % 5 + 1).cast("int")).alias("category"),
    )
    layer = F.struct(F.lit("고도지구").alias("name"), F.lit("조례 §1").alias("article"), F.lit("경관 심의").alias("description"), F.lit("고도").alias("zone"), F.when(k % 4 == 1, k % 10).alias("low"), F.when(k % 4 < 3, k % 10 + 20).alias("high"))
    zones = F.array(F.lit("기타"), F.lit("고도"), F.lit("알려짐"))
    told = sites.restrictions(rules, F.when(k % 4 > 0, F.array(layer)), zones, F.array(F.lit("알려짐")))
    return Tables(spark, sf_dir).supplier.select("s_suppkey", told.alias("restrictions"))

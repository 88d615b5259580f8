"""Building sites and their designs: classes of parcel edges, extended rule items, evidence of checks, intents of a request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.geometry import _sides, ring_centroid
from loomgraph.session import spread

# Least length of an edge, half of the arc that counts as north, share of the longest edge that a second road edge has.
SHORTEST, NORTH_ARC, ROAD_SHARE = 0.01, 60.0, 0.70
TOLERANCE = 1e-9

# Items that hold by scale or as text only: key, name, articles.
SCALE_ITEMS = (
    ("site_safety", "대지의 안전", "건축법 §40"), ("public_open_space", "공개공지", "건축법 §43, 시행령 §27의2"), ("on_site_open_space", "대지 안의 공지", "건축법 §58, 시행령 §80의2"),
    ("structural_safety", "구조안전 확인/내진설계", "건축법 §48, 시행령 §32"), ("fire_resistant", "내화구조", "건축법 §50, 시행령 §56"), ("fire_compartment", "방화구획", "건축법 §49, 시행령 §46"),
    ("fire_district", "방화지구 건축제한", "건축법 §51, 시행령 §58"), ("elevator", "승강기 설치", "건축법 §64, 시행령 제89조"), ("development_permit", "개발행위허가", "국토계획법 §56, 시행령 §51"),
    ("infrastructure_fee", "기반시설부담금", "국토계획법 §67, 시행령 §64"),
)
TEXT_ITEMS = (
    ("fire_protection", "소방시설", "소방시설법 §7, §12"), ("accessibility", "장애인 편의시설", "장애인등편의법 §8, 시행령 §4"), ("energy_saving", "에너지절약설계", "녹색건축물법 §14, §15, 시행령 §10"),
    ("evacuation", "피난시설", "건축법 §49, 시행령 §34-46"), ("finishing_materials", "마감재료", "건축법 §52, 시행령 §61"), ("room_daylighting", "거실 채광·환기", "건축법 시행령 §51, §51의2"),
    ("sewage_treatment", "오수처리", "하수도법 §34, 하수도법 시행령"), ("school_buffer_zone", "학교환경위생정화구역", "학교보건법 §6, 시행령 §3-4"), ("cultural_heritage_zone", "문화재 보호구역", "문화재보호법 §35, 시행령 §21의2"),
    ("military_zone", "군사시설 보호구역", "군사기지법 §13, 시행령"), ("use_district_restriction", "용도지구 건축제한", "국토계획법 §76②, 시행령 §72-82"), ("party_wall", "맞벽건축", "건축법 §59, 시행령 §81"),
    ("cpted", "범죄예방 CPTED", "건축법 §53의2, 시행령 §61의3"), ("combined_development", "결합건축", "건축법 §56의2, 시행령 §80의3"), ("basement_restriction", "지하층 제한", "건축법 §53, 시행령 §25"),
    ("building_systems", "건축설비", "건축법 §62, 시행령 §87"),
)
# Items that depend on the zones: key, name, articles where no zone names any.
ZONE_ITEMS = (
    ("building_use_restriction", "건축물 용도 제한", "국토계획법 §76, 시행령 §71"), ("site_road_requirement", "접도의무", "건축법 §44"), ("site_subdivision_limit", "대지 분할 제한", "건축법 §57, 시행령 §80"),
    ("daylighting_spacing", "채광 인동간격", "건축법 §61②, 시행령 §86③"), ("split_zoning_rule", "2개 용도지역 걸침 규정", "건축법 §54, 국토계획법 §84"),
)
FRONTAGE = 2.0

# Words of a request and the intent they stand for; every intent that is met counts.
INTENTS = (
    ("north_sunlight_stepback", ("북", "정북", "일조", "사선", "후퇴", "상층", "상부", "낮춰", "낮추")),
    ("road_side_podium", ("도로", "저층", "포디움", "기단", "1층", "2층", "3층", "가로", "전면")),
    ("core_relocation", ("코어", "계단", "엘리베이터", "동선", "피난", "중앙", "동측", "서측", "남측")),
    ("proportion_refinement", ("뚱뚱", "박스", "답답", "슬림", "날씬", "비례", "예쁘", "자연스럽")),
    ("far_utilization", ("용적", "far", "면적", "연면적", "더 크게", "키워", "올려", "최대")),
)
NO_INTENT = "general_design_review"
SIDES = (
    ("east", ("동측", "동쪽", "동편", "east")), ("west", ("서측", "서쪽", "서편", "west")), ("south", ("남측", "남쪽", "남편", "south")), ("north", ("북측", "북쪽", "북편", "north")),
)


def _any_word(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def request_intents(text: Column) -> Column:
    """``intents, core_side`` of a design request: all intents met, in order; a general review where none is, and nothing for an empty request."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    met = F.array_compact(F.array(*[F.when(_any_word(t, words), name) for name, words in INTENTS]))
    side = None
    for name, words in SIDES:
        side = F.when(_any_word(t, words), name) if side is None else side.when(_any_word(t, words), name)
    intents = F.when(t == "", F.array().cast("array<string>")).when(F.size(met) == 0, F.array(F.lit(NO_INTENT))).otherwise(met)
    return F.struct(intents.alias("intents"), F.when(F.array_contains(met, "core_relocation"), side.otherwise("edge")).alias("core_side"))


def _once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select`` whose columns are worked out once a row: as rows of a generator they aren't written into the expressions, and the loops over arrays, that use them."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def edge_classes(parcels: DataFrame, ring: str, roads: str | None = None) -> DataFrame:
    """One row per edge of each ring: the other columns with ``edge, length, north, road, adjacent``.

    ``edge`` counts from 0; edges under a centimetre are left out. North is an
    edge whose outward normal lies within 60 degrees of north. Road edges are
    those that ``roads`` (an array of booleans, one an edge) marks, where it
    marks any; else the longest edge, the first of equals, and the longest that
    shares a corner with it and has 70 % of its length. The rest are adjacent
    unless they face north.
    """
    keep = [c for c in parcels.columns if c not in (ring, roads)]
    marks = F.col(roads) if roads else F.array().cast("array<boolean>")
    p = _once(spread(parcels), *keep, F.col(ring).alias("_ring"), marks.alias("_marks"))
    p = _once(p, *keep, ring_centroid(F.col("_ring")).alias("_centre"), "_marks", _sides(F.col("_ring")).alias("_sides"))

    def told(side: Column, i: Column) -> Column:
        dx, dy = side["b"]["x"] - side["a"]["x"], side["b"]["y"] - side["a"]["y"]
        mid_x, mid_y = (side["a"]["x"] + side["b"]["x"]) / 2, (side["a"]["y"] + side["b"]["y"]) / 2
        inward = -dy * (F.col("_centre.x") - mid_x) + dx * (F.col("_centre.y") - mid_y) > 0
        turn = F.pmod(F.degrees(F.atan2(F.when(inward, dy).otherwise(-dy), F.when(inward, -dx).otherwise(dx))), F.lit(360.0))
        marked = F.coalesce(F.get(F.col("_marks"), i), F.lit(False))
        return F.struct(i.alias("edge"), F.sqrt(dx * dx + dy * dy).alias("length"), ((turn >= 360 - NORTH_ARC) | (turn <= NORTH_ARC)).alias("north"), marked.alias("marked"), side["a"].alias("a"), side["b"].alias("b"))

    p = _once(p, *keep, F.transform("_sides", told).alias("_told"))
    p = _once(p, *keep, F.filter("_told", lambda e: e["length"] >= SHORTEST).alias("_edges"))
    first = F.array_min(F.transform("_edges", lambda e: F.struct((-e["length"]).alias("short"), e["edge"].alias("edge"), e["a"].alias("a"), e["b"].alias("b"))))
    p = _once(p, *keep, "_edges", F.exists("_edges", lambda e: e["marked"]).alias("_any"), first.alias("_first"))
    touches = lambda e: (e["a"] == F.col("_first.a")) | (e["a"] == F.col("_first.b")) | (e["b"] == F.col("_first.a")) | (e["b"] == F.col("_first.b"))
    near = F.filter("_edges", lambda e: (e["edge"] != F.col("_first.edge")) & touches(e) & (e["length"] >= -F.col("_first.short") * ROAD_SHARE))
    p = _once(p, *keep, "_edges", "_any", "_first", F.array_min(F.transform(near, lambda e: F.struct((-e["length"]).alias("short"), e["edge"].alias("edge")))).alias("_second"))
    e = p.select(*keep, "_any", F.col("_first.edge").alias("_one"), F.col("_second.edge").alias("_two"), F.explode("_edges").alias("_e"))
    road = F.when(F.col("_any"), F.col("_e.marked")).otherwise((F.col("_e.edge") == F.col("_one")) | F.coalesce(F.col("_e.edge") == F.col("_two"), F.lit(False)))
    return e.select(*keep, "_e.edge", "_e.length", "_e.north", road.alias("road")).withColumn("adjacent", ~F.col("road") & ~F.col("north"))


def extended_items(sites: DataFrame, zones: DataFrame) -> DataFrame:
    """``site, item, name, amount, applies, note, article`` for all 31 items of each site.

    ``sites(site, zone, pos)`` lists the zones of a site in order; ``zones(zone,
    allowed, use_article, min_area, area_article, daylight, daylight_article,
    permit_area)`` is the table of zones. Uses come from the first zone that the
    table knows, the least lot is the largest of its zones, daylight applies if
    it does in any, the permit's area is the smallest; zones that the table
    doesn't know count for nothing.
    """
    known = sites.join(zones.withColumn("_known", F.lit(True)), "zone", "left")
    first = lambda c: F.min_by(c, F.when(F.col("_known"), F.col("pos")))
    listed = F.array_sort(F.collect_list(F.when(F.col("min_area").isNotNull() | F.col("area_article").isNotNull(), F.struct("pos", "area_article"))))
    articles = F.array_distinct(F.filter(F.transform(listed, lambda x: x["area_article"]), lambda x: x.isNotNull() & (x != "")))
    s = known.groupBy("site").agg(
        F.count("_known").alias("n"), first("allowed").alias("allowed"), first("use_article").alias("use_article"), F.max("min_area").alias("min_area"), F.array_join(articles, "; ").alias("area_article"),
        F.coalesce(F.max("daylight"), F.lit(False)).alias("daylight"), F.min_by("daylight_article", F.when(F.col("daylight"), F.col("pos"))).alias("daylight_article"), F.min("permit_area").alias("permit_area"),
    )
    no_number, no_text, always = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(True)
    by_zone = {
        "building_use_restriction": (no_number, always, F.coalesce("allowed", F.lit("")), F.when(F.col("n") > 0, F.coalesce("use_article", F.lit("")))), "site_road_requirement": (F.lit(FRONTAGE), always, no_text, no_text),
        "site_subdivision_limit": (F.col("min_area"), always, no_text, F.nullif("area_article", F.lit(""))), "daylighting_spacing": (no_number, F.col("daylight"), no_text, F.col("daylight_article")), "split_zoning_rule": (no_number, always, no_text, no_text),
    }

    def item(key: str, name: str, article: str) -> Column:
        amount, applies, note, own = by_zone.get(key, (F.col("permit_area") if key == "development_permit" else no_number, always, no_text, no_text))
        parts = {"item": F.lit(key), "name": F.lit(name), "amount": amount.cast("double"), "applies": applies, "note": note, "article": F.coalesce(own, F.lit(article))}
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    return s.select("site", F.inline(F.array(*[item(*x) for x in ZONE_ITEMS + SCALE_ITEMS + TEXT_ITEMS])))


def check_status(provided: Column, required: Column, at_least: Column) -> Column:
    """``pass``, ``fail`` or, where a value is missing, ``needs_evidence``; a billionth beyond the limit still passes."""
    kept = F.when(at_least, provided + TOLERANCE >= required).otherwise(provided <= required + TOLERANCE)
    return F.when(provided.isNull() | required.isNull(), "needs_evidence").when(kept, "pass").otherwise("fail")


def evidence_bundles(checks: DataFrame) -> DataFrame:
    """``design, status, n_checks, failures, missing`` from ``checks(design, key, status, severity)``: a hard failure decides, then missing evidence; keys in order, once each."""
    hard, open_ = (F.col("status") == "fail") & (F.col("severity") == "hard"), F.col("status").isin("needs_evidence", "unknown")
    g = checks.groupBy("design").agg(F.count(F.lit(1)).alias("n_checks"), *[F.sort_array(F.collect_set(F.when(c, F.col("key")))).alias(k) for k, c in (("failures", hard), ("missing", open_))])
    return g.withColumn("status", F.when(F.size("failures") > 0, "fail").when(F.size("missing") > 0, "needs_evidence").otherwise("pass"))


def restrictions(rules: Column, overlays: Column, unmatched: Column, recognised: Column) -> Column:
    """Sentences on what binds a site, in a fixed order; what is null, false or empty says nothing.

    ``rules`` is a struct of ``bcr, far, sunlight, road_multiple, corner,
    adjacent, landscaping, prohibited, min_area, daylight, n_zones, category``;
    ``overlays`` an array of ``name, article, description, zone, low, high``.
    Zones of ``unmatched`` are named unless an overlay stands for them or they
    are ``recognised``. Numbers are told as Spark casts them to text.
    """
    r = {k: rules[k] for k in ("bcr", "far", "sunlight", "road_multiple", "corner", "adjacent", "landscaping", "prohibited", "min_area", "daylight", "n_zones", "category")}
    told = lambda when, *parts: F.when(when, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]))
    known = lambda k: r[k].isNotNull()
    kind = lambda word: F.contains(r["category"], F.lit(word))
    # The sentences.
    site = [
        told(known("bcr"), "건폐율 상한: ", r["bcr"], "%"), told(known("far"), "용적률 상한: ", r["far"], "%"), told(r["sunlight"], "일조사선: 정북방향 H/2 이격"),
        told(known("road_multiple"), "높이제한: 전면도로폭 × ", r["road_multiple"], " (가로구역별 높이 미지정 시, 건축법 시행령 §82)"), told(r["corner"], "가각전제: 8m 미만 도로 모퉁이 (시행령 §31)"),
        told(known("adjacent"), "인접대지 이격: ", r["adjacent"], "m 이상"), told(known("landscaping"), "조경: 대지면적의 ", r["landscaping"], "% 이상"), told(r["prohibited"] != "", "건축물 용도 제한: ", r["prohibited"]),
        told(r["min_area"] != 0, "대지 분할 제한: 최소 ", r["min_area"], "m²"), told(r["daylight"], "채광 인동간격: 공동주택 높이 기준 이격 (건축법 §61②)"), told(r["n_zones"] > 1, "복수 용도지역 적용 (", r["n_zones"], "개) - 최엄격 기준 적용 (국토계획법 제76-77조)"),
        F.when(kind("녹지"), "건축물 용도 제한 (녹지지역) — 시행령 별표 참조").when(kind("공업"), "환경오염 관련 규제 주의 (공업지역)").when(kind("자연환경보전"), "건축물 용도 극히 제한 (자연환경보전지역)"),
    ]

    def overlay(o: Column) -> Column:
        height = F.when(o["low"].isNotNull() & o["high"].isNotNull(), F.concat(F.lit(" "), o["low"], F.lit("~"), o["high"])).when(o["high"].isNotNull(), F.concat(F.lit(" 최고 "), o["high"]))
        return F.concat(F.when(height.isNotNull(), F.concat(F.lit("높이제한: "), o["name"], height, F.lit("m"))).otherwise(o["description"]), F.lit(" ("), o["article"], F.lit(")"))

    none = F.array().cast("array<string>")
    layers = F.coalesce(F.transform(overlays, overlay), none)
    rest = F.array_except(F.coalesce(unmatched, none), F.concat(F.coalesce(recognised, none), F.coalesce(F.transform(overlays, lambda o: o["zone"]), none)))
    unknown = F.array(told(F.size(rest) > 0, "미인식 용도지역: ", F.array_join(rest, ", "), " (수동 확인 필요)"))
    return F.array_compact(F.concat(F.array(*site), layers, unknown))

"""Rules of building sites as expressions: use classes, effective height, datum cases, relief for small parking lots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a building type and the row of the parking table they stand for; the first that is met wins.
USE_CLASSES = (
    (("위락",), 1), (("근린생활", "생활시설", "숙박"), 3), (("단독", "다가구"), 4), (("공동주택", "아파트", "연립", "다세대", "오피스텔"), 5), (("창고",), 8), (("공장", "수련"), 7),
    (("판매", "업무", "의료", "문화", "종교", "운동", "운수", "방송", "장례"), 2), (("제1종", "제2종"), 3),
)
OTHER_USE = 11
# Fixed values, in metres: sunlight setback, datum thresholds, road width and stalls of small lots.
LOW_HEIGHT, LOW_SETBACK, HIGH_SHARE = 10.0, 1.5, 0.5
FLAT, SLOPE, ROAD_SLOPE, ABOVE = 0.5, 3.0, 0.5, 0.1
WIDE_ROAD, SMALL_STALLS, TANDEM_STALLS = 12.0, 8, 5


def use_class(building_type: Column) -> Column:
    """Row of the parking table; null without a type."""
    out = F.when(F.coalesce(building_type, F.lit("")) == "", F.lit(None).cast("int"))
    for words, row in USE_CLASSES:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(building_type, F.lit(word))
        out = out.when(hit, row)
    return out.otherwise(OTHER_USE)


def effective_height(total: Column, pilotis: Column, above_road: Column, half_raise: Column) -> Column:
    """Height without an open ground floor, less half the level of the site above the road (all of it where the rule of halves doesn't apply); never below zero."""
    level = F.coalesce(above_road, F.lit(0.0))
    return F.greatest(F.lit(0.0), total - F.greatest(F.lit(0.0), F.coalesce(pilotis, F.lit(0.0))) - F.when(half_raise, level * 0.5).otherwise(level))


def sunlight_setback(height: Column) -> Column:
    return F.when(height <= LOW_HEIGHT, LOW_SETBACK).otherwise(height * HIGH_SHARE)


def datum(parcel: Column, parcel_range: Column, road: Column, road_range: Column, neighbour: Column, by_neighbour: Column, by_road: Column) -> Column:
    """``case, elevation``: the northern neighbour's mean first, then the road where it is to count, else the site by its own range."""
    on_road = by_road & road.isNotNull()
    above = on_road & (parcel > road + ABOVE)
    case = (
        F.when(by_neighbour & neighbour.isNotNull(), "neighbor_avg_86").when(above, "site_above_road")
        .when(on_road & (F.coalesce(road_range, F.lit(0.0)) >= ROAD_SLOPE), "road_sloped").when(on_road, "road_flat")
        .when(parcel_range < FLAT, "flat").when(parcel_range <= SLOPE, "slope_le3m").otherwise("slope_gt3m")
    )
    elevation = F.when(by_neighbour & neighbour.isNotNull(), (parcel + neighbour) / 2).when(above, (parcel + road) / 2).when(on_road, road).otherwise(parcel)
    return F.struct(case.alias("case"), elevation.alias("elevation"))


def small_lot_relief(required: Column, road_width: Column, separated: Column) -> Column:
    """``status, road_as_aisle, perpendicular, tandem`` of a lot; an unknown count rules nothing out, and an unknown sidewalk only the undivided road."""
    known = required.isNotNull()
    few, fewer = ~known | (required <= SMALL_STALLS), ~known | (required <= TANDEM_STALLS)
    undivided = road_width.isNotNull() & (road_width < WIDE_ROAD) & F.coalesce(~separated, F.lit(False)) & few
    wide = road_width.isNotNull() & (road_width >= WIDE_ROAD) & F.coalesce(separated, F.lit(True)) & fewer
    return F.struct(
        F.when(known, "evaluated").otherwise("needs_required_count").alias("status"), F.coalesce(undivided, F.lit(False)).alias("road_as_aisle"),
        F.coalesce(wide, F.lit(False)).alias("perpendicular"), F.coalesce(fewer, F.lit(True)).alias("tandem"),
    )

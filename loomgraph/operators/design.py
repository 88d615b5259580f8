"""Planning rules of designs: parking strategies and capacity, and the rooms of a typical floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metres of a stall and an aisle; of each strategy the usable share of an envelope and the square metres of a stall with its way.
STALL_WIDTH, STALL_LENGTH, AISLE = 2.5, 5.0, 6.0
USABLE = {"piloti_ground": 0.62, "basement": 0.75, "semi_basement": 0.75, "ground_surface": 0.85, "mixed": 0.70}
STALL_AREA = {"basement": 32.0, "semi_basement": 32.0, "piloti_ground": 34.0}
OTHER_STALL_AREA = 30.0

# Strategies in order of preference, the first one chosen.
NO_PARKING = ("none",)
SMALL_HOUSING = ("piloti_ground", "ground_surface", "mechanical", "semi_basement", "basement", "mixed")
DENSE = ("piloti_ground", "basement", "mechanical", "mixed")
TALL = ("basement", "piloti_ground", "mixed", "mechanical")
OPEN = ("ground_surface", "piloti_ground", "semi_basement", "mixed")

# Rooms of a typical floor by words in the kind of building: name, least area, share of the usable area, neighbours.
USABLE_SHARE = 0.82
ROOMS = (
    (("업무", "오피스"), (("core", 18.0, 0.18, "lobby,workspace"), ("lobby", 10.0, 0.10, "core,workspace"), ("workspace", 24.0, 0.46, "core,meeting"), ("meeting", 10.0, 0.12, "workspace"), ("service", 8.0, 0.08, "core"))),
    (("주택", "생활", "공동"), (("core", 16.0, 0.16, "corridor"), ("corridor", 12.0, 0.13, "core,unit_a,unit_b"), ("unit_a", 24.0, 0.28, "corridor"), ("unit_b", 24.0, 0.28, "corridor"), ("service", 7.0, 0.06, "core"))),
    ((), (("core", 16.0, 0.18, "public"), ("public", 18.0, 0.22, "core,program"), ("program", 28.0, 0.38, "public,service"), ("service", 8.0, 0.10, "core,program"))),
)

# How good the state of a layout is; others count by whether every space is met.
STATES = {"pass": 5, "needs_swept_path_review": 4, "needs_drive_connectivity_review": 3, "needs_aisle_review": 2}


def _by(strategy: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(strategy == name, value).otherwise(out)
    return out


def stall_capacity(long_side: Column, short_side: Column, area: Column, strategy: Column) -> Column:
    """``single, double, by_area, estimated`` spaces of an envelope: rows along aisles with stalls on one side or both, the better of them, but no more than the area holds. Mechanical parking has no estimate; an envelope without area has no spaces."""
    a_row = F.floor(long_side / STALL_WIDTH)
    single = F.greatest(F.lit(0), F.floor(short_side / (STALL_LENGTH + AISLE)) * a_row).cast("long")
    double = F.greatest(F.lit(0), F.floor(short_side / (2 * STALL_LENGTH + AISLE)) * 2 * a_row).cast("long")
    held = F.floor(area * _by(strategy, USABLE, 0.0) / _by(strategy, STALL_AREA, OTHER_STALL_AREA)).cast("long")
    known = F.when(strategy != "mechanical", F.greatest(F.lit(0), F.least(F.greatest(single, double), held))).cast("long")
    whole = F.coalesce(area, F.lit(0.0)) > 0
    zero = F.lit(0).cast("long")
    return F.struct(F.when(whole, single).otherwise(zero).alias("single"), F.when(whole, double).otherwise(zero).alias("double"), F.when(whole, held).otherwise(zero).alias("by_area"), F.when(whole, known).otherwise(zero).alias("estimated"))


def parking_strategies(site_area: Column, footprint: Column, floor_area: Column, floors: Column, coverage: Column, housing: Column) -> Column:
    """Candidate strategies in order of preference: none without floors, on a small lot with housing, on a dense lot, in a tall building, or on open ground."""
    free = F.greatest(site_area - footprint, F.lit(0.0))
    dense = (coverage >= 55) | ((site_area > 0) & (free / F.when(site_area > 0, site_area) < 0.35))
    small = (site_area > 0) & (site_area < 330)
    named = lambda c: F.array(*[F.lit(x) for x in c])
    cases = ((F.coalesce(floors, F.lit(0)) <= 0, NO_PARKING), (F.coalesce(floor_area, F.lit(0.0)) <= 0, NO_PARKING), (small & housing, SMALL_HOUSING), (dense, DENSE), (floors >= 5, TALL))
    out = F
    for condition, names in cases:
        out = out.when(condition, named(names))
    return out.otherwise(named(OPEN))


def best_layouts(layouts: DataFrame, key: str) -> DataFrame:
    """The best of each key's ``layouts(key, nth, strategy, status, required, provided, unmet, frontage, entrance, contiguous)``.

    First those that meet every space, then compact ones of up to eight spaces,
    then by state, stalls that reach the road, a proven entrance, stalls in one
    piece and number; equals go to the first in order of ``nth``.
    """
    met = F.coalesce("unmet", F.lit(0)) == 0
    state = F.lit(0)
    for name, value in STATES.items():
        state = F.when(F.col("status") == name, value).otherwise(state)
    state = F.when((state == 0) & met, 1).otherwise(state)
    compact = (F.col("required") <= 8) & ((F.col("provided") <= 1) | F.col("contiguous"))
    order = [met.cast("int"), compact.cast("int"), state, F.coalesce("frontage", F.lit(0)), F.col("entrance").cast("int"), F.col("contiguous").cast("int"), F.coalesce("provided", F.lit(0))]
    w = Window.partitionBy(key).orderBy(*[o.desc_nulls_last() for o in order], "nth")
    return layouts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def program_rooms(kind: Column, typical_area: Column) -> Column:
    """Rooms of a typical floor as ``name, area, neighbours``: each its share of the usable area or its least; all are scaled down, to no less than one, where together they exceed it."""
    usable = F.greatest(typical_area * USABLE_SHARE, F.lit(1.0))
    wanted = None
    for words, rooms in reversed(ROOMS):
        each = F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(least), usable * share).alias("area"), F.lit(near).alias("neighbours")) for n, least, share, near in rooms])
        hit = [F.contains(F.coalesce(kind, F.lit("")), F.lit(w)) for w in words]
        wanted = each if not words else F.when(F.array_contains(F.array(*hit), True), each).otherwise(wanted)
    total = F.aggregate(wanted, F.lit(0.0), lambda s, r: s + r["area"])
    scaled = lambda r: F.when(total > usable, F.round(F.greatest(F.lit(1.0), r["area"] * usable / total), 2)).otherwise(r["area"])
    return F.transform(wanted, lambda r: F.struct(r["name"].alias("name"), scaled(r).alias("area"), r["neighbours"].alias("neighbours")))

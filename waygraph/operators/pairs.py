"""Directed pairs of road users in a frame: kinematics, footprints, history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.config import R, T, Relevance, Thresholds
from waygraph.functions import kernels
from waygraph.functions.angles import difference, mean_of_two
from waygraph.functions.classifiers import continuous
from waygraph.operators.entities import unpivot
from waygraph.plans.shared import dealt

FRAME = ("scenario_token", "frame_index", "timestamp_us")
PAIR = (*FRAME, "tag", "s_track", "o_track")
#: Columns of either side.
SIDE = ("track_token", "slot", "is_ego", "agent_type", "x", "y", "heading", "cos_h", "sin_h", "vx", "vy", "length_m", "width_m")


def _side(entities: DataFrame, prefix: str, *extra: str) -> DataFrame:
    own = (*SIDE, *extra)
    return entities.select("scenario_token", "frame_index", "timestamp_us", *(F.col(c).alias(f"{prefix}{c.replace('track_token', 'track')}") for c in own))


def ego_pairs(entities: DataFrame, *extra: str) -> DataFrame:
    """Ego to each agent and back, by an equi-join on the frame."""
    s, o = _side(entities, "s_", *extra), _side(entities, "o_", *extra)
    both = s.join(o, list(FRAME)).where(F.col("s_is_ego") != F.col("o_is_ego"))
    return both.withColumn("tag", F.when(F.col("s_is_ego"), "ego_to_agent").otherwise("agent_to_ego"))


def agent_pairs(entities: DataFrame, *extra: str) -> DataFrame:
    """Every two agents of a frame, in both directions; the first by order of appearance leads."""
    agents = entities.where(~F.col("is_ego"))
    both = _side(agents, "s_", *extra).join(_side(agents, "o_", *extra), list(FRAME)).where(F.col("s_slot") != F.col("o_slot"))
    return both.withColumn("tag", F.when(F.col("s_slot") < F.col("o_slot"), "agent_to_agent").otherwise("agent_to_agent_reverse"))


def near_agent_pairs(entities: DataFrame, radius: float = R.grid_radius, *extra: str) -> DataFrame:
    """Agents within a radius, the first by order of appearance leading."""
    dx, dy = F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y")
    both = _met(entities.where(~F.col("is_ego")), radius, *extra).where((F.col("s_slot") < F.col("o_slot")) & (dx * dx + dy * dy <= radius * radius))
    return both.withColumn("tag", F.lit("agent_to_agent"))


def _met(entities: DataFrame, radius: float, *extra: str) -> DataFrame:
    """Ordered pairs of a frame in cells near each other: one side goes to all cells within the radius, the other to its own, an equi-join on the cell."""
    side = 4 * radius
    cell = lambda c, more=0.0: F.floor((F.col(c) + more) / side)
    span = lambda c: F.sequence(cell(c, -1.001 * radius), cell(c, 1.001 * radius))
    s = _side(entities, "s_", *extra).withColumn("cx", F.explode(span("s_x"))).withColumn("cy", F.explode(span("s_y")))
    o = _side(entities, "o_", *extra).withColumn("cx", cell("o_x")).withColumn("cy", cell("o_y"))
    return s.join(o, [*FRAME, "cx", "cy"]).drop("cx", "cy")


def near_pairs(entities: DataFrame, radius: float, *extra: str) -> DataFrame:
    """All ordered pairs of a frame within a radius, through the grid."""
    dx, dy = F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y")
    both = _met(entities, radius, *extra).where((F.col("s_slot") != F.col("o_slot")) & (dx * dx + dy * dy <= radius * radius))
    agents = F.when(F.col("s_slot") < F.col("o_slot"), "agent_to_agent").otherwise("agent_to_agent_reverse")
    return both.withColumn("tag", F.when(F.col("s_is_ego"), "ego_to_agent").when(F.col("o_is_ego"), "agent_to_ego").otherwise(agents))


def all_pairs(entities: DataFrame, *extra: str) -> DataFrame:
    """Every two road users of a frame, in both directions, by one equi-join on the frame."""
    both = _side(entities, "s_", *extra).join(_side(entities, "o_", *extra), list(FRAME))
    both = both.where((F.col("s_is_ego") != F.col("o_is_ego")) | (~F.col("s_is_ego") & (F.col("s_slot") != F.col("o_slot"))))
    agents = F.when(F.col("s_slot") < F.col("o_slot"), "agent_to_agent").otherwise("agent_to_agent_reverse")
    return both.withColumn("tag", F.when(F.col("s_is_ego"), "ego_to_agent").when(F.col("o_is_ego"), "agent_to_ego").otherwise(agents))


def pair_id(scenario: Column, time_us: Column, tag: Column, subject: Column, obj: Column) -> Column:
    """A stable name: the first 24 hexadecimal digits of a SHA-256."""
    return F.concat_ws(":", F.lit("pair"), scenario, time_us.cast("string"), tag, F.substring(F.sha2(F.concat_ws("|", scenario, time_us.cast("string"), tag, subject, obj), 256), 1, 24))


def with_kinematics(pairs: DataFrame) -> DataFrame:
    """Relative position and speed in the subject's body frame."""
    dx, dy = F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y")
    dvx, dvy = F.col("o_vx") - F.col("s_vx"), F.col("o_vy") - F.col("s_vy")
    c, s = F.col("s_cos_h"), F.col("s_sin_h")
    pairs = pairs.withColumn("center_distance", F.sqrt(dx * dx + dy * dy))
    d = F.col("center_distance")
    pairs = pairs.withColumns(
        {
            "longitudinal": c * dx + s * dy,
            "lateral": c * dy - s * dx,
            "heading_difference": difference(F.col("o_heading"), F.col("s_heading")),
            "relative_longitudinal_speed": c * dvx + s * dvy,
            "relative_lateral_speed": c * dvy - s * dvx,
            "relative_speed": F.sqrt(dvx * dvx + dvy * dvy),
            "closing_speed": F.when(d == 0, F.lit(0.0)).otherwise(-(dx * dvx + dy * dvy) / d),
            "toward_speed": F.when(d == 0, F.lit(0.0)).otherwise((F.col("s_vx") * dx + F.col("s_vy") * dy) / d),
            "forward_speed": c * F.col("s_vx") + s * F.col("s_vy"),
        }
    )
    # a negative zero would turn straight behind into -pi
    level = F.when(F.col("lateral") == 0, F.lit(0.0)).otherwise(F.col("lateral"))
    return pairs.withColumn("bearing", F.atan2(level, F.col("longitudinal"))).withColumn("headway_candidate_s", F.when(F.col("forward_speed") != 0, F.col("longitudinal") / F.col("forward_speed")))


def with_pair_axis(pairs: DataFrame, t: Thresholds = T) -> DataFrame:
    """The subject against the object along the mean of both headings: axis_ahead and axis_aside of the centres, behind_gap and clearance of the boxes' intervals, and whether these overlap."""
    axis = mean_of_two(F.col("s_heading"), F.col("o_heading"))
    df = pairs.withColumns({"axis_cos": F.cos(axis), "axis_sin": F.sin(axis)})
    dx, dy = F.col("s_x") - F.col("o_x"), F.col("s_y") - F.col("o_y")
    turned = lambda p: (F.abs(F.col(f"{p}cos_h") * F.col("axis_cos") + F.col(f"{p}sin_h") * F.col("axis_sin")), F.abs(F.col(f"{p}sin_h") * F.col("axis_cos") - F.col(f"{p}cos_h") * F.col("axis_sin")))
    half = lambda p: (turned(p)[0] * F.col(f"{p}length_m") + turned(p)[1] * F.col(f"{p}width_m")) / 2
    df = df.withColumns({"axis_ahead": F.col("axis_cos") * dx + F.col("axis_sin") * dy, "axis_aside": F.col("axis_cos") * dy - F.col("axis_sin") * dx, "halves": half("s_") + half("o_"), "s_half": half("s_"), "o_half": half("o_")})
    shared = F.least(F.col("axis_ahead") + F.col("s_half"), F.col("o_half")) - F.greatest(F.col("axis_ahead") - F.col("s_half"), -F.col("o_half"))
    df = df.withColumns({"behind_gap": -F.col("axis_ahead") - F.col("halves"), "clearance": F.col("axis_ahead") - F.col("halves"), "level": shared >= -t.distance_epsilon})
    return df.drop("axis_cos", "axis_sin", "halves", "s_half", "o_half")


def with_cpa(pairs: DataFrame, horizon_s: float = R.cpa_horizon_s, prefix: str = "cpa") -> DataFrame:
    """Time and distance of closest approach at constant velocity, clearance less both half diagonals, and whether they close."""
    dx, dy = F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y")
    dvx, dvy = F.col("o_vx") - F.col("s_vx"), F.col("o_vy") - F.col("s_vy")
    vv, rv = dvx * dvx + dvy * dvy, dx * dvx + dy * dvy
    half = lambda p: F.sqrt(F.coalesce(F.col(f"{p}length_m"), F.lit(0.0)) ** 2 + F.coalesce(F.col(f"{p}width_m"), F.lit(0.0)) ** 2) / 2
    pairs = pairs.withColumn(f"{prefix}_time_s", F.when(vv <= 1e-9, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(horizon_s)), -rv / vv))))
    t = F.col(f"{prefix}_time_s")
    center = F.sqrt((dx + dvx * t) * (dx + dvx * t) + (dy + dvy * t) * (dy + dvy * t))
    return pairs.withColumns({f"{prefix}_distance": center, f"{prefix}_clearance": center - half("s_") - half("o_"), f"{prefix}_closing": rv < 0})


def with_footprints(pairs: DataFrame, t: Thresholds = T) -> DataFrame:
    """free_space and overlap_area of the boxes by a vectorised kernel; gaps along the subject's axes in closed form."""
    sides = [F.col(f"{p}{c}").cast("double") for p in ("s_", "o_") for c in ("x", "y", "cos_h", "sin_h", "length_m", "width_m")]

    # twelve numbers go to the kernel, all other columns stay behind
    @F.pandas_udf("free double, area double")
    def boxes(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            columns = [c.to_numpy(dtype=float, na_value=np.nan) for c in part]
            known = ~np.isnan(np.stack([columns[i] for i in (4, 5, 10, 11)])).any(0)
            a, b = (kernels.boxes(*map(np.nan_to_num, columns[i : i + 6])) for i in (0, 6))
            yield pd.DataFrame({"free": np.where(known, kernels.convex_distance(a, b), np.nan), "area": np.where(known, kernels.convex_overlap(a, b), np.nan)})

    df = pairs.withColumn("boxes", boxes(*sides))
    return _with_gaps(df.withColumn("free_space", F.col("boxes.free")).withColumn("overlap_area", F.col("boxes.area")).drop("boxes"), t)


def with_footprints_within(pairs: DataFrame, reach: float, t: Thresholds = T) -> DataFrame:
    """with_footprints of pairs with kinematics for who asks only how near the boxes are up to reach, and whether their sizes are known: free_space beyond it is a lower bound.

    Boxes lie in circles about their centres. Pairs whose circles are further apart share nothing and go to no kernel;
    all others, also those of unknown sizes, do.
    """
    bound = F.col("center_distance") - F.hypot("s_length_m", "s_width_m") / 2 - F.hypot("o_length_m", "o_width_m") / 2
    # no number is over 1e12 but not finite ones, nor is NaN under it
    far = F.coalesce((bound > reach + 1e-3) & (bound < 1e12), F.lit(False))
    apart = pairs.where(far).withColumns({"free_space": bound, "overlap_area": F.lit(0.0)})
    return with_footprints(pairs.where(~far), t).unionByName(_with_gaps(apart, t))


def _with_gaps(df: DataFrame, t: Thresholds) -> DataFrame:
    """df, which has free_space and overlap_area, with the gaps along the subject's axes, overlapping and touching."""
    turn = lambda f: F.abs(f)
    cos_d = F.col("o_cos_h") * F.col("s_cos_h") + F.col("o_sin_h") * F.col("s_sin_h")
    sin_d = F.col("o_sin_h") * F.col("s_cos_h") - F.col("o_cos_h") * F.col("s_sin_h")
    half_x = (turn(cos_d) * F.col("o_length_m") + turn(sin_d) * F.col("o_width_m")) / 2
    half_y = (turn(sin_d) * F.col("o_length_m") + turn(cos_d) * F.col("o_width_m")) / 2
    dx, dy = F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y")
    ahead, left = F.col("s_cos_h") * dx + F.col("s_sin_h") * dy, F.col("s_cos_h") * dy - F.col("s_sin_h") * dx
    gap = lambda at, half, own: F.when(at >= 0, at - half - own / 2).otherwise(at + half + own / 2)
    return df.withColumns(
        {
            "longitudinal_gap": gap(ahead, half_x, F.col("s_length_m")),
            "lateral_gap": gap(left, half_y, F.col("s_width_m")),
            "overlapping": F.col("overlap_area") > t.overlap_area,
            "touching": (F.col("overlap_area") <= t.overlap_area) & (F.col("free_space") <= t.distance_epsilon),
        }
    )


def with_pair_history(pairs: DataFrame, t: Thresholds = T) -> DataFrame:
    """Counts, durations and changes of distance since the pair's last gap; a pair is its tracks and its tag."""
    key = ("scenario_token", "s_track", "o_track", "tag")
    order = Window.partitionBy(*key).orderBy("frame_index")
    df = dealt(pairs, *key).withColumns({f"last_{c}": F.lag(c).over(order) for c in ("frame_index", "timestamp_us", "center_distance", "free_space")})
    df = df.withColumn("continuous", continuous(F.col("frame_index"), F.col("last_frame_index"), F.col("timestamp_us"), F.col("last_timestamp_us"), t))
    df = df.withColumn("streak", F.sum((~F.col("continuous")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*key, "streak").orderBy("frame_index")
    return df.withColumns(
        {
            "pair_count": F.row_number().over(own).cast("long"),
            "pair_duration_s": (F.col("timestamp_us") - F.first("timestamp_us").over(own.rowsBetween(Window.unboundedPreceding, 0))) / 1e6,
            "center_change": F.when(F.col("continuous"), F.col("center_distance") - F.col("last_center_distance")),
            "free_space_change": F.when(F.col("continuous"), F.col("free_space") - F.col("last_free_space")),
        }
    )


def kinematic_facts(pairs: DataFrame, state: Callable = unpivot) -> DataFrame:
    return state(
        pairs,
        PAIR,
        {
            "hasCenterDistanceTo": F.col("center_distance"),
            "hasLongitudinalDistanceTo": F.col("longitudinal"),
            "hasLateralDistanceTo": F.col("lateral"),
            "hasBearingTo": F.col("bearing"),
            "hasHeadingDifferenceTo": F.col("heading_difference"),
            "hasRelativeSpeedTo": F.col("relative_speed"),
            "hasLongitudinalRelativeSpeedTo": F.col("relative_longitudinal_speed"),
            "hasLateralRelativeSpeedTo": F.col("relative_lateral_speed"),
            "hasClosingSpeedTo": F.col("closing_speed"),
            "hasVelocityTowardTarget": F.col("toward_speed"),
            "hasSubjectForwardSpeed": F.col("forward_speed"),
        },
    )


def footprint_facts(pairs: DataFrame, state: Callable = unpivot) -> DataFrame:
    return state(
        pairs,
        PAIR,
        {
            "hasFreeSpaceDistanceTo": F.col("free_space"),
            "hasIntersectionArea": F.col("overlap_area"),
            "hasLongitudinalFootprintGap": F.col("longitudinal_gap"),
            "hasLateralFootprintGap": F.col("lateral_gap"),
        },
    )


def pair_history_facts(pairs: DataFrame, state: Callable = unpivot) -> DataFrame:
    return state(
        pairs,
        PAIR,
        {
            "hasPairObservedFrameCount": F.col("pair_count"),
            "hasPairObservedDuration": F.col("pair_duration_s"),
            "hasCenterDistanceChangeFromPrevious": F.col("center_change"),
            "hasFreeSpaceDistanceChangeFromPrevious": F.col("free_space_change"),
        },
    )


def identity_facts(pairs: DataFrame) -> DataFrame:
    """hasPairwiseState, pairSubject and pairObject of each pair."""
    me = pair_id(F.col("scenario_token"), F.col("timestamp_us"), F.col("tag"), F.col("s_track"), F.col("o_track"))
    rows = F.array(*(F.struct(F.lit(p).alias("predicate"), c.alias("object")) for p, c in (("hasPairwiseState", me), ("pairSubject", F.col("s_track")), ("pairObject", F.col("o_track")))))
    return pairs.select(*PAIR, me.alias("pair_id"), F.explode(rows).alias("p")).select(*PAIR, "pair_id", "p.predicate", "p.object")

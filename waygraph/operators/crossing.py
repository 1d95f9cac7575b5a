"""crossesInFrontOf and yieldsTo."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.functions.angles import difference
from waygraph.functions.classifiers import is_dynamic, is_vehicle
from waygraph.operators.following import streaks
from waygraph.operators.pairs import FRAME
from waygraph.plans.shared import cut


#: Cells of tracks' bounds, in metres.
TRACK_CELL = 100.0


def ray_crossing(length: float = T.crossing_ray) -> tuple[Column, Column]:
    """Distances along the subject's and object's forward rays to their meeting point; null where the finite rays don't meet."""
    dx, dy = F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y")
    det = F.col("s_cos_h") * F.col("o_sin_h") - F.col("s_sin_h") * F.col("o_cos_h")
    s = (dx * F.col("o_sin_h") - dy * F.col("o_cos_h")) / det
    o = (dx * F.col("s_sin_h") - dy * F.col("s_cos_h")) / det
    ok = (F.abs(det) > 1e-9) & s.between(-1e-9, length + 1e-9) & o.between(-1e-9, length + 1e-9)
    return F.when(ok, F.greatest(F.lit(0.0), s)), F.when(ok, F.greatest(F.lit(0.0), o))


def track_pairs(entities: DataFrame, t: Thresholds = T) -> DataFrame:
    """scenario_token, s_track, o_track of road users seen often enough whose tracks' bounds come close.

    Bounds are one aggregate a track and meet by an equi-join over grid cells, of which
    the first that both share counts; crossings asks how long they were seen together.
    """
    movers = entities.where(is_dynamic(F.col("agent_type")))
    box = movers.groupBy("scenario_token", "track_token").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"), F.upper(F.first("agent_type")).alias("kind"))
    moved = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = box.where((F.col("n") >= t.crossing_observations) & (~F.col("kind").rlike("PEDESTRIAN|BICYCLE") | (moved >= t.crossing_displacement)))
    side = lambda p: box.select("scenario_token", *(F.col(c).alias(f"{p}_{c}") for c in ("track_token", "x0", "x1", "y0", "y1", "kind")))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"))
    wide, cell = t.crossing_pair_distance, TRACK_CELL
    cells = lambda p, more: {f"{p}_c{c}": F.sequence(F.floor((F.col(f"{p}_{c}0") - more) / cell), F.floor((F.col(f"{p}_{c}1") + more) / cell)) for c in "xy"}
    spread = lambda p, more: side(p).withColumns(cells(p, more)).withColumn("cx", F.explode(f"{p}_cx")).withColumn("cy", F.explode(f"{p}_cy"))
    first = lambda c: F.col(f"c{c}") == F.greatest(F.get(f"a_c{c}", F.lit(0)), F.get(f"b_c{c}", F.lit(0)))
    both = spread("a", wide).join(spread("b", 0.0), ["scenario_token", "cx", "cy"]).where((F.col("a_track_token") != F.col("b_track_token")) & first("x") & first("y"))
    both = both.where(~(F.col("a_kind").contains("PEDESTRIAN") & F.col("b_kind").contains("PEDESTRIAN")) & (F.hypot(gap("x"), gap("y")) <= t.crossing_pair_distance))
    return both.select("scenario_token", F.col("a_track_token").alias("s_track"), F.col("b_track_token").alias("o_track"))


def meetings(pairs: DataFrame, tracks: DataFrame, t: Thresholds = T) -> DataFrame:
    """One row per frame and ordered pair whose rays meet so that the subject is first: conflict point, arrival times, score."""
    together = Window.partitionBy("scenario_token", "s_track", "o_track")
    span = (F.max("timestamp_us").over(together) - F.min("timestamp_us").over(together)) / 1e6
    df = pairs.join(tracks, ["scenario_token", "s_track", "o_track"], "left_semi")
    df = df.withColumn("n_common", F.count(F.lit(1)).over(together)).withColumn("span_s", span).where((F.col("n_common") >= t.crossing_observations) & (F.col("span_s") >= t.crossing_common_s))
    near_s, near_o = ray_crossing(t.crossing_ray)
    angle = difference(F.col("s_heading"), F.col("o_heading")) * (180 / math.pi)
    speed = lambda p: F.hypot(f"{p}vx", f"{p}vy")
    df = df.withColumns({"s_ray": near_s, "o_ray": near_o, "angle": angle, "s_v": speed("s_"), "o_v": speed("o_")})
    df = df.where(F.col("s_ray").isNotNull() & F.col("angle").between(t.crossing_least_angle_deg, t.crossing_most_angle_deg) & (F.col("s_v") >= t.crossing_speed))
    df = df.withColumn("s_eta", F.col("s_ray") / F.greatest("s_v", F.lit(0.05))).withColumn("stationary", F.col("o_v") <= t.crossing_stationary_speed)
    df = df.withColumn("eta_gap", F.when(~F.col("stationary"), F.col("o_ray") / F.col("o_v") - F.col("s_eta")))
    df = df.where(F.col("stationary") | F.col("eta_gap").between(t.crossing_margin_s, t.crossing_arrival_s))
    score = F.greatest(F.lit(0.0), 3 - F.abs(F.col("angle") - 90) / 30) + F.greatest(F.lit(0.0), 2 - F.greatest("s_ray", "o_ray") / t.crossing_ray) + F.least(F.lit(2.0), "s_v")
    df = df.withColumn("score", score).withColumns({"conflict_x": F.col("s_x") + F.col("s_cos_h") * F.col("s_ray"), "conflict_y": F.col("s_y") + F.col("s_sin_h") * F.col("s_ray")})
    return df.select(*FRAME, "s_track", "o_track", "conflict_x", "conflict_y", "angle", "s_eta", "eta_gap", "stationary", "score")


def gated(found: DataFrame, barred: DataFrame) -> DataFrame:
    """found with s_reason and o_reason: why a side takes part in no crossing (areas.gates), null where it may."""
    for side in ("s", "o"):
        own = barred.select(*FRAME, F.col("track_token").alias(f"{side}_track"), F.col("reason").alias(f"{side}_reason"))
        found = found.join(own, [*FRAME, f"{side}_track"], "left")
    return found


def crossings(found: DataFrame, frames: DataFrame, barred: DataFrame | None = None, t: Thresholds = T) -> DataFrame:
    """One row per frame and pair, in its better direction, with the run of frames that it lies in; found are meetings, barred those that areas.gates turns down."""
    if barred is not None:
        found = gated(found, barred).where("s_reason is null and o_reason is null").drop("s_reason", "o_reason")
    best = Window.partitionBy(*FRAME, F.least("s_track", "o_track"), F.greatest("s_track", "o_track")).orderBy(F.desc("score"), "s_track")
    df = found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    return streaks(df, frames, ("s_track", "o_track"), t)


def yields(found: DataFrame, entities: DataFrame, red: DataFrame | None = None, t: Thresholds = T) -> DataFrame:
    """scenario_token, s_track yields to o_track, reaction_us, clear_us, proceed_us.

    found has crossings of o_track (as its subject) in front of s_track.  Track
    samples meet an event by range joins on its windows; the tests are conditional
    aggregates over them.  red: scenario, frame and track under a red signal.
    """
    events = found.groupBy("scenario_token", F.col("s_track").alias("o_track"), F.col("o_track").alias("s_track"), "start_us").agg(F.max("timestamp_us").alias("end_us"), F.max_by("conflict_x", "score").alias("cx"), F.max_by("conflict_y", "score").alias("cy"))
    events = cut(events)
    own = entities.select("scenario_token", "frame_index", "timestamp_us", "track_token", "agent_type", "x", "y", "cos_h", "sin_h", "length_m", "width_m", F.hypot("vx", "vy").alias("v"))
    before, after = int(t.yield_before_s * 1e6), int(t.yield_after_s * 1e6)
    window = F.col("timestamp_us").between(F.col("start_us") - before, F.col("end_us") + after)
    of = lambda track: events.join(own.withColumnRenamed("track_token", track), ["scenario_token", track]).where(window)
    s, o = of("s_track"), of("o_track")
    ahead = lambda: F.col("cos_h") * (F.col("cx") - F.col("x")) + F.col("sin_h") * (F.col("cy") - F.col("y"))
    aside = F.col("cos_h") * (F.col("cy") - F.col("y")) - F.col("sin_h") * (F.col("cx") - F.col("x"))
    key = ["scenario_token", "s_track", "o_track", "start_us"]
    s = s.where(is_vehicle(F.col("agent_type"))).withColumns({"far": F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")), "ahead": ahead(), "outside": (F.abs(ahead()) > F.col("length_m") / 2 + 0.25) | (F.abs(aside) > F.col("width_m") / 2 + 0.25)})
    o = o.where(is_dynamic(F.col("agent_type"))).withColumns({"o_far": F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")), "o_ahead": ahead()})
    base = s.where("timestamp_us <= start_us").groupBy(*key).agg(F.max("v").alias("base_v")).where(F.col("base_v") >= t.yield_baseline_speed)
    drop = F.greatest(F.lit(t.yield_speed_drop), t.yield_relative_drop * F.col("base_v"))
    near = s.join(base, key).withColumn("drop", drop).where((F.col("timestamp_us") <= F.col("end_us")) & (F.col("far") <= t.yield_conflict_distance) & (F.col("ahead") >= -0.25))
    later = Window.partitionBy(*key).orderBy("timestamp_us").rowsBetween(0, Window.unboundedFollowing)
    react = near.withColumn("later_v", F.min("v").over(later)).where((F.col("base_v") - F.col("v") >= F.col("drop") / 2) & (F.col("base_v") - F.col("later_v") >= F.col("drop")))
    react = react.groupBy(*key).agg(F.min("timestamp_us").alias("reaction_us"), F.min_by(F.struct("x", "y", "far"), "timestamp_us").alias("at"))
    meet = s.select(*key, "timestamp_us", F.col("v").alias("s_v"), F.col("far").alias("s_far"), F.col("ahead").alias("s_ahead")).join(o.select(*key, "timestamp_us", F.col("v").alias("o_v"), "o_far", "o_ahead"), [*key, "timestamp_us"]).join(react, key)
    rivals = meet.where((F.col("timestamp_us") <= F.col("reaction_us")) & (F.col("s_v") >= 0.5) & (F.col("o_v") >= 0.3) & (F.col("s_ahead") > 0) & (F.col("o_ahead") > 0) & (F.abs(F.col("s_far") / F.col("s_v") - F.col("o_far") / F.col("o_v")) <= t.yield_eta_s)).select(*key).distinct()
    clear = o.where((F.col("timestamp_us") >= F.col("end_us")) & (F.col("o_ahead") <= -(F.col("length_m") / 2 + 0.25))).groupBy(*key).agg(F.min("timestamp_us").alias("clear_us"))
    both = cut(react.join(rivals, key, "left_semi").join(clear, key))
    stay = s.join(both, key).where(F.col("timestamp_us").between(F.col("reaction_us"), F.col("clear_us"))).groupBy(*key).agg(F.min("outside").alias("out")).where("out")
    on = s.join(both, key).where((F.col("timestamp_us") > F.col("clear_us")) & (F.col("v") >= t.yield_proceed_speed) & (F.hypot(F.col("x") - F.col("at.x"), F.col("y") - F.col("at.y")) >= t.yield_proceed_distance) & ((F.col("far") < F.col("at.far")) | (F.col("ahead") <= 0)))
    go = on.groupBy(*key).agg(F.min("timestamp_us").alias("proceed_us"))
    out = both.join(stay, key, "left_semi").join(go, key).select(*key, "reaction_us", "clear_us", "proceed_us")
    if red is not None:
        stopped = out.join(events.select(*key, "end_us"), key).join(red.select("scenario_token", F.col("track_token").alias("s_track"), F.col("timestamp_us").alias("red_us")), ["scenario_token", "s_track"]).where(F.col("red_us").between(F.col("reaction_us"), F.col("end_us")))
        out = out.join(stopped.select(*key).distinct(), key, "left_anti")
    return out

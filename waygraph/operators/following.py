"""follows and queuesBehind: the nearest leader on an unbranched path, kept for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.functions.classifiers import is_vehicle
from waygraph.operators.pairs import FRAME

LANES = ("lane", "lane_connector")


def unbranched_paths(map_objects: DataFrame, edges: DataFrame, hops: int = T.follow_hops) -> DataFrame:
    """src, dst, hops, offset: distance from src's start to dst's; each step leaves an object with exactly one way out.

    Built once for each map by as many joins as hops; the rows are at most objects times hops.
    """
    lanes = map_objects.where(F.col("kind").isin(*LANES)).select("map_name", F.col("object_id").alias("id"), "length_m")
    ways = edges.groupBy("map_name", "src_id").agg(F.count(F.lit(1)).alias("n"), F.min("dst_id").alias("next")).where("n = 1").drop("n")
    ways = ways.join(lanes.select("map_name", F.col("id").alias("src_id"), F.col("length_m").alias("step")), ["map_name", "src_id"])
    level = lanes.select("map_name", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hops"), F.lit(0.0).alias("offset"), F.array("id").alias("seen"))
    out = level
    for hop in range(1, hops + 1):
        level = (
            level.join(ways, (level["map_name"] == ways["map_name"]) & (level["dst"] == ways["src_id"]))
            .where(~F.array_contains("seen", F.col("next")))
            .select(level["map_name"], "src", F.col("next").alias("dst"), F.lit(hop).alias("hops"), (F.col("offset") + F.col("step")).alias("offset"), F.array_append("seen", F.col("next")).alias("seen"))
        )
        out = out.unionByName(level)
    return out.drop("seen")


def leaders(matched: DataFrame, paths: DataFrame, scenarios: DataFrame, t: Thresholds = T) -> DataFrame:
    """FRAME, s_track, o_track, distance, gap, s_forward, o_forward, headway_s, mode: each vehicle's nearest one ahead, unless the next is as near.

    Vehicles meet by equi-joins through the path table, not each with each.  An
    invalid but nearest one hides those behind it: mode is then null.
    """
    half = (F.abs(F.cos(F.col("heading") - F.col("map_heading"))) * F.col("length_m") + F.abs(F.sin(F.col("heading") - F.col("map_heading"))) * F.col("width_m")) / 2
    own = matched.where(is_vehicle(F.col("agent_type")) & ~F.upper("agent_type").contains("BICYCLE") & F.col("primary_id").isNotNull() & ~F.col("ambiguous")).join(scenarios.select("scenario_token", "map_name"), "scenario_token")
    own = own.select(
        "map_name", *FRAME, "track_token", "primary_id", "progress", "travel_heading",
        F.greatest(F.lit(0.0), F.col("progress") - half).alias("rear"),
        F.least(F.col("baseline_length"), F.col("progress") + half).alias("front"),
        (F.col("vx") * F.cos("map_heading") + F.col("vy") * F.sin("map_heading")).alias("forward"),
        "x", "y", "heading",
    )
    s = own.select("map_name", *FRAME, F.col("primary_id").alias("src"), *(F.col(c).alias(f"s_{c}") for c in ("track_token", "progress", "front", "forward", "travel_heading")))
    o = own.select("map_name", *FRAME, F.col("primary_id").alias("dst"), *(F.col(c).alias(f"o_{c}") for c in ("track_token", "progress", "rear", "forward", "travel_heading")))
    both = s.join(paths, ["map_name", "src"]).join(o, ["map_name", *FRAME, "dst"]).where("s_track_token != o_track_token")
    both = both.withColumn("distance", F.col("offset") + F.col("o_progress") - F.col("s_progress")).withColumn("gap", F.col("offset") + F.col("o_rear") - F.col("s_front"))
    both = both.where(F.col("distance") > t.distance_epsilon)
    near = Window.partitionBy(*FRAME, "s_track_token").orderBy("distance", "gap", "o_track_token")
    first = both.withColumn("rank", F.row_number().over(near)).withColumn("next", F.lead("distance").over(near)).where("rank = 1")
    first = first.where(F.col("next").isNull() | (F.col("next") - F.col("distance") > t.leader_tie))
    headway = F.when(F.col("s_forward") > t.forward_speed, F.col("gap") / F.col("s_forward"))
    sound = (
        F.col("s_travel_heading").isNotNull()
        & F.col("o_travel_heading").isNotNull()
        & (F.col("gap") > t.distance_epsilon)
        & (F.col("s_forward") >= -t.follow_reverse_speed)
        & (F.col("o_forward") >= -t.follow_reverse_speed)
        & (F.col("gap") <= t.follow_distance)
    )
    mode = F.when(sound, F.when(headway.between(0, t.follow_headway_s) & (headway > 0), "moving").when((F.col("s_forward") <= t.queue_speed) & (F.col("o_forward") <= t.queue_leader_speed) & (F.col("gap") <= t.queue_gap), "queue"))
    return first.select(*FRAME, F.col("s_track_token").alias("s_track"), F.col("o_track_token").alias("o_track"), "distance", "gap", "s_forward", "o_forward", headway.alias("headway_s"), mode.alias("mode"))


def streaks(rows: DataFrame, frames: DataFrame, key: tuple[str, ...], t: Thresholds = T) -> DataFrame:
    """rows with start_us and duration_s of the run of consecutive frames that each lies in."""
    order = Window.partitionBy("scenario_token").orderBy("frame_index")
    gap = (F.col("timestamp_us") - F.lag("timestamp_us").over(order)) / 1e6
    step = F.when((F.col("frame_index") == F.lag("frame_index").over(order) + 1) & (gap <= t.sample_interval_s * t.maximum_gap_factor), 0).otherwise(1)
    parts = frames.withColumn("part", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("scenario_token", "frame_index", "part")
    own = Window.partitionBy("scenario_token", *key).orderBy("frame_index")
    df = rows.join(parts, ["scenario_token", "frame_index"]).withColumn("island", F.col("frame_index") - F.row_number().over(own))
    run = Window.partitionBy("scenario_token", *key, "part", "island").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("start_us", F.first("timestamp_us").over(run)).withColumn("duration_s", (F.col("timestamp_us") - F.col("start_us")) / 1e6).drop("island", "part")


def follow_facts(found: DataFrame, frames: DataFrame, t: Thresholds = T) -> DataFrame:
    """follows where the same leader has held long enough, queuesBehind where the queue has."""
    valid = found.where("mode is not null")
    columns = [*FRAME, "s_track", "o_track", "start_us", "duration_s", "gap"]
    lasting = lambda df, name: streaks(df, frames, ("s_track", "o_track"), t).where(F.col("duration_s") >= t.follow_duration_s).select(F.lit(name).alias("predicate"), *columns)
    return lasting(valid, "follows").unionByName(lasting(valid.where("mode = 'queue'"), "queuesBehind"))



"""Families that need no later frames, over a stream of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.operators.entities import KEYS, motion_facts, states, with_motion
from waygraph.operators.pairs import ego_pairs, kinematic_facts, with_kinematics


def stream_motion(entities: DataFrame, t: Thresholds = T) -> DataFrame:
    """Motion facts of each arriving entity; no state."""
    return motion_facts(with_motion(entities, t))


def stream_speed_states(entities: DataFrame, t: Thresholds = T) -> DataFrame:
    return states(with_motion(entities, t), KEYS, [F.col("speed_state")])


def stream_sessions(entities: DataFrame, event_time: str, late: str = "10 seconds", t: Thresholds = T) -> DataFrame:
    """Runs of a track without a gap, as session windows: count and span once the watermark has passed."""
    gap = f"{int(t.sample_interval_s * t.maximum_gap_factor * 1000)} milliseconds"
    runs = entities.withWatermark(event_time, late).groupBy("scenario_token", "track_token", F.session_window(event_time, gap).alias("run"))
    return runs.agg(F.count(F.lit(1)).alias("n_frames"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"))


def stream_frame_counts(entities: DataFrame, event_time: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Entities and movers in tumbling windows."""
    windows = with_motion(entities).withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("w"), "scenario_token")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("speed_state") == "isMoving").cast("long")).alias("n_moving"))


def pair_batch(batch: DataFrame) -> DataFrame:
    """For foreachBatch: kinematic facts of the ego's pairs among whole frames."""
    return kinematic_facts(with_kinematics(ego_pairs(batch)))

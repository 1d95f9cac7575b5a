"""Facts of single road users: structure, pose, size, motion, and their history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.functions.angles import mean_of_two, wrap
from waygraph.functions.classifiers import acceleration_state, continuous, speed_state

TRACK = ("scenario_token", "track_token")
KEYS = ("scenario_token", "frame_index", "timestamp_us", "track_token")


def entity_id(scenario: Column, track: Column, time_us: Column, is_ego: Column) -> Column:
    """Name of a state; the scenario is in it, as tracks of several scenarios may have one token."""
    return F.when(is_ego, F.concat_ws(":", F.lit("ego"), scenario, time_us.cast("string"))).otherwise(F.concat_ws(":", F.lit("agent"), scenario, track, time_us.cast("string")))


def ego_velocity(entities: DataFrame, body_vx: str = "body_vx", body_vy: str = "body_vy", omega: str | None = None, rear_to_center: str | None = None) -> DataFrame:
    """Ego velocity from the body frame into the global one; a rear-axle velocity gains the turn's lateral part."""
    lateral = F.col(body_vy)
    if omega and rear_to_center:
        lateral = lateral + F.col(omega) * F.col(rear_to_center)
    turned_x = F.col("cos_h") * F.col(body_vx) - F.col("sin_h") * lateral
    turned_y = F.col("sin_h") * F.col(body_vx) + F.col("cos_h") * lateral
    return entities.withColumn("vx", F.when(F.col("is_ego"), turned_x).otherwise(F.col("vx"))).withColumn("vy", F.when(F.col("is_ego"), turned_y).otherwise(F.col("vy")))


def with_motion(entities: DataFrame, t: Thresholds = T) -> DataFrame:
    """speed, velocity_heading (of movers), speed_state, acceleration."""
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    df = entities.withColumn("speed", speed).withColumn("entity_id", entity_id(F.col("scenario_token"), F.col("track_token"), F.col("timestamp_us"), F.col("is_ego")))
    return df.withColumns(
        {
            "velocity_heading": F.when(F.col("speed") >= t.direction_speed, wrap(F.atan2("vy", "vx"))),
            "speed_state": speed_state(F.col("speed"), F.col("agent_type"), t),
            "acceleration": F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")),
        }
    )


def with_history(moving: DataFrame, t: Thresholds = T) -> DataFrame:
    """Differences from the last observation, counts and spans in all and since the last gap, and the robust acceleration of the last few.

    All windows share one partitioning by track and one sort by frame.
    """
    order = Window.partitionBy(*TRACK).orderBy("frame_index")
    last = lambda c: F.lag(c).over(order)
    df = moving.withColumns({f"last_{c}": last(c) for c in ("frame_index", "timestamp_us", "x", "y", "heading", "speed", "entity_id")})
    df = df.withColumn("continuous", continuous(F.col("frame_index"), F.col("last_frame_index"), F.col("timestamp_us"), F.col("last_timestamp_us"), t))
    df = df.withColumn("streak", F.sum((~F.col("continuous")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    dx, dy = F.col("x") - F.col("last_x"), F.col("y") - F.col("last_y")
    dt = (F.col("timestamp_us") - F.col("last_timestamp_us")) / 1e6
    moved = F.sqrt(dx * dx + dy * dy)
    on = lambda c: F.when(F.col("continuous"), c)
    df = df.withColumns(
        {
            "delta_time_s": on(dt),
            "displacement_m": on(moved),
            "heading_change": on(wrap(F.col("heading") - F.col("last_heading"))),
            "displacement_heading": on(F.when(moved >= t.direction_displacement, wrap(F.atan2(dy, dx)))),
            "speed_change": on(F.col("speed") - F.col("last_speed")),
            "estimated_acceleration": on((F.col("speed") - F.col("last_speed")) / dt),
        }
    )
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    began = lambda c: F.last(F.when(~F.col("continuous"), F.col(c)), ignorenulls=True).over(seen)
    df = df.withColumn("total_count", F.row_number().over(order).cast("long"))
    df = df.withColumns(
        {
            "total_span_s": (F.col("timestamp_us") - F.first("timestamp_us").over(seen)) / 1e6,
            "continuous_count": F.col("total_count") - began("total_count") + 1,
            "continuous_duration_s": (F.col("timestamp_us") - began("timestamp_us")) / 1e6,
        }
    )
    # nulls come first: those of other streaks and those without a value
    recent = (F.when(F.col("continuous_count") > i, F.lag("estimated_acceleration", i).over(order)) for i in range(t.acceleration_window))
    df = df.withColumn("recent", F.array(*recent))
    df = df.withColumn("samples", sum(F.get("recent", F.lit(i)).isNotNull().cast("int") for i in range(t.acceleration_window))).withColumn("recent", F.sort_array("recent"))
    n, nulls = F.col("samples"), t.acceleration_window - F.col("samples")
    middle = (F.get("recent", nulls + F.floor((n - 1) / 2).cast("int")) + F.get("recent", nulls + F.floor(n / 2).cast("int"))) / 2
    df = df.withColumn("robust_acceleration", F.when(n >= t.minimum_acceleration_samples, middle))
    return df.withColumn("acceleration_state", acceleration_state(F.col("robust_acceleration"), t)).drop("recent", "samples")


def unpivot(df: DataFrame, keys: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """keys, predicate and value (double) of each value that isn't null; one pass, no shuffle."""
    pairs = F.array(*(F.struct(F.lit(p).alias("predicate"), c.cast("double").alias("value")) for p, c in values.items()))
    return df.select(*keys, F.inline(pairs)).where("value is not null")


def unpivot_text(df: DataFrame, keys: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """keys, predicate and object (string) of each value that isn't null."""
    pairs = F.array(*(F.struct(F.lit(p).alias("predicate"), c.cast("string").alias("object")) for p, c in values.items()))
    return df.select(*keys, F.inline(pairs)).where("object is not null")


def states(df: DataFrame, keys: tuple[str, ...], columns: list[Column]) -> DataFrame:
    """keys and predicate: the labels in the columns, where there are any."""
    return df.select(*keys, F.explode(F.array(*columns)).alias("predicate")).where("predicate is not null")


def structure_facts(entities: DataFrame, scenarios: DataFrame, state: Callable = unpivot_text) -> DataFrame:
    """Text facts of scenario, frame and track."""
    df = entities.join(scenarios.select("scenario_token", "scenario_type", "log_name"), "scenario_token")
    me = entity_id(F.col("scenario_token"), F.col("track_token"), F.col("timestamp_us"), F.col("is_ego"))
    ego, agent = F.col("is_ego"), ~F.col("is_ego")
    return state(
        df,
        KEYS,
        {
            "hasTimestamp": F.when(ego, F.col("timestamp_us")),
            "hasScenarioType": F.when(ego & (F.col("frame_index") == 0), F.col("scenario_type")),
            "hasLogName": F.when(ego & (F.col("frame_index") == 0), F.col("log_name")),
            "hasEgoState": F.when(ego, me),
            "hasTrackedObject": F.when(agent, me),
            "hasTrackToken": F.when(agent, F.col("track_token")),
            "hasAgentType": F.when(agent, F.col("agent_type")),
        },
    )


def pose_facts(entities: DataFrame, rear_axle_m: float = 1.461, state: Callable = unpivot) -> DataFrame:
    """Pose and size; the ego's rear axle lies rear_axle_m behind its centre."""
    ego = F.col("is_ego")
    return state(
        entities,
        KEYS,
        {
            "hasX": F.col("x"),
            "hasY": F.col("y"),
            "hasHeading": F.col("heading"),
            "hasRearAxleX": F.when(ego, F.col("x") - rear_axle_m * F.col("cos_h")),
            "hasRearAxleY": F.when(ego, F.col("y") - rear_axle_m * F.col("sin_h")),
            "hasLength": F.col("length_m"),
            "hasWidth": F.col("width_m"),
            "hasHeight": F.col("height_m"),
            "hasArea": F.col("length_m") * F.col("width_m"),
        },
    )


def motion_facts(moving: DataFrame, state: Callable = unpivot) -> DataFrame:
    return state(
        moving,
        KEYS,
        {
            "hasVelocityX": F.col("vx"),
            "hasVelocityY": F.col("vy"),
            "hasSpeed": F.col("speed"),
            "hasVelocityHeading": F.col("velocity_heading"),
            "hasAccelerationX": F.col("ax"),
            "hasAccelerationY": F.col("ay"),
            "hasAcceleration": F.col("acceleration"),
        },
    )


def velocity_vectors(moving: DataFrame) -> DataFrame:
    """hasVelocity: vectors (vx, vy)."""
    return moving.where("vx is not null and vy is not null").select(*KEYS, F.lit("hasVelocity").alias("predicate"), F.array("vx", "vy").alias("vector"))


def temporal_facts(history: DataFrame, state: Callable = unpivot) -> DataFrame:
    """Numbers of the history; the observed count and duration are those since the last gap."""
    return state(
        history,
        KEYS,
        {
            "hasDeltaTimeFromPrevious": F.col("delta_time_s"),
            "hasDisplacementFromPrevious": F.col("displacement_m"),
            "hasHeadingChangeFromPrevious": F.col("heading_change"),
            "hasDisplacementHeading": F.col("displacement_heading"),
            "hasSpeedChangeFromPrevious": F.col("speed_change"),
            "hasEstimatedAcceleration": F.col("estimated_acceleration"),
            "hasObservedFrameCount": F.col("continuous_count"),
            "hasObservedDuration": F.col("continuous_duration_s"),
            "hasTotalObservedFrameCount": F.col("total_count"),
            "hasTotalObservedSpan": F.col("total_span_s"),
            "hasContinuousObservedFrameCount": F.col("continuous_count"),
            "hasContinuousObservedDuration": F.col("continuous_duration_s"),
        },
    )


def precedes(history: DataFrame) -> DataFrame:
    """The last observation precedes this one, where nothing is missing between."""
    return history.where("continuous").select(*KEYS, F.lit("precedes").alias("predicate"), F.col("last_entity_id").alias("subject_id"), F.col("entity_id").alias("object_id"))


def continuity_breaks(history: DataFrame) -> DataFrame:
    """Observations after a gap: where streaks start anew."""
    return history.where("last_frame_index is not null and not continuous").select(*KEYS, "last_frame_index", "last_timestamp_us")


def motion_states(history: DataFrame, state: Callable = states) -> DataFrame:
    return state(history, KEYS, [F.col("speed_state"), F.col("acceleration_state")])


def with_forward_speed(entities: DataFrame) -> DataFrame:
    """entities with forward_speed_seen: the way since the last observation along the mean of both headings, by the time; a track's first has that of the second."""
    order = Window.partitionBy("scenario_token", "track_token").orderBy("timestamp_us")
    lag = lambda c: F.lag(c).over(order)
    way = mean_of_two(lag("heading"), F.col("heading"))
    dt = (F.col("timestamp_us") - lag("timestamp_us")) / 1e6
    seen = F.when(dt > 0, (F.cos(way) * (F.col("x") - lag("x")) + F.sin(way) * (F.col("y") - lag("y"))) / dt)
    df = entities.withColumn("forward_speed_seen", seen).withColumn("first", lag("timestamp_us").isNull())
    return df.withColumn("forward_speed_seen", F.when(F.col("first"), F.lead("forward_speed_seen").over(order)).otherwise(F.col("forward_speed_seen"))).drop("first")

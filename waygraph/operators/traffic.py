"""Traffic signals: what they control, their state, and whom they still govern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.functions.classifiers import uses_lanes
from waygraph.operators.entities import KEYS

FRAME = ("scenario_token", "frame_index", "timestamp_us")


def signal_state(status: Column) -> Column:
    """RED, YELLOW, GREEN or UNKNOWN; an enumeration's prefix is dropped."""
    name = F.upper(F.trim(F.substring_index(F.coalesce(status, F.lit("")), ".", -1)))
    return F.when(name.isin("AMBER", "ORANGE", "YELLOW"), "YELLOW").when(name.isin("RED", "GREEN"), name).otherwise("UNKNOWN")


def signals(lights: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row per frame and connector: signal_id, state (UNKNOWN where rows conflict), n_rows."""
    named = lights.where(F.trim(F.coalesce("connector_id", F.lit(""))).isNotNull() & ~F.lower(F.trim(F.coalesce("connector_id", F.lit("")))).isin("", "unknown"))
    each = named.withColumn("state", signal_state(F.col("status"))).groupBy(*FRAME, F.trim("connector_id").alias("connector_id")).agg(F.min("state").alias("lo"), F.max("state").alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    df = each.withColumn("state", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("UNKNOWN")).withColumn("conflict", F.col("lo") != F.col("hi"))
    df = df.join(scenarios.select("scenario_token", "map_name"), "scenario_token")
    return df.select(*FRAME, "connector_id", "state", "conflict", "n_rows", F.concat_ws(":", F.lit("traffic_signal"), "map_name", F.lit("control"), "connector_id").alias("signal_id"))


def with_controls(matched: DataFrame, found: DataFrame) -> DataFrame:
    """matched with controls: the controlled connectors that an entity is on or that its lane leads to."""
    lit = found.groupBy("scenario_token", "frame_index").agg(F.collect_set("connector_id").alias("lit"))
    own = F.array_compact(F.concat(F.array("primary_id"), F.col("outgoing")))
    return matched.join(lit, ["scenario_token", "frame_index"], "left").withColumn("controls", F.coalesce(F.array_intersect(own, "lit"), F.array().cast("array<string>"))).drop("lit")


def red_frames(matched: DataFrame, found: DataFrame) -> DataFrame:
    """Frames of tracks on a lane of whose outgoing connectors exactly one is controlled, and that one is red."""
    ahead = matched.where("primary_kind = 'lane'").select(*KEYS, F.explode("outgoing").alias("connector_id")).join(found.select(*FRAME, "connector_id", "state"), [*FRAME, "connector_id"])
    return ahead.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("state").alias("state")).where("n = 1 and state = 'RED'").select(*KEYS)


def signal_facts(found: DataFrame) -> DataFrame:
    """controls and hasSignalState."""
    rows = F.array(
        F.struct(F.lit("controls").alias("predicate"), F.concat(F.lit("controlled_movement:"), "connector_id").alias("object")),
        F.struct(F.lit("hasSignalState").alias("predicate"), F.concat(F.lit("signal_state:"), "state").alias("object")),
    )
    return found.select(*FRAME, "signal_id", F.explode(rows).alias("p")).select(*FRAME, "signal_id", "p.predicate", "p.object")


def relevant_signals(matched: DataFrame, member: DataFrame, found: DataFrame) -> DataFrame:
    """isRelevantSignal: users of lanes before exactly one controlled connector whose footprint isn't on a controlled one yet."""
    users = matched.where(F.col("is_ego") | uses_lanes(F.col("agent_type")))
    controlled = found.select(*FRAME, F.col("connector_id").alias("object_id"), "signal_id")
    entered = member.join(controlled, [*FRAME, "object_id"], "left_semi").select(*KEYS).distinct()
    ahead = users.where("primary_kind = 'lane'").select(*KEYS, F.explode("outgoing").alias("object_id")).join(controlled, [*FRAME, "object_id"])
    one = ahead.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("signal_id").alias("signal_id")).where("n = 1")
    return one.join(entered, list(KEYS), "left_anti").select(*KEYS, F.lit("isRelevantSignal").alias("predicate"), "signal_id")

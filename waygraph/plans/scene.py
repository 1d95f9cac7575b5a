"""Driving scenes derived from the events table.

The engine reads canonical tables (scenarios, frames, entities, traffic_lights,
route, map_objects, map_edges, map_adjacency).  Here they are derived from events:
400 events make a scenario of 50 frames and 8 tracks.  Every expression below is
plain SQL that any engine evaluates alike, so SQL can state the same scene.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of columns over events; each may use those of the steps before.
STEPS: tuple[dict[str, str], ...] = (
    {
        "scenario_no": "cast(floor(event_id / 400) as bigint)",
        "frame_index": "cast(floor((event_id % 400) / 8) as int)",
        "slot": "cast(event_id % 8 as int)",
        "jitter": "(cast(floor(value) as bigint) % 5 - 2) / 10.0E0",
    },
    {
        "timestamp_us": "cast(frame_index * 500000 + floor(frame_index / 17) * 1000000 as bigint)",
        "shift": "(scenario_no % 7) * 1.5E0",
        "pace": "((scenario_no * 7 + slot * 3) % 5) * 0.25E0",
        "lateral_f": "case when slot = 2 and frame_index >= 4 then least(frame_index - 4, 4) - case when frame_index >= 22 then least(frame_index - 22, 4) else 0 end when slot = 3 and frame_index >= 28 then least(frame_index - 28, 4) else 0 end",
        "lateral_v": "case when slot = 2 and frame_index between 4 and 7 then 2.0E0 when slot = 2 and frame_index between 22 and 25 then -2.0E0 when slot = 3 and frame_index between 28 and 31 then 2.0E0 else 0.0E0 end",
    },
    {
        "t": "timestamp_us / 1000000.0E0",
        # ego brakes before the crosswalk for the pedestrian, and drives on
        "brake_t": "(160.0E0 - shift) / (8.0E0 + ((scenario_no * 7) % 5) * 0.25E0)",
        "v": "case slot when 0 then 8.0E0 + pace when 1 then 11.0E0 + pace when 2 then 12.0E0 + pace when 3 then 6.0E0 + pace when 4 then 0.0E0 when 5 then 3.0E0 when 6 then 1.25E0 else 0.0E0 end",
    },
    {
        "x": "case slot when 0 then 20.0E0 + shift + v * t - (v - 1.5E0) * least(greatest(t - brake_t, 0.0E0), 4.0E0) when 1 then 45.0E0 + shift + v * t when 2 then 5.0E0 + shift + v * t when 3 then 30.0E0 + shift + v * t when 4 then 183.0E0 + shift * 0.5E0 when 5 then 220.0E0 when 6 then 192.0E0 else 300.0E0 end",
        "y": "case slot when 0 then 4.0E0 when 1 then 4.0E0 when 2 then 4.0E0 + lateral_f when 3 then 0.0E0 + lateral_f when 4 then 0.0E0 when 5 then -74.0E0 + v * t when 6 then 4.0E0 + v * (t - brake_t - 2.931283E0) else -1.0E0 end",
        "vx": "case when slot = 0 and t > brake_t and t < brake_t + 4.0E0 then 1.5E0 + jitter when slot in (0, 1, 2, 3) then v + jitter else 0.0E0 end",
        "vy": "case when slot in (5, 6) then v else lateral_v end",
        "cos_h": "case when slot in (5, 6) then 0.0E0 else 1.0E0 end",
        "sin_h": "case when slot in (5, 6) then 1.0E0 else 0.0E0 end",
    },
    {
        "scenario_token": "concat('sc', cast(scenario_no as varchar(20)))",
        "track_token": "case when slot = 0 then 'ego' else concat('t', cast(slot as varchar(20))) end",
        "is_ego": "slot = 0",
        "agent_type": "case slot when 0 then 'EGO' when 5 then 'BICYCLE' when 6 then 'PEDESTRIAN' when 7 then 'BARRIER' else 'VEHICLE' end",
        "heading": "case when slot in (5, 6) then 1.5707963267948966E0 else 0.0E0 end",
        "length_m": "case when slot in (0, 1, 2, 3, 4) then 4.5E0 when slot = 5 then 1.8E0 when slot = 6 then 0.8E0 else 1.0E0 end",
        "width_m": "case when slot in (0, 1, 2, 3, 4) then 2.0E0 when slot = 5 then 0.8E0 when slot = 6 then 0.8E0 else 2.0E0 end",
        "height_m": "case when slot in (5, 6) then cast(null as double) else 1.5E0 end",
        "ax": "case when slot = 0 then jitter else cast(null as double) end",
        "ay": "case when slot = 0 then 0.0E0 else cast(null as double) end",
    },
)
KEEP = "not (slot > 0 and event_id % 13 = 5)"
ENTITY_COLUMNS = ("scenario_token", "frame_index", "timestamp_us", "track_token", "slot", "is_ego", "agent_type", "x", "y", "heading", "cos_h", "sin_h", "vx", "vy", "length_m", "width_m", "height_m", "ax", "ay")


def entities_sql() -> str:
    """The same entities as SQL over events."""
    inner = "events"
    for step in STEPS:
        inner = f"(select *, {', '.join(f'{e} as {n}' for n, e in step.items())} from {inner})"
    return f"select {', '.join(ENTITY_COLUMNS)} from {inner} where {KEEP}"


def entities(events: DataFrame) -> DataFrame:
    df = events.select("event_id", "value")
    for step in STEPS:
        df = df.select("*", *(F.expr(e.replace("varchar(20)", "string")).alias(n) for n, e in step.items()))
    return df.where(KEEP).select(*ENTITY_COLUMNS)


def _box(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def map_rows() -> tuple[list, list, list]:
    """Objects (id, kind, polygon, baseline, length, speed limit, roadblock, intersection), edges and neighbours (id, side, id)."""
    objects, edges, adjacent = [], [], []
    for k in range(3):
        y = 4.0 * k
        for part, kind, a, b, roadblock in (("A", "lane", 0.0, 200.0, "RA"), ("C", "lane_connector", 200.0, 240.0, "RC"), ("B", "lane", 240.0, 700.0, "RB")):
            objects.append((f"{part}{k}", kind, _box(a, y - 2, b, y + 2), [(a, y), (b, y)], b - a, 13.5, roadblock, "I0" if part == "C" else None))
        edges += [(f"A{k}", f"C{k}"), (f"C{k}", f"B{k}")]
        if k < 2:
            for part in "AB":
                adjacent += [(f"{part}{k}", "left", f"{part}{k + 1}"), (f"{part}{k + 1}", "right", f"{part}{k}")]
    objects.append(("C2R", "lane_connector", _box(200.0, 6.0, 240.0, 10.0), [(200.0, 8.0), (240.0, 8.0)], 40.0, 8.0, "RC", "I0"))
    edges.append(("A2", "C2R"))
    objects.append(("X0", "lane", _box(218.0, -80.0, 222.0, 60.0), [(220.0, -80.0), (220.0, 60.0)], 140.0, 8.0, "RX", None))
    objects.append(("I0", "intersection", _box(200.0, -2.0, 240.0, 10.0), [], None, None, None, "I0"))
    objects.append(("P0", "carpark", _box(186.5, -12.0, 191.0, 1.0), [], None, None, None, None))
    objects.append(("D0", "drivable_area", _box(196.0, -6.0, 244.0, 12.0), [], None, None, None, None))
    objects.append(("W0", "crosswalk", _box(190.0, -4.0, 194.0, 14.0), [], None, None, None, None))
    return objects, edges, adjacent


MAP_SCHEMA = "map_name string, kind string, object_id string, polygon array<struct<x:double,y:double>>, baseline array<struct<x:double,y:double>>, length_m double, speed_limit_mps double, roadblock_id string, intersection_id string"


@dataclass
class Scene:
    """The canonical tables."""

    scenarios: DataFrame
    frames: DataFrame
    entities: DataFrame
    traffic_lights: DataFrame
    route: DataFrame
    map_objects: DataFrame
    map_edges: DataFrame
    map_adjacency: DataFrame


def scene(spark: SparkSession, sf_dir: str) -> Scene:
    """The scene of events.parquet."""
    own = entities(spark.read.parquet(f"{sf_dir}/events.parquet"))
    frames = own.where("is_ego").select("scenario_token", "frame_index", "timestamp_us")
    number = F.expr("cast(substring(scenario_token, 3) as bigint)")
    scenarios = frames.groupBy("scenario_token").agg(F.count(F.lit(1)).alias("n_frames")).select(
        "scenario_token", F.concat(F.lit("log"), (number % 3).cast("string")).alias("log_name"), F.when(number % 2 == 0, "following").otherwise("crossing").alias("scenario_type"), F.lit("m0").alias("map_name"), "n_frames"
    )
    turn = (F.floor(F.col("frame_index") / 10) + number) % 3
    state = F.when(turn == 0, "GREEN").when(turn == 1, "amber").otherwise("RED")
    lights = frames.select("scenario_token", "frame_index", "timestamp_us", F.explode(F.array(F.lit("C0"), F.lit("C1"), F.lit("C2"))).alias("connector_id"), state.alias("status"))
    odd = frames.where("frame_index % 25 = 0").select("scenario_token", "frame_index", "timestamp_us", F.lit("C2").alias("connector_id"), F.lit("TrafficLightStatusType.OFF").alias("status"))
    objects, edges, adjacent = map_rows()
    rows = [("m0", kind, i, poly, base, length, limit, roadblock, crossing) for i, kind, poly, base, length, limit, roadblock, crossing in objects]
    return Scene(
        scenarios,
        frames,
        own,
        lights.unionByName(odd),
        scenarios.select("scenario_token", F.posexplode(F.array(F.lit("RA"), F.lit("RC"), F.lit("RB"))).alias("ordinal", "roadblock_id")),
        spark.createDataFrame(rows, MAP_SCHEMA),
        spark.createDataFrame([("m0", a, b) for a, b in edges], "map_name string, src_id string, dst_id string"),
        spark.createDataFrame([("m0", a, s, b) for a, s, b in adjacent], "map_name string, object_id string, side string, adjacent_id string"),
    )

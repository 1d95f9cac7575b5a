"""How far road users are from the map's areas, and what that allows: crossings near roads and crosswalks, none from car parks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.functions import kernels
from waygraph.functions.classifiers import is_vehicle
from waygraph.operators.entities import KEYS

CELL = 50.0
KINDS = ("lane", "lane_connector", "drivable_area", "intersection", "crosswalk", "carpark")
DISTANCES = ("lane_distance", "road_distance", "intersection_distance", "crosswalk_distance", "carpark_distance")
#: Least area of a footprint in a car park.
IN_CARPARK = 1e-6


def _near(users: DataFrame, map_objects: DataFrame, radius: float) -> DataFrame:
    """KEYS, kind, distance, occupies: of users' centres to the polygons within the radius.

    A polygon goes to all cells that it comes within the radius of, so that a user's own
    cell has every polygon that can be near enough: one equi-join proves the nearest.
    """
    bound = lambda f, c: f(F.transform("polygon", lambda p: p[c]))
    cells = lambda c: F.explode(F.sequence(F.floor((bound(F.array_min, c) - radius) / CELL), F.floor((bound(F.array_max, c) + radius) / CELL)))
    tiles = map_objects.where(F.col("kind").isin(*KINDS)).withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    tiles = tiles.select("map_name", "cx", "cy", "object_id", "kind", "polygon", *(bound(f, c).alias(f"{n}{c}") for n, f in (("lo_", F.array_min), ("hi_", F.array_max)) for c in "xy"))
    own = users.select(*KEYS, "map_name", "x", "y", "cos_h", "sin_h", "length_m", "width_m", F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy"))
    inside = lambda c: F.col(c).between(F.col(f"lo_{c}") - radius, F.col(f"hi_{c}") + radius)
    pairs = own.join(tiles, ["map_name", "cx", "cy"]).where(inside("x") & inside("y")).drop("cx", "cy", "lo_x", "lo_y", "hi_x", "hi_y", "map_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            num = lambda c: np.nan_to_num(col(c).to_numpy(zero_copy_only=False).astype(float))
            p, shapes = np.stack([num("x"), num("y")], 1), kernels.boxes(*map(num, ("x", "y", "cos_h", "sin_h", "length_m", "width_m")))
            far, occupies = np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows, bool)
            kinds = np.array(col("kind").to_pylist(), object)
            codes = np.asarray(col("object_id").dictionary_encode().indices)
            for code in np.unique(codes):
                rows = np.flatnonzero(codes == code)
                poly = np.array([(q["x"], q["y"]) for q in col("polygon")[int(rows[0])].as_py()])
                far[rows] = kernels.polygon_distance(p[rows], poly)
                if kinds[rows[0]] == "carpark":
                    occupies[rows] = (far[rows] == 0) | (kernels.polygon_overlap(shapes[rows], poly) > IN_CARPARK)
            keep = far <= radius
            arrays = [col(c) for c in (*KEYS, "kind")] + [pa.array(far), pa.array(occupies)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "kind", "distance", "occupies"]).filter(pa.array(keep | occupies))

    schema = ", ".join(f"{c} {users.schema[c].dataType.simpleString()}" for c in KEYS)
    return pairs.mapInArrow(run, f"{schema}, kind string, distance double, occupies boolean")


def area_distances(users: DataFrame, scenarios: DataFrame, map_objects: DataFrame, t: Thresholds = T) -> DataFrame:
    """KEYS, distances to the nearest area of each sort, in_carpark. A distance is null where none lies within the radius.

    Users of maps without any area have no row.
    """
    maps = map_objects.where(F.col("kind").isin(*KINDS)).select("map_name").distinct()
    own = users.join(scenarios.select("scenario_token", "map_name"), "scenario_token").join(maps, "map_name", "left_semi")
    least = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds) & (F.col("distance") <= t.crossing_map_radius), F.col("distance")))
    near = _near(own, map_objects, t.crossing_map_radius).groupBy(*KEYS)
    near = near.agg(
        least("lane", "lane_connector").alias("lane_distance"),
        least("lane", "lane_connector", "drivable_area", "intersection").alias("road_distance"),
        *(least(kind).alias(f"{kind}_distance") for kind in ("intersection", "crosswalk", "carpark")),
        F.max("occupies").alias("in_carpark"),
    )
    return own.select(*KEYS).join(near, list(KEYS), "left").withColumn("in_carpark", F.coalesce("in_carpark", F.lit(False)))


def still_tracks(entities: DataFrame, t: Thresholds = T) -> DataFrame:
    """scenario_token, track_token of those but pedestrians and ego that stand for long: duration, displacement from the first place, median speed."""
    first = F.min_by(F.struct("x", "y"), "timestamp_us")
    start = entities.groupBy("scenario_token", "track_token").agg(first.alias("at"), ((F.max("timestamp_us") - F.min("timestamp_us")) / 1e6).alias("seen_s"), F.percentile(F.hypot("vx", "vy"), 0.5).alias("median_speed"), F.upper(F.first("agent_type")).alias("kind"))
    start = start.where((F.col("seen_s") >= t.parked_duration_s) & (F.col("median_speed") <= t.parked_speed) & ~F.col("kind").rlike("PEDESTRIAN|EGO"))
    far = entities.join(start, ["scenario_token", "track_token"]).groupBy("scenario_token", "track_token").agg(F.max(F.hypot(F.col("x") - F.col("at.x"), F.col("y") - F.col("at.y"))).alias("moved"))
    return far.where(F.col("moved") <= t.parked_displacement).select("scenario_token", "track_token")


def gate(t: Thresholds = T, p: str = "") -> Column:
    """Why a road user with area_distances, agent_type and still takes part in no crossing; null where it may."""
    c = lambda name: F.col(f"{p}{name}")
    kind = F.upper(c("agent_type"))
    on_foot, on_bike = kind.contains("PEDESTRIAN"), kind.rlike("BICYCLE|CYCLIST") & ~kind.contains("MOTORCYCLIST")
    near = lambda name, most: F.coalesce(c(name) <= most, F.lit(False))
    at_crosswalk, by_road = near("crosswalk_distance", t.crossing_crosswalk_distance), near("road_distance", t.crossing_bicycle_road_distance)
    parked = c("still") & (near("carpark_distance", t.parked_lane_distance) | ~near("lane_distance", t.parked_lane_distance))
    motor = (is_vehicle(c("agent_type")) | kind.rlike("TRAILER")) & ~on_bike & ~on_foot
    return (
        F.when(c("in_carpark").isNull(), F.lit(None).cast("string"))
        .when(motor & c("in_carpark"), "in_carpark")
        .when(parked, "parked")
        .when(on_foot, F.when(~(at_crosswalk | near("intersection_distance", t.crossing_crosswalk_distance) & by_road), "far_from_crosswalk"))
        .when(on_bike, F.when(~(at_crosswalk | by_road), "far_from_crosswalk_and_road"))
        .when(~near("road_distance", t.crossing_road_distance), "far_from_road")
    )


def gates(users: DataFrame, scenarios: DataFrame, map_objects: DataFrame, t: Thresholds = T) -> DataFrame:
    """KEYS, reason of the users that take part in no crossing."""
    found = area_distances(users, scenarios, map_objects, t).join(users.select(*KEYS, "agent_type"), list(KEYS))
    still = still_tracks(users, t).withColumn("still", F.lit(True))
    found = found.join(still, ["scenario_token", "track_token"], "left").withColumn("still", F.coalesce("still", F.lit(False)))
    return found.select(*KEYS, gate(t).alias("reason")).where(F.col("reason").isNotNull())

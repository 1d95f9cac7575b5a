"""Road users on the map: memberships, the primary lane, progress, travel direction, topology of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from waygraph.config import T, Thresholds
from waygraph.functions import kernels
from waygraph.functions.angles import difference, mean_of_two
from waygraph.operators.entities import KEYS, unpivot, unpivot_text
from waygraph.plans.shared import cut

CELL = 50.0
#: Least reach of the map query about a footprint, in metres.
REACH, FOOTPRINT_MARGIN = 8.0, 4.0
ME = ("scenario_token", "frame_index", "track_token")
PAIR_KEYS = ("scenario_token", "frame_index", "timestamp_us", "tag", "s_track", "o_track")


def curvature(line: np.ndarray, progress: np.ndarray) -> np.ndarray:
    """Signed curvature of a polyline where progress lies: turn by length at the inner vertices, and between them by interpolation."""
    step = np.diff(line, axis=0)
    length = np.hypot(step[:, 0], step[:, 1])
    step, length = step[length > 0], length[length > 0]
    if len(length) < 2:
        return np.zeros(len(progress))
    turn = np.diff(np.arctan2(step[:, 1], step[:, 0]))
    turn = (turn + np.pi) % (2 * np.pi) - np.pi
    return np.interp(progress, np.cumsum(length)[:-1], turn / ((length[1:] + length[:-1]) / 2))


def candidates(entities: DataFrame, scenarios: DataFrame, map_objects: DataFrame, kinds: tuple[str, ...] = ("lane", "lane_connector")) -> DataFrame:
    """entities' keys with object_id, kind, center_covered, overlap_area, overlap_ratio, progress, lateral_offset, map_heading, curvature.

    Polygons go to the grid cells of their bounds, entities to their own cell: an
    equi-join on map and cell, whose matches an Arrow kernel refines exactly.
    """
    spread = lambda f, c: f(F.transform("polygon", lambda p: p[c]))
    cells = lambda c: F.sequence(F.floor((spread(F.array_min, c) - REACH) / CELL), F.floor((spread(F.array_max, c) + REACH) / CELL))
    tiles = map_objects.where(F.col("kind").isin(*kinds)).withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y")))
    # long footprints reach further than the polygons' margin, and go to all cells that they may touch
    more = F.greatest(F.lit(0.0), F.hypot(F.coalesce("length_m", F.lit(0.0)), F.coalesce("width_m", F.lit(0.0))) / 2 + FOOTPRINT_MARGIN - REACH)
    span = lambda c: F.sequence(F.floor((F.col(c) - more) / CELL), F.floor((F.col(c) + more) / CELL))
    own = entities.join(scenarios.select("scenario_token", "map_name"), "scenario_token").withColumn("xs", span("x")).withColumn("ys", span("y")).withColumn("cx", F.explode("xs")).withColumn("cy", F.explode("ys"))
    tiles = tiles.select("map_name", "cx", "cy", "object_id", "kind", "polygon", "baseline", F.get(cells("x"), F.lit(0)).alias("tx"), F.get(cells("y"), F.lit(0)).alias("ty"), *(spread(f, c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("low", F.array_min), ("high", F.array_max))))
    pairs = own.select(*KEYS, "map_name", "cx", "cy", "x", "y", "cos_h", "sin_h", "length_m", "width_m", F.get("xs", F.lit(0)).alias("ex"), F.get("ys", F.lit(0)).alias("ey")).join(tiles, ["map_name", "cx", "cy"])
    # both may share several cells; the first one counts
    pairs = pairs.where((F.col("cx") == F.greatest("ex", "tx")) & (F.col("cy") == F.greatest("ey", "ty"))).drop("ex", "ey", "tx", "ty")
    # a footprint off the polygon's bounds shares nothing with it, and its row goes to no kernel
    known = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    reach = lambda one, two: (F.abs(known(one) * known("length_m")) + F.abs(known(two) * known("width_m"))) / 2
    for c, h in (("x", reach("cos_h", "sin_h")), ("y", reach("sin_h", "cos_h"))):
        at = known(c)
        pairs = pairs.where(~((at - h > F.col(f"high_{c}") + 1e-5) | (at + h < F.col(f"low_{c}") - 1e-5))).drop(f"low_{c}", f"high_{c}")
    names = [*KEYS, "object_id", "kind"]
    doubles = ("overlap_area", "overlap_ratio", "progress", "lateral_offset", "map_heading", "curvature")
    schema = StructType([*(pairs.schema[n] for n in names), StructField("center_covered", BooleanType()), *(StructField(d, DoubleType()) for d in doubles)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xy = lambda pts: np.array([(p["x"], p["y"]) for p in pts]).reshape(-1, 2)
        for batch in batches:
            n = batch.num_rows
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            num = lambda c: np.nan_to_num(col(c).to_numpy(zero_copy_only=False).astype(float))
            p, shapes = np.stack([num("x"), num("y")], 1), kernels.boxes(*map(num, ("x", "y", "cos_h", "sin_h", "length_m", "width_m")))
            size = np.maximum(num("length_m") * num("width_m"), 1e-12)
            low, high = shapes.min(1), shapes.max(1)
            covered, out = np.zeros(n, bool), np.full((6, n), np.nan)
            codes = col("object_id").dictionary_encode()
            codes = np.asarray(codes.indices)
            for code in np.unique(codes):
                rows = np.flatnonzero(codes == code)
                first = int(rows[0])
                poly, line = xy(col("polygon")[first].as_py()), xy(col("baseline")[first].as_py() or [])
                # a box whose bounds are off the polygon's shares nothing with it
                rows = rows[((low[rows] <= poly.max(0) + 1e-6) & (high[rows] >= poly.min(0) - 1e-6)).all(1)]
                covered[rows] = kernels.in_polygon(p[rows], poly)
                out[0, rows] = kernels.polygon_overlap(shapes[rows], poly)
                out[1, rows] = np.clip(out[0, rows] / size[rows], 0, 1)
                rows = rows[covered[rows] | (out[0, rows] > 0)]
                if len(line) >= 2 and len(rows):
                    out[2:5, rows] = kernels.project(p[rows], line)
                    out[5, rows] = curvature(line, out[2, rows])
            hit = pa.array(covered | (out[0] > 0))
            arrays = [col(c) for c in names] + [pa.array(covered)] + [pa.array(v, pa.float64(), from_pandas=True) for v in out]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "center_covered", *doubles]).filter(hit)

    return pairs.mapInArrow(run, schema)


def memberships(found: DataFrame, t: Thresholds = T) -> DataFrame:
    """in... where the centre is covered (edges count), intersects... where footprints share area."""
    name = F.initcap(F.replace(F.col("kind"), F.lit("_"), F.lit(" ")))
    name = F.replace(name, F.lit(" "), F.lit(""))
    both = F.array(F.when(F.col("center_covered"), F.concat(F.lit("in"), name)), F.when(F.col("overlap_area") > t.overlap_area, F.concat(F.lit("intersects"), name)))
    return found.select(*KEYS, "object_id", F.explode(F.filter(both, lambda p: p.isNotNull())).alias("predicate"))


def primary(found: DataFrame, t: Thresholds = T) -> DataFrame:
    """One row per entity with eligible lanes: the primary one with its attributes, or none where the first two can't be told apart."""
    eligible = found.where(F.col("center_covered") | (F.col("overlap_ratio") >= t.primary_overlap))
    far = F.abs("lateral_offset")
    # areas come from sums over triangles: shares that differ by rounding alone are equal
    rank = Window.partitionBy(*ME).orderBy(F.desc("center_covered"), F.desc(F.round("overlap_ratio", 9)), far.asc_nulls_last(), F.desc(F.col("kind") == "lane"), F.desc("object_id"))
    top = eligible.withColumns({"rank": F.row_number().over(rank), "next_covered": F.lead("center_covered").over(rank), "next_ratio": F.lead("overlap_ratio").over(rank), "next_lateral": F.lead("lateral_offset").over(rank)}).where("rank = 1")
    reason = (
        F.when(F.col("next_covered").isNull(), "single")
        .when(F.col("center_covered") != F.col("next_covered"), "center")
        .when(F.col("overlap_ratio") - F.col("next_ratio") >= t.primary_margin, "overlap")
        .when(far + t.primary_lateral_margin < F.abs("next_lateral"), "lateral")
        .otherwise("ambiguous")
    )
    top = top.withColumn("match_reason", reason).withColumn("ambiguous", reason == "ambiguous")
    sure = lambda c: F.when(~F.col("ambiguous"), F.col(c))
    return top.select(*KEYS, "ambiguous", "match_reason", sure("object_id").alias("primary_id"), sure("kind").alias("primary_kind"), *(sure(c).alias(c) for c in ("overlap_ratio", "progress", "lateral_offset", "map_heading", "curvature")))


def map_attributes(map_objects: DataFrame, edges: DataFrame, adjacency: DataFrame) -> DataFrame:
    """One row a map object: map_name, primary_id, its attributes, ways in and out, and neighbours on either side."""
    ids = lambda df, key, value, name: df.groupBy("map_name", F.col(key).alias("primary_id")).agg(F.array_sort(F.collect_set(value)).alias(name))
    df = map_objects.select("map_name", F.col("object_id").alias("primary_id"), F.col("length_m").alias("baseline_length"), "speed_limit_mps", "roadblock_id", "intersection_id")
    for part in (
        ids(edges, "src_id", "dst_id", "outgoing"),
        ids(edges, "dst_id", "src_id", "incoming"),
        ids(adjacency.where("side = 'left'"), "object_id", "adjacent_id", "left_ids"),
        ids(adjacency.where("side = 'right'"), "object_id", "adjacent_id", "right_ids"),
    ):
        df = df.join(part, ["map_name", "primary_id"], "left")
    return df


def with_map(entities: DataFrame, chosen: DataFrame, scenarios: DataFrame, map_objects: DataFrame, edges: DataFrame, adjacency: DataFrame, route: DataFrame) -> DataFrame:
    """entities with the primary match, its attributes, neighbours and the rank of its roadblock on the route.

    The map's rows and the ranks meet the narrow rows of the match, and these the entities by one join; Spark
    broadcasts the map's rows where their size allows.
    """
    about = cut(map_attributes(map_objects, edges, adjacency))
    ranks = route.groupBy("scenario_token", "roadblock_id").agg(F.min("ordinal").alias("route_rank"))
    own = chosen.drop("timestamp_us").join(scenarios.select("scenario_token", "map_name"), "scenario_token", "left").join(about, ["map_name", "primary_id"], "left")
    df = entities.join(own.join(ranks, ["scenario_token", "roadblock_id"], "left").drop("map_name"), list(ME), "left")
    none = F.array().cast("array<string>")
    return df.withColumns({c: F.coalesce(c, none) for c in ("outgoing", "incoming", "left_ids", "right_ids")}).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def with_areas(matched: DataFrame, found: DataFrame, t: Thresholds = T) -> DataFrame:
    """matched with intersection_ids (of its lane, about its centre, under its footprint) and in_crosswalk; found are candidates of areas."""
    on = found.where(F.col("center_covered") | (F.col("overlap_area") > t.overlap_area))
    ids = F.collect_set(F.when(F.col("kind") == "intersection", F.col("object_id")))
    own = on.groupBy(*ME).agg(ids.alias("about"), F.max(F.col("kind") == "crosswalk").alias("in_crosswalk"))
    df = matched.join(own, list(ME), "left").withColumn("in_crosswalk", F.coalesce("in_crosswalk", F.lit(False)))
    lane = F.array_compact(F.array("intersection_id"))
    return df.withColumn("intersection_ids", F.array_union(lane, F.coalesce("about", F.array().cast("array<string>")))).drop("about")


def travel_direction(df: DataFrame, t: Thresholds = T) -> DataFrame:
    """travel_heading, travel_source: of velocity, displacement and map, where they agree."""
    velocity = F.when(F.col("speed") >= t.direction_speed, F.col("velocity_heading"))
    moved = F.when(F.col("displacement_m") >= t.direction_displacement, F.col("displacement_heading"))
    lane = F.when(~F.col("ambiguous"), F.col("map_heading"))
    clash = velocity.isNotNull() & moved.isNotNull() & (difference(velocity, moved) > t.direction_agreement)
    motion = F.when(velocity.isNotNull() & moved.isNotNull(), mean_of_two(velocity, moved)).otherwise(F.coalesce(velocity, moved))
    source = F.when(velocity.isNotNull() & moved.isNotNull(), "velocity_and_displacement").when(velocity.isNotNull(), "velocity").when(moved.isNotNull(), "temporal_displacement")
    off = lane.isNotNull() & motion.isNotNull() & (difference(lane, motion) > t.map_motion_tolerance)
    label = (
        F.when(clash | off | (lane.isNull() & motion.isNull()), "unreliable")
        .when(lane.isNotNull() & motion.isNotNull(), F.concat(F.lit("map_confirmed_by_"), source))
        .when(lane.isNotNull(), "map_low_speed")
        .otherwise(source)
    )
    return df.withColumn("travel_source", label).withColumn("travel_heading", F.when(label != "unreliable", F.coalesce(lane, motion)))


def map_relation(s: str = "s_", o: str = "o_") -> Column:
    """Place of the object's lane in the lane graph as seen from the subject's."""
    c = lambda p, n: F.col(f"{p}{n}")
    has = lambda p, n, q: F.array_contains(c(p, n), c(q, "primary_id"))
    return (
        F.when(c(s, "ambiguous") | c(o, "ambiguous"), "ambiguous")
        .when(c(s, "primary_id").isNull() | c(o, "primary_id").isNull(), "unrelated")
        .when((c(s, "primary_id") == c(o, "primary_id")) & (c(s, "primary_kind") == c(o, "primary_kind")), "same_map")
        .when(has(s, "left_ids", o) | has(o, "right_ids", s), F.when(has(s, "left_ids", o), "adjacent_left").when(has(s, "right_ids", o), "adjacent_right").otherwise("adjacent_left"))
        .when(has(s, "right_ids", o) | has(o, "left_ids", s), "adjacent_right")
        .when(has(s, "outgoing", o) | has(o, "incoming", s), "successor")
        .when(has(s, "incoming", o) | has(o, "outgoing", s), "predecessor")
        .otherwise("unrelated")
    )


def path_distance(relation: Column, s: str = "s_", o: str = "o_") -> Column:
    """Signed distance along the lanes, for the same lane, a successor or a predecessor."""
    c = lambda p, n: F.col(f"{p}{n}")
    zero = F.lit(0.0)
    ahead = F.greatest(zero, c(s, "baseline_length") - c(s, "progress")) + F.greatest(zero, c(o, "progress"))
    behind = -(F.greatest(zero, c(o, "baseline_length") - c(o, "progress")) + F.greatest(zero, c(s, "progress")))
    return F.when(relation == "same_map", c(o, "progress") - c(s, "progress")).when(relation == "successor", ahead).when(relation == "predecessor", behind)


#: Columns that pairs need from each side.
MAP_COLUMNS = ("ambiguous", "primary_id", "primary_kind", "progress", "lateral_offset", "map_heading", "baseline_length", "outgoing", "incoming", "left_ids", "right_ids", "route_rank", "intersection_ids", "in_crosswalk", "travel_heading", "speed")


def with_topology(pairs: DataFrame, t: Thresholds = T) -> DataFrame:
    """map_relation, path_distance, travel difference, same_flow, shared_intersection, same_lane of pairs with MAP_COLUMNS."""
    df = pairs.withColumn("map_relation", map_relation())
    df = df.withColumn("path_distance", path_distance(F.col("map_relation"))).withColumn("travel_difference", difference(F.col("s_travel_heading"), F.col("o_travel_heading")))
    h = F.col("s_travel_heading")
    dx, dy = F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y")
    along = lambda a, b: F.when(F.col("map_relation").isin("adjacent_left", "adjacent_right"), a * F.cos(F.col("s_map_heading")) + b * F.sin(F.col("s_map_heading")))
    return df.withColumns(
        {
            "reference_distance": F.coalesce("path_distance", along(dx, dy)),
            "same_flow": F.coalesce(F.col("travel_difference") <= t.same_flow, F.lit(False)),
            "shared_intersection": F.coalesce(F.arrays_overlap("s_intersection_ids", "o_intersection_ids"), F.lit(False)),
            "same_lane": F.coalesce((F.col("map_relation") == "same_map") & (F.col("s_primary_kind") == "lane"), F.lit(False)),
            "progress_difference": F.when(F.col("map_relation") == "same_map", F.col("o_progress") - F.col("s_progress")),
            "travel_longitudinal": F.cos(h) * dx + F.sin(h) * dy,
            "travel_lateral": F.cos(h) * dy - F.sin(h) * dx,
        }
    )


def topology_facts(scored: DataFrame, state: Callable = unpivot) -> DataFrame:
    """Numbers of pairs on the map and along their ways."""
    return state(
        scored,
        PAIR_KEYS,
        {
            "hasMapProgressDifferenceTo": F.col("progress_difference"),
            "hasSignedPathDistanceTo": F.col("path_distance"),
            "hasTravelDirectionDifferenceTo": F.col("travel_difference"),
            "hasTravelLongitudinalDistanceTo": F.col("travel_longitudinal"),
            "hasTravelLateralDistanceTo": F.col("travel_lateral"),
        },
    )


def topology_states(scored: DataFrame) -> DataFrame:
    """inSameLaneAs and sharesIntersectionWith of pairs."""
    both = F.array(F.when(F.col("same_lane"), F.lit("inSameLaneAs")), F.when(F.col("shared_intersection"), F.lit("sharesIntersectionWith")))
    return scored.select(*PAIR_KEYS, F.explode(F.filter(both, lambda p: p.isNotNull())).alias("predicate"))


def topology_texts(scored: DataFrame) -> DataFrame:
    """hasSpatialMapRelation of each pair."""
    return scored.select(*PAIR_KEYS, F.lit("hasSpatialMapRelation").alias("predicate"), F.col("map_relation").alias("object"))


def map_facts(df: DataFrame, state: Callable = unpivot) -> DataFrame:
    """Numbers of the primary match."""
    return state(
        df,
        KEYS,
        {
            "hasPrimaryMapOverlapRatio": F.col("overlap_ratio"),
            "hasBaselineProgress": F.col("progress"),
            "hasBaselineLateralOffset": F.col("lateral_offset"),
            "hasMapHeading": F.col("map_heading"),
            "hasMapSpeedLimit": F.col("speed_limit_mps"),
            "hasBaselineCurvature": F.col("curvature"),
            "hasRouteRoadblockRank": F.col("route_rank"),
            "hasEffectiveTravelHeading": F.col("travel_heading"),
        },
    )


def map_relations(df: DataFrame, state: Callable = unpivot_text) -> DataFrame:
    """Text facts of the primary match."""
    lane = F.col("primary_kind") == "lane"
    link = F.col("primary_kind") == "lane_connector"
    rows = {
        "hasPrimaryLane": F.when(lane, F.concat(F.lit("lane:"), "primary_id")),
        "hasPrimaryLaneConnector": F.when(link, F.concat(F.lit("lane_connector:"), "primary_id")),
        "hasParentRoadblock": F.when(lane, F.concat(F.lit("roadblock:"), "roadblock_id")),
        "hasParentRoadblockConnector": F.when(link, F.concat(F.lit("roadblock_connector:"), "roadblock_id")),
        "hasPrimaryMapIntersection": F.concat(F.lit("intersection:"), "intersection_id"),
        "hasAmbiguousMapMatch": F.when(F.col("ambiguous"), F.lit("true")),
        "onExpertRoute": F.when(F.col("route_rank").isNotNull(), F.concat(F.lit("roadblock:"), "roadblock_id")),
        "hasTravelDirectionSource": F.when(F.col("travel_source") != "unreliable", F.col("travel_source")),
    }
    return state(df, KEYS, rows)

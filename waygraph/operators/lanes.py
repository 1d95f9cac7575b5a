"""Tables of the map alone, built once a map: which lanes run beside each other, and the line along a lane and its only successors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.functions import kernels
from waygraph.operators.entities import KEYS
from waygraph.operators.following import LANES, unbranched_paths

CELL = 50.0


def side_of(source: np.ndarray, target: np.ndarray, t: Thresholds = T) -> tuple[str, float, float] | None:
    """Side, gap and turn of the target's baseline at half the source's length; None where it doesn't run beside it."""
    half = np.array([np.hypot(*np.diff(source, axis=0).T).sum() / 2])
    middle, heading = kernels.at_length(source, half), kernels.tangent(source, half)[0]
    along = kernels.project(middle, target)[0]
    turn = abs((kernels.tangent(target, along)[0] - heading + np.pi) % (2 * np.pi) - np.pi)
    dx, dy = (kernels.at_length(target, along) - middle)[0]
    gap, lateral = float(np.hypot(dx, dy)), -np.sin(heading) * dx + np.cos(heading) * dy
    if turn > t.lane_side_turn or not t.lane_side_least <= gap <= t.lane_side_most or abs(lateral) <= t.lane_side_lateral:
        return None
    return ("left" if lateral > 0 else "right"), gap, float(turn)


def lane_sides(map_objects: DataFrame, t: Thresholds = T) -> DataFrame:
    """map_name, object_id, adjacent_id, side, gap, turn of lanes whose polygons come near each other and whose baselines are parallel.

    A spatial self-join: polygons go to the cells of their bounds, one side's widened, and
    meet by an equi-join on the cell, of which the first that both share counts.
    """
    bound = lambda f, c: f(F.transform("polygon", lambda p: p[c]))
    lanes = map_objects.where(F.col("kind").isin(*LANES) & (F.size("baseline") >= 2))
    cells = lambda c, more: F.sequence(F.floor((bound(F.array_min, c) - more) / CELL), F.floor((bound(F.array_max, c) + more) / CELL))

    def tiles(p: str, more: float) -> DataFrame:
        own = lanes.select("map_name", *(F.col(c).alias(f"{p}_{c}") for c in ("object_id", "polygon", "baseline")), cells("x", more).alias(f"{p}_xs"), cells("y", more).alias(f"{p}_ys"))
        return own.withColumn("cx", F.explode(f"{p}_xs")).withColumn("cy", F.explode(f"{p}_ys"))

    first = lambda c: F.col(f"c{c}") == F.greatest(F.get(f"a_{c}s", F.lit(0)), F.get(f"b_{c}s", F.lit(0)))
    pairs = tiles("a", t.lane_side_polygon_distance).join(tiles("b", 0.0), ["map_name", "cx", "cy"]).where((F.col("a_object_id") != F.col("b_object_id")) & first("x") & first("y"))
    pairs = pairs.select("map_name", *(f"{p}_{c}" for p in "ab" for c in ("object_id", "polygon", "baseline")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xy = lambda points: np.array([(p["x"], p["y"]) for p in points])
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                found = side_of(xy(r["a_baseline"]), xy(r["b_baseline"]), t)
                if found and kernels.polygons_distance(xy(r["a_polygon"]), xy(r["b_polygon"])) <= t.lane_side_polygon_distance:
                    out.append((r["map_name"], r["a_object_id"], r["b_object_id"], *found))
            names = ("map_name", "object_id", "adjacent_id", "side", "gap", "turn")
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names=list(names))

    return pairs.mapInArrow(run, "map_name string, object_id string, adjacent_id string, side string, gap double, turn double")


def corridor_lines(map_objects: DataFrame, edges: DataFrame, hops: int = T.lane_change_hops, joint: float = 1e-6) -> DataFrame:
    """map_name, object_id, lanes, xs, ys, along: the baselines of a lane and of what follows it without a branch, as one polyline with its running arc length.

    From the path table; a point that repeats the one before it is left out where baselines join.
    """
    lines = map_objects.where(F.col("kind").isin(*LANES) & (F.size("baseline") >= 2)).select("map_name", F.col("object_id").alias("dst"), F.transform("baseline", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
    parts = unbranched_paths(map_objects, edges, hops).join(lines, ["map_name", "dst"]).groupBy("map_name", F.col("src").alias("object_id")).agg(F.array_sort(F.collect_list(F.struct("hops", "dst", "line"))).alias("parts"))
    df = parts.select("map_name", "object_id", F.transform("parts", lambda p: p["dst"]).alias("lanes"), F.flatten(F.transform("parts", lambda p: p["line"])).alias("points"))
    gap = lambda p, i: F.hypot(p["x"] - F.get("points", i - 1)["x"], p["y"] - F.get("points", i - 1)["y"])
    df = df.withColumn("points", F.filter("points", lambda p, i: (i == 0) | (gap(p, i) > joint)))
    steps = F.transform("points", lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(gap(p, i)))
    df = df.withColumn("steps", steps)
    along = F.transform("steps", lambda _, i: F.aggregate(F.slice("steps", 1, i + 1), F.lit(0.0), lambda a, b: a + b))
    return df.select("map_name", "object_id", "lanes", F.transform("points", lambda p: p["x"]).alias("xs"), F.transform("points", lambda p: p["y"]).alias("ys"), along.alias("along"))


def profile(line: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Left-positive offsets of points from a polyline, against its direction about their projections."""
    along = kernels.project(points, line)[0]
    d, heading = points - kernels.at_length(line, along), kernels.tangent(line, along)
    return -np.sin(heading) * d[:, 0] + np.cos(heading) * d[:, 1]


def neighbours(matched: DataFrame, scenarios: DataFrame, sides: DataFrame) -> DataFrame:
    """KEYS, primary_id, adjacent_id, side, gap: the lanes beside each road user's own, by whole baselines."""
    own = matched.where(F.col("primary_id").isNotNull()).join(scenarios.select("scenario_token", "map_name"), "scenario_token")
    return own.join(sides.withColumnRenamed("object_id", "primary_id"), ["map_name", "primary_id"]).select(*KEYS, "primary_id", "adjacent_id", "side", "gap")


def corridor_progress(matched: DataFrame, scenarios: DataFrame, lines: DataFrame) -> DataFrame:
    """KEYS, primary_id, along, offset, corridor_length: road users projected on the line that begins with their lane.

    A line goes to the users of its lane by an equi-join on the lane.
    """
    own = matched.where(F.col("primary_id").isNotNull()).join(scenarios.select("scenario_token", "map_name"), "scenario_token").select("map_name", *KEYS, "primary_id", "x", "y")
    both = own.join(lines.select("map_name", F.col("object_id").alias("primary_id"), "xs", "ys"), ["map_name", "primary_id"]).where(F.size("xs") >= 2).drop("map_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            points = np.stack([col(c).to_numpy(zero_copy_only=False) for c in "xy"], -1)
            out = np.zeros((3, batch.num_rows))
            codes = np.asarray(col("primary_id").dictionary_encode().indices)
            for code in np.unique(codes):
                rows = np.flatnonzero(codes == code)
                line = np.stack([col(c)[int(rows[0])].values.to_numpy() for c in ("xs", "ys")], -1)
                out[0, rows], out[1, rows] = kernels.project(points[rows], line)[0], profile(line, points[rows])
                out[2, rows] = np.hypot(*np.diff(line, axis=0).T).sum()
            yield pa.RecordBatch.from_arrays([*(col(c) for c in (*KEYS, "primary_id")), *map(pa.array, out)], names=[*KEYS, "primary_id", "along", "offset", "corridor_length"])

    keys = ", ".join(f"{c} {matched.schema[c].dataType.simpleString()}" for c in KEYS)
    return both.mapInArrow(run, f"{keys}, primary_id string, along double, offset double, corridor_length double")

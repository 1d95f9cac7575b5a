"""hasConflictRiskWith: short-horizon conflict at constant velocity.

Gates run from cheap to dear: closing speed, eligibility and a centre-distance
bound are column expressions; the least clearance over the horizon is a
golden-section search over all remaining pairs at once in an Arrow kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from waygraph.config import T, Thresholds
from waygraph.functions import kernels
from waygraph.functions.angles import difference
from waygraph.functions.classifiers import is_dynamic, is_vulnerable
from waygraph.operators.pairs import PAIR, with_cpa

ITERATIONS = 24
GOLDEN = (np.sqrt(5.0) - 1) / 2
#: Tags of the first direction of a pair; the other one is as near, so that it is scored only if the first is.
FIRST = ("ego_to_agent", "agent_to_agent")


def least_clearance(a: np.ndarray, b: np.ndarray, dv: np.ndarray, center_time: np.ndarray, horizon: float, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(time, clearance) of boxes (n, 4, 2), b moving by dv against a: distance along a line is convex, so sections of the horizon narrow on its least."""
    at = lambda t: kernels.convex_distance(a, b + dv[:, None] * t[:, None, None])
    lo, hi = np.zeros(len(a)), np.full(len(a), float(horizon))
    c, d = hi - GOLDEN * (hi - lo), lo + GOLDEN * (hi - lo)
    fc, fd = at(c), at(d)
    for _ in range(iterations):
        left = fc <= fd
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
        c2, d2 = np.where(left, hi - GOLDEN * (hi - lo), d), np.where(left, c, lo + GOLDEN * (hi - lo))
        fresh = at(np.where(left, c2, d2))
        fc, fd = np.where(left, fresh, fd), np.where(left, fc, fresh)
        c, d = c2, d2
    times = np.stack([np.zeros(len(a)), np.full(len(a), float(horizon)), center_time, c, d, (lo + hi) / 2])
    values = np.stack([at(times[0]), at(times[1]), at(times[2]), fc, fd, at(times[5])])
    order = np.lexsort((times, values), axis=0)[0]
    rows = np.arange(len(a))
    return times[order, rows], values[order, rows]


def conflicts(scored: DataFrame, t: Thresholds = T) -> DataFrame:
    """PAIR with the figures of each conflict; an unordered pair speaks once a frame, by its first direction, even if that one is turned down."""
    # first, so that the other directions, and whom the cheap gates turn down, go to no kernel
    df = scored.where(F.col("tag").isin(*FIRST)).where(is_dynamic(F.col("s_agent_type")) & is_dynamic(F.col("o_agent_type")) & F.col("free_space").isNotNull() & ~F.col("overlapping") & (F.col("closing_speed") >= t.risk_closing_speed))
    moving = lambda p: F.coalesce(F.when(F.hypot(f"{p}vx", f"{p}vy") >= t.direction_speed, F.atan2(f"{p}vy", f"{p}vx")), F.col(f"{p}heading"))
    turn = difference(moving("s_"), moving("o_"))
    basis = (
        F.when(F.col("map_relation").isin("same_map", "successor", "predecessor"), "lane_path_connected")
        .when((is_vulnerable(F.col("s_agent_type")) | is_vulnerable(F.col("o_agent_type"))) & (F.col("center_distance") <= t.risk_vru_distance), "vulnerable_road_user_local")
        .when((F.abs("lateral") <= t.risk_corridor_lateral) & (F.col("center_distance") <= t.risk_corridor_center) & (turn <= np.radians(15.0)), "tight_same_flow_corridor")
        .when((turn >= np.radians(t.risk_crossing_angle_deg)) & (F.col("center_distance") <= t.risk_crossing_distance), "cross_or_opposite_motion")
    )
    df = with_cpa(df.withColumn("basis", basis).where("basis is not null"), t.risk_horizon_s, "risk_cpa")
    shape = [f"{p}_{c}" for p in "so" for c in ("x", "y", "cos_h", "sin_h", "length_m", "width_m", "vx", "vy", "is_ego")]
    df = df.where(F.col("risk_cpa_clearance") <= t.risk_clearance).select(*PAIR, *shape, "map_relation", "basis", "free_space", "closing_speed", "risk_cpa_time_s")
    schema = StructType([*df.schema.fields, StructField("risk_time_s", DoubleType()), StructField("risk_least_clearance", DoubleType())])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num = lambda c, b=batch: b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float)
            a, b = (kernels.boxes(*(num(f"{p}_{c}") for c in ("x", "y", "cos_h", "sin_h", "length_m", "width_m"))) for p in "so")
            dv = np.stack([num("o_vx") - num("s_vx"), num("o_vy") - num("s_vy")], 1)
            time, value = least_clearance(a, b, dv, num("risk_cpa_time_s"), t.risk_horizon_s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(time), pa.array(value)], names=schema.names)

    df = df.mapInArrow(run, schema).where((F.col("risk_least_clearance") <= t.risk_clearance) & (F.col("risk_time_s") > 0) & (F.col("risk_least_clearance") < F.col("free_space")))
    room = F.col("free_space") - t.risk_clearance
    braking = F.when(room <= 1e-9, F.lit(float("inf"))).otherwise(F.col("closing_speed") ** 2 / (2 * room))
    ego, other = (F.when(F.col("s_is_ego"), F.hypot("s_vx", "s_vy")).otherwise(F.hypot("o_vx", "o_vy")), F.when(F.col("s_is_ego"), F.hypot("o_vx", "o_vy")).otherwise(F.hypot("s_vx", "s_vy")))
    approach = F.greatest(F.lit(0.0), ego - other)
    beside = F.col("map_relation").isin("adjacent_left", "adjacent_right") & (F.col("s_is_ego") | F.col("o_is_ego"))
    unsafe = beside & ((approach * approach / (2 * F.greatest(F.col("free_space"), F.lit(1e-9))) > t.risk_target_deceleration) | (F.col("risk_least_clearance") < ego * t.risk_gap_time_s))
    df = df.withColumn("braking_demand", braking).withColumn("unsafe_lane_change", unsafe)
    return df.where((F.col("braking_demand") >= t.risk_braking) | F.col("unsafe_lane_change")).select(*PAIR, F.lit("hasConflictRiskWith").alias("predicate"), "basis", "risk_time_s", "risk_least_clearance", "braking_demand", "unsafe_lane_change")

"""Geometric visibility from the ego: field of view and blocked rays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.functions import kernels
from waygraph.operators.pairs import FRAME


def fan(x: np.ndarray, y: np.ndarray, heading: np.ndarray, half: float, radius: float) -> np.ndarray:
    """Corners (n, k, 2) of the field of view: a fan of at least twelve steps."""
    steps = max(12, int(np.degrees(half) / 3.0))
    angle = heading[:, None] - half + 2 * half * np.arange(steps + 1) / steps
    rim = np.stack([x[:, None] + radius * np.cos(angle), y[:, None] + radius * np.sin(angle)], -1)
    return np.concatenate([np.stack([x, y], -1)[:, None], rim], 1)


def segments_hit(p: np.ndarray, q: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Whether segments (n, 2) to (n, 2) meet convex shapes (n, m, 2)."""
    return kernels.convex_meet(np.stack([p, q], 1), shapes, 1e-12)


def visibility(pairs: DataFrame, t: Thresholds = T) -> DataFrame:
    """Of ego's pairs, FRAME, o_track and rays of agents within the field of view: how many of five reach them, and who blocks each.

    Rays go to the centre and the corners.  Blockers come from a self-join on the
    frame; for each ray the nearest ego-to-blocker distance must be under the ray's.
    """
    own = pairs.where("s_is_ego")
    names = [*FRAME, "o_track", "o_slot", "s_x", "s_y", "s_heading", "o_x", "o_y", "o_cos_h", "o_sin_h", "o_length_m", "o_width_m"]
    slim = own.select(*names)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float)
            shape = kernels.boxes(*map(num, ("o_x", "o_y", "o_cos_h", "o_sin_h", "o_length_m", "o_width_m")))
            half = np.radians(t.fov_deg) / 2
            yield batch.filter(pa.array(kernels.convex_meet(shape, fan(num("s_x"), num("s_y"), num("s_heading"), half, t.fov_range))))

    seen = slim.mapInArrow(see, slim.schema)
    block = slim.select(*FRAME, F.col("o_track").alias("b_track"), F.col("o_slot").alias("b_slot"), *(F.col(f"o_{c}").alias(f"b_{c}") for c in ("x", "y", "cos_h", "sin_h", "length_m", "width_m")))
    both = seen.join(block, list(FRAME)).where("o_track != b_track")
    kept = both.select(*FRAME, "o_track", "b_track", "b_slot", "s_x", "s_y", "o_x", "o_y", "o_cos_h", "o_sin_h", "o_length_m", "o_width_m", "b_x", "b_y", "b_cos_h", "b_sin_h", "b_length_m", "b_width_m")
    kinds = dict(kept.dtypes)
    schema = f"scenario_token string, frame_index int, timestamp_us bigint, o_track string, b_track string, b_slot {kinds['b_slot']}, hit int"

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float)
            target, other = (kernels.boxes(*(num(f"{p}_{c}") for c in ("x", "y", "cos_h", "sin_h", "length_m", "width_m"))) for p in "ob")
            eye = np.stack([num("s_x"), num("s_y")], 1)
            ends = np.concatenate([np.stack([num("o_x"), num("o_y")], 1)[:, None], target], 1)
            near = np.hypot(num("b_x") - eye[:, 0], num("b_y") - eye[:, 1])
            mask = np.zeros(len(eye), np.int32)
            for i in range(5):
                end = ends[:, i]
                reach = np.hypot(*(end - eye).T) + t.distance_epsilon
                mask |= (segments_hit(eye, end, other) & (near < reach)).astype(np.int32) << i
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(mask, pa.int32())], names=[*FRAME, "o_track", "b_track", "b_slot", "hit"])

    blocked = kept.mapInArrow(hits, schema).where("hit > 0")
    first = blocked.withColumn("ray", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: F.pmod(F.floor(F.col("hit") / F.pow(F.lit(2), i)), F.lit(2)) == 1)))
    by_ray = first.groupBy(*FRAME, "o_track", "ray").agg(F.min_by("b_track", "b_slot").alias("blocker"))
    rays = by_ray.groupBy(*FRAME, "o_track").agg(F.count(F.lit(1)).alias("n_blocked"), F.array_sort(F.collect_set("blocker")).alias("blockers"))
    return seen.select(*FRAME, "o_track").join(rays, [*FRAME, "o_track"], "left").select(*FRAME, "o_track", (5 - F.coalesce("n_blocked", F.lit(0))).cast("int").alias("visible_rays"), F.coalesce("blockers", F.array().cast("array<string>")).alias("blockers"))


def visibility_facts(found: DataFrame) -> DataFrame:
    """withinEgoFieldOfView, hasLineOfSightTo and geometricallyVisibleToEgo, occludedByAgent (object: the blocker)."""
    rows = F.concat(
        F.array(F.struct(F.lit("withinEgoFieldOfView").alias("predicate"), F.lit(None).cast("string").alias("object"))),
        F.when(F.col("visible_rays") > 0, F.array(*(F.struct(F.lit(p).alias("predicate"), F.lit(None).cast("string").alias("object")) for p in ("hasLineOfSightTo", "geometricallyVisibleToEgo")))).otherwise(F.array().cast("array<struct<predicate:string,object:string>>")),
        F.transform("blockers", lambda b: F.struct(F.lit("occludedByAgent").alias("predicate"), b.alias("object"))),
    )
    return found.select(*FRAME, "o_track", F.explode(rows).alias("p")).select(*FRAME, "o_track", "p.predicate", "p.object")

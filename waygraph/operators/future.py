"""Future observations, their coverage, and intents read from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from waygraph.config import T, Thresholds
from waygraph.functions.angles import wrap
from waygraph.functions.buffers import shared_region
from waygraph.functions.classifiers import is_vehicle
from waygraph.operators.entities import KEYS, unpivot
from waygraph.operators.pairs import FRAME
from waygraph.plans.shared import dealt

#: Cells of the bounds of future paths, in metres.
PATH_CELL = 50.0


def future_links(entities: DataFrame, t: Thresholds = T) -> DataFrame:
    """KEYS with later_frame, later_us: all later observations of the track within the horizon, by windows on the track rather than a self-join."""
    order = Window.partitionBy("scenario_token", "track_token").orderBy("timestamp_us").rangeBetween(1, int(t.future_horizon_s * 1e6))
    later = F.collect_list(F.struct("frame_index", "timestamp_us")).over(order)
    return entities.select(*KEYS, later.alias("later")).select(*KEYS, F.explode("later").alias("l")).select(*KEYS, F.col("l.frame_index").alias("later_frame"), F.col("l.timestamp_us").alias("later_us"))


def future_coverage(entities: DataFrame, t: Thresholds = T) -> DataFrame:
    """KEYS, samples, duration_s, coverage, insufficient: target times of the horizon that two samples within the longest gap bracket."""
    horizon, step, gap = int(t.future_horizon_s * 1e6), int(t.future_step_s * 1e6), int(t.sample_interval_s * t.maximum_gap_factor * 1e6)
    wanted = horizon // step
    order = Window.partitionBy("scenario_token", "track_token").orderBy("timestamp_us")
    ahead = order.rangeBetween(0, horizon + gap)
    df = dealt(entities, "scenario_token", "track_token").select(*KEYS, F.collect_list("timestamp_us").over(ahead).alias("times"))
    now, none = F.col("timestamp_us"), F.lit(0).cast("bigint")
    steps = lambda v: F.least(F.floor((v - now) / step), F.lit(wanted).cast("bigint"))
    # one pass over the times: those of two samples near enough hold all targets between them, others what they fall on
    on = lambda v: F.when(((v - now) % step == 0) & (v - now <= wanted * step), F.lit(1).cast("bigint")).otherwise(none)
    more = lambda held, v: F.struct((held.n + F.when(v - held.last <= gap, steps(v) - steps(held.last)).otherwise(on(v))).alias("n"), v.alias("last"))
    held = F.aggregate("times", F.struct(none.alias("n"), now.alias("last")), more, lambda held: held.n)
    df = df.withColumn("samples", held)
    return df.select(*KEYS, "samples", (F.col("samples") * t.future_step_s).alias("duration_s"), (F.col("samples") / wanted).alias("coverage"), (F.col("samples") / wanted < t.future_coverage).alias("insufficient"))


def future_positions(entities: DataFrame, t: Thresholds = T) -> DataFrame:
    """KEYS, sample (from 1), at_us, x, y, heading: where the track is at the target times of the horizon.

    Linear between the two samples that bracket a time, the heading the shorter way;
    nothing where they lie further apart than the longest gap.
    """
    horizon, step, gap = int(t.future_horizon_s * 1e6), int(t.future_step_s * 1e6), int(t.sample_interval_s * t.maximum_gap_factor * 1e6)
    ahead = Window.partitionBy("scenario_token", "track_token").orderBy("timestamp_us").rangeBetween(0, horizon + gap)
    df = dealt(entities, "scenario_token", "track_token").select(*KEYS, F.collect_list(F.struct(F.col("timestamp_us").alias("t"), "x", "y", "heading")).over(ahead).alias("seen"))
    df = df.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(horizon // step)))).withColumn("at_us", F.col("timestamp_us") + F.col("sample") * step)
    df = df.withColumn("a", F.element_at(F.filter("seen", lambda v: v.t <= F.col("at_us")), -1)).withColumn("b", F.get(F.filter("seen", lambda v: v.t >= F.col("at_us")), F.lit(0))).where(F.col("b.t") - F.col("a.t") <= gap)
    share = F.when(F.col("b.t") == F.col("a.t"), F.lit(0.0)).otherwise((F.col("at_us") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    between = lambda c: F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))
    return df.select(*KEYS, "sample", "at_us", between("x").alias("x"), between("y").alias("y"), wrap(F.col("a.heading") + share * wrap(F.col("b.heading") - F.col("a.heading"))).alias("heading"))


def footprints_at(positions: DataFrame, entities: DataFrame) -> DataFrame:
    """positions with the corners of the track's box there: corners, an array of (x, y)."""
    half = lambda c, sign: F.col(c) / 2 * sign
    corner = lambda a, b: F.struct((F.col("x") + F.cos("heading") * half("length_m", a) - F.sin("heading") * half("width_m", b)).alias("x"), (F.col("y") + F.sin("heading") * half("length_m", a) + F.cos("heading") * half("width_m", b)).alias("y"))
    sized = positions.join(entities.select(*KEYS, "length_m", "width_m"), list(KEYS))
    return sized.withColumn("corners", F.array(*(corner(a, b) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))))).drop("length_m", "width_m")


def coverage_facts(covered: DataFrame, state: Callable = unpivot) -> DataFrame:
    """Numbers of the future coverage, and hasInsufficientFutureEvidence (1) where it is too small."""
    return state(covered, KEYS, {"hasFutureSampleCount": F.col("samples"), "hasAvailableFutureDuration": F.col("duration_s"), "hasFutureCoverageRatio": F.col("coverage"), "hasInsufficientFutureEvidence": F.when(F.col("insufficient"), F.lit(1.0))})


def future_paths(matched: DataFrame, t: Thresholds = T) -> DataFrame:
    """Vehicles of each frame with the path that they are seen to take within the horizon, itself with what it begins with: arrays us, xs, ys, ids (primary lanes)."""
    ahead = Window.partitionBy("scenario_token", "track_token").orderBy("timestamp_us").rangeBetween(0, int(t.future_horizon_s * 1e6))
    df = matched.where(is_vehicle(F.col("agent_type"))).withColumn("seen", F.collect_list(F.struct("timestamp_us", "x", "y", "primary_id")).over(ahead)).where(F.size("seen") >= 2)
    part = lambda c: F.transform("seen", lambda v: v[c])
    width = F.when(F.coalesce("width_m", F.lit(0.0)) > 0, F.col("width_m")).otherwise(1.0)
    df = df.withColumns({"us": part("timestamp_us"), "xs": part("x"), "ys": part("y"), "ids": part("primary_id"), "width": width})
    return df.select(*KEYS, "slot", "x", "y", "speed", "estimated_acceleration", "primary_id", "width", "us", "xs", "ys", "ids")


def conflicts_of_paths(paths: DataFrame, t: Thresholds = T) -> DataFrame:
    """FRAME and both sides (s the one of the lower slot) of vehicles whose widened paths meet: region area and centroid, when each first comes near it.

    Bounds of paths go to grid cells and meet by an equi-join on frame and cell, of which the
    first that both share counts; an Arrow kernel finds the regions.
    """
    own = ("track_token", "slot", "x", "y", "speed", "estimated_acceleration", "primary_id", "width", "us", "xs", "ys", "ids")
    bounds = ("cxs", "cys", "x0", "x1", "y0", "y1")
    ends = {f"{c}{i}": f(f"{c}s") + way * F.col("width") / 2 for c in "xy" for i, f, way in ((0, F.array_min, -1), (1, F.array_max, 1))}
    span = lambda c: F.sequence(F.floor(F.col(f"{c}0") / PATH_CELL), F.floor(F.col(f"{c}1") / PATH_CELL))
    tiles = paths.withColumns(ends).withColumns({"cxs": span("x"), "cys": span("y")}).withColumn("cx", F.explode("cxs")).withColumn("cy", F.explode("cys"))
    side = lambda p: tiles.select(*FRAME, "cx", "cy", *(F.col(c).alias(f"{p}_{c.replace('track_token', 'track')}") for c in (*own, *bounds)))
    first = lambda c: F.col(f"c{c}") == F.greatest(F.get(f"s_c{c}s", F.lit(0)), F.get(f"o_c{c}s", F.lit(0)))
    # widened bounds that are apart share nothing; a thousandth of a metre is left for rounding
    apart = lambda c: F.greatest(F.col(f"s_{c}0"), F.col(f"o_{c}0")) > F.least(F.col(f"s_{c}1"), F.col(f"o_{c}1")) + 1e-3
    pairs = side("s").join(side("o"), [*FRAME, "cx", "cy"]).where((F.col("s_slot") < F.col("o_slot")) & first("x") & first("y") & ~apart("x") & ~apart("y")).drop("cx", "cy", *(f"{p}_{c}" for p in "so" for c in bounds))
    added = ("area", "cx", "cy", "s_arrival", "o_arrival")
    schema = StructType([*pairs.schema.fields, *(StructField(c, DoubleType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((len(added), batch.num_rows), np.nan)
            line = {(p, c): batch.column(f"{p}_{c}") for p in "so" for c in ("us", "xs", "ys")}
            width = {p: batch.column(f"{p}_width").to_numpy(zero_copy_only=False) for p in "so"}
            for i in range(batch.num_rows):
                path = {p: np.stack([line[p, c][i].values.to_numpy(zero_copy_only=False) for c in ("xs", "ys")], -1) for p in "so"}
                region = shared_region(path["s"], width["s"][i] / 2, path["o"], width["o"][i] / 2)
                if region is None:
                    continue
                near = max(width["s"][i], width["o"][i])
                out[:3, i] = region
                for k, p in enumerate("so"):
                    us = line[p, "us"][i].values.to_numpy(zero_copy_only=False)
                    there = np.flatnonzero(np.hypot(*(path[p] - region[1:]).T) <= near)
                    out[3 + k, i] = (us[there[0]] - us[0]) / 1e6 if len(there) else np.nan
            arrays = [*batch.columns, *(pa.array(v, pa.float64(), from_pandas=True) for v in out)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added]).filter(pa.array(~np.isnan(out[0])))

    return pairs.mapInArrow(run, schema)


def _lasting(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (ok, continuous) where ok holds, with the start of their run; a row that isn't ok, or a gap in the frames, ends a run."""
    order = Window.partitionBy(*key).orderBy("timestamp_us")
    begins = F.col("ok") & (~F.coalesce(F.lag("ok").over(order), F.lit(False)) | ~F.col("continuous"))
    rows = rows.withColumn("start_us", F.last(F.when(begins, F.col("timestamp_us")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("ok").withColumn("duration_s", (F.col("timestamp_us") - F.col("start_us")) / 1e6)


def intents(conflicts: DataFrame, frames: DataFrame, t: Thresholds = T) -> DataFrame:
    """yieldingTo, waitingFor, creatingGapFor and competingForGapWith that last, of vehicles whose future paths share a region.

    A region keeps its name while its rounded place and area stay; a run is of one region.
    """
    order = Window.partitionBy("scenario_token").orderBy("frame_index")
    gap_us = F.col("timestamp_us") - F.lag("timestamp_us").over(order)
    follows = (F.col("frame_index") == F.lag("frame_index").over(order) + 1) & (gap_us > 0) & (gap_us / 1e6 <= t.sample_interval_s * t.maximum_gap_factor)
    steady = frames.select("scenario_token", "frame_index", F.coalesce(follows, F.lit(False)).alias("continuous"))
    shared = (*FRAME, "area", "cx", "cy")
    own = ("track", "x", "y", "speed", "estimated_acceleration", "primary_id", "ids", "arrival")
    way = lambda a, b: conflicts.select(*shared, *(F.col(f"{p}_{c}").alias(f"{q}_{c}") for p, q in ((a, "s"), (b, "o")) for c in own))
    region = F.concat_ws(":", *(F.format_number(F.round(c, 2) + 0.0, 2) for c in ("cx", "cy", "area")))
    df = way("s", "o").unionByName(way("o", "s")).withColumn("region", region).join(steady, ["scenario_token", "frame_index"])
    slows = lambda p: F.coalesce(F.col(f"{p}_estimated_acceleration") <= -t.acceleration, F.lit(False))
    stands = lambda p: F.col(f"{p}_speed") <= t.stopped_speed
    earlier = lambda a, b: F.col(f"{a}_arrival").isNotNull() & (F.col(f"{b}_arrival").isNull() | (F.col(f"{a}_arrival") + t.arrival_tolerance_s < F.col(f"{b}_arrival")))
    yields, is_yielded_to = (slows("s") | stands("s")) & earlier("o", "s"), (slows("o") | stands("o")) & earlier("s", "o")
    waits = stands("s") & F.coalesce(F.col("o_arrival") <= max(2 * t.intent_duration_s, 3.0), F.lit(False))
    level = F.coalesce(F.abs(F.col("s_arrival") - F.col("o_arrival")) <= t.arrival_tolerance_s, F.lit(False))
    competes = level & ~yields & ~is_yielded_to
    enters = F.col("s_primary_id").isNotNull() & F.exists(F.slice("o_ids", 2, 1_000_000), lambda i: i.eqNullSafe(F.col("s_primary_id"))) & ~F.col("o_primary_id").eqNullSafe(F.col("s_primary_id"))
    rows = F.array(*(F.struct(F.lit(name).alias("predicate"), ok.alias("ok")) for name, ok in (("yieldingTo", yields), ("waitingFor", waits), ("competingForGapWith", F.when(F.col("s_track") <= F.col("o_track"), competes)))))
    each = df.select(*FRAME, "s_track", "o_track", "region", "continuous", F.explode(rows).alias("r")).select("*", "r.predicate", "r.ok").drop("r").where("ok is not null")
    lasting = _lasting(each, ["scenario_token", "s_track", "o_track", "region", "predicate"]).where(F.col("duration_s") >= t.intent_duration_s)
    # a gap grows from where it was last not asked for
    apart = df.withColumns({"enters": enters, "slows": slows("s"), "apart": F.hypot(F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y"))})
    pair = Window.partitionBy("scenario_token", "s_track", "o_track").orderBy("timestamp_us")
    anew = ~F.col("continuous") | ~F.col("enters") | F.lag("timestamp_us").over(pair).isNull()
    apart = apart.withColumn("since", F.last(F.when(anew, F.struct("timestamp_us", "apart")), ignorenulls=True).over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    apart = apart.withColumn("duration_s", (F.col("timestamp_us") - F.col("since.timestamp_us")) / 1e6)
    grows = apart.where(F.col("enters") & F.col("slows") & (F.col("apart") - F.col("since.apart") >= t.gap_increase) & (F.col("duration_s") >= t.intent_duration_s))
    columns = [*FRAME, "s_track", "o_track", "predicate", "region", "start_us", "duration_s"]
    return lasting.select(*columns).unionByName(grows.withColumn("predicate", F.lit("creatingGapFor")).withColumn("start_us", F.col("since.timestamp_us")).select(*columns))

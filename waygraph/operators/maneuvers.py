"""Lane changes, merges, overtakes, and connector and lane manoeuvres of tracks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby, permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.functions.angles import difference, wrap
from waygraph.functions.classifiers import is_vehicle
from waygraph.operators.entities import KEYS
from waygraph.operators.lanes import corridor_lines, lane_sides, profile
from waygraph.plans.shared import cut, dealt

UNKNOWN = "?"
#: Costs of a lane for a frame and of passing between lanes, and the score of a change.
COST = {
    "base": 3.4, "score": 1.25, "overlap": 1.2, "center": 1.15, "primary": 1.0, "ambiguous": 0.2, "absent": 5.0, "absent_alone": 2.7, "unknown": 3.4, "unknown_alone": 0.8,
    "stay": 0.05, "to_unknown": 1.2, "far": 50.0, "change": 2.75, "least_change": 0.2, "gain": 1.25, "most_gain": 1.0, "least_gain": -0.5,
    "drift": 0.8, "drift_from": 0.15, "most_drift": 1.25, "most_counter_drift": 2.0, "arrived_primary": 1.0, "arrived_center": 0.75, "gap_frame": 0.15, "most_gap": 1.0,
}
#: Lanes without a stated neighbour count as adjacent where their baselines run so near each other, beside the vehicle.
BESIDE = {"heading": 0.6, "least": 1.25, "most": 6.5, "side": 0.25}


class Seen(NamedTuple):
    """A vehicle in a frame, with one of the lanes that it is on, if any."""

    track_token: str
    frame_index: int
    timestamp_us: int
    speed: float
    x: float
    y: float
    object_id: str | None
    center_covered: bool | None
    overlap_ratio: float
    lateral_offset: float
    lane_heading: float
    is_primary: bool | None
    unsure: bool | None


class Lane(NamedTuple):
    """What a lane leads to, what runs beside it, and its corridor's line."""

    object_id: str
    follower: str | None
    ahead: list[str] | None
    beside: list[dict] | None
    parallel: list[dict] | None
    xs: list[float] | None
    ys: list[float] | None


def reachable(edges: DataFrame, hops: int = T.lane_change_hops) -> DataFrame:
    """map_name, src, dst: what can be reached forward by 1 to hops edges; as many joins as hops over distinct rows."""
    step = edges.select("map_name", F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()
    level = out = step
    for _ in range(hops - 1):
        onward = step.select(F.col("map_name").alias("m"), F.col("src").alias("via"), F.col("dst").alias("next"))
        level = level.join(onward, (level["map_name"] == onward["m"]) & (level["dst"] == onward["via"])).select("map_name", "src", F.col("next").alias("dst")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def chains(follower: dict[str, str | None]) -> dict[str, str]:
    """Corridor of each lane that a track has met, in the order that it met them.

    follower names a lane's successor where it is the single one.  Only such a lane
    goes with its successor: the ways of a branch stay apart, so that changes
    between parallel connectors can be seen.
    """
    up = {lane: lane for lane in follower}
    order = {lane: i for i, lane in enumerate(follower)}

    def root(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for lane, successor in follower.items():
        if successor in up:
            a, b = sorted((root(lane), root(successor)), key=order.__getitem__)
            up[b] = a
    return {lane: root(lane) for lane in follower}


def decode(emission: np.ndarray, change: np.ndarray) -> np.ndarray:
    """States of least cost; emission (frames, states), change (frames, from, to), of which the first frame's is not used. Ties go to the first state."""
    frames, states = emission.shape
    cost, back = emission[0].copy(), np.zeros((frames, states), int)
    for i in range(1, frames):
        total = cost[:, None] + change[i]
        back[i] = total.argmin(0)
        cost = total.min(0) + emission[i]
    path = [int(cost.argmin())]
    for i in range(frames - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return np.array(path[::-1])


def smooth(path: list[str], most_unknown: int = T.lane_change_unknown_gap) -> list[str]:
    """Short unknown gaps between equal lanes are filled, single frames of another lane between equal ones dropped."""
    out, at = list(path), 0
    while at < len(out):
        end = at
        while end + 1 < len(out) and out[end + 1] == out[at]:
            end += 1
        before, after = out[at - 1] if at else None, out[end + 1] if end + 1 < len(out) else None
        if before is not None and before == after and before != UNKNOWN and (out[at] == UNKNOWN and end - at < most_unknown or out[at] != UNKNOWN and end == at):
            out[at : end + 1] = [before] * (end - at + 1)
        at = end + 1
    return out


def onset(time: np.ndarray, offset: np.ndarray, reached: np.ndarray, t: Thresholds = T) -> tuple[int | None, str]:
    """Row where a move sideways begins, and by what; offset: to the target's side, reached: share of the footprint on the target lane.

    It begins where the offset from the first rows' median, its speed or the share is
    enough, more is to come, and the next rows don't fall back.
    """
    if not len(time):
        return None, "source_end"
    moved = offset - np.median(offset[: max(2, t.lane_change_source_frames + 1)])
    speed = np.concatenate([[0.0], np.diff(moved) / np.maximum(np.diff(time) / 1e6, 1e-9)])
    for i in range(len(time) - t.lane_change_onset_frames + 1):
        begun = moved[i] >= t.lane_change_lateral_onset or speed[i] >= t.lane_change_lateral_speed_onset or reached[i] > 0.01
        if begun and moved.max() - moved[i] >= t.lane_change_future_gain and (moved[i : i + t.lane_change_onset_frames] >= moved[i] - 0.1).all():
            return i, "lateral_speed" if speed[i] >= t.lane_change_lateral_speed_onset else "lateral_offset" if moved[i] >= t.lane_change_lateral_onset else "target_overlap"
    touching = np.flatnonzero(reached > 0.01)
    return (int(touching[0]), "target_overlap") if len(touching) else (None, "source_end")


def completion(frames: list[int], overlap: list[float | None], centered: list[bool], t: Thresholds = T) -> tuple[int, str]:
    """Row where the target lane is taken, and by what: frames in a row that are on it, or the last one that surely is, or the first."""
    need = t.lane_change_complete_overlap
    on = [o is not None and o >= need and (c or o >= min(0.85, need + 0.15)) for o, c in zip(overlap, centered, strict=True)]
    seen = [i for i, o in enumerate(overlap) if o is not None]
    n = t.lane_change_completion_frames
    for k in range(len(seen) - n + 1):
        run = seen[k : k + n]
        if all(on[i] for i in run) and frames[run[-1]] - frames[run[0]] == n - 1:
            return run[0], "stable"
    for i in reversed(seen):
        if overlap[i] >= t.lane_change_single_overlap and centered[i]:
            return i, "single_frame"
    return 0, "target_entry"


def lane_changes(entities: DataFrame, found: DataFrame, chosen: DataFrame, scenarios: DataFrame, edges: DataFrame, adjacency: DataFrame, map_objects: DataFrame, t: Thresholds = T) -> DataFrame:
    """One event per lane change: track, lanes, side, onset and completion frames, score, whether its ends were seen.

    A scenario's candidates and the lanes that its tracks have met are one Arrow group, its
    tracks each a plain list: Viterbi over corridors, smoothing, runs, then onset and completion about each step between
    adjacent corridors, from the offsets to the source corridor's line.  What belongs to a lane
    comes once a lane: ways out of it, neighbours that the map states or whole baselines show, the line.
    """
    maps = scenarios.select("scenario_token", "map_name")
    single = edges.groupBy("map_name", F.col("src_id").alias("object_id")).agg(F.collect_set("dst_id").alias("ways")).where(F.size("ways") == 1).select("map_name", "object_id", F.get("ways", F.lit(0)).alias("follower"))
    ahead = reachable(edges, t.lane_change_hops).groupBy("map_name", F.col("src").alias("object_id")).agg(F.collect_set("dst").alias("ahead"))
    beside = lambda df, name: df.groupBy("map_name", "object_id").agg(F.collect_set(F.struct("side", "adjacent_id")).alias(name))
    about = map_objects.select("map_name", "object_id").distinct()
    for part in (single, ahead, beside(adjacency, "beside"), beside(lane_sides(map_objects, t), "parallel"), corridor_lines(map_objects, edges, t.lane_change_hops).select("map_name", "object_id", "xs", "ys")):
        about = about.join(part, ["map_name", "object_id"], "left")
    about = cut(about)
    met = found.select(F.col("scenario_token").alias("of_scenario"), F.col("object_id").alias("met_id")).distinct()
    lanes = met.join(maps, F.col("of_scenario") == F.col("scenario_token")).withColumnRenamed("met_id", "object_id").drop("scenario_token").join(about, ["map_name", "object_id"], "left").drop("map_name")
    cand = found.join(chosen.select("scenario_token", "frame_index", "track_token", "primary_id", F.col("ambiguous").alias("unsure")), ["scenario_token", "frame_index", "track_token"], "left")
    own = entities.where(is_vehicle(F.col("agent_type"))).select(*KEYS, "speed", "x", "y")
    rows = own.join(cand.select("scenario_token", "frame_index", "track_token", "object_id", "center_covered", "overlap_ratio", "lateral_offset", F.col("map_heading").alias("lane_heading"), (F.col("object_id") == F.col("primary_id")).alias("is_primary"), "unsure"), ["scenario_token", "frame_index", "track_token"], "left")
    schema = "scenario_token string, track_token string, source_lane string, target_lane string, source_corridor string, target_corridor string, side string, onset_frame int, boundary_frame int, completion_frame int, score double, stable boolean, seen_before boolean, onset_by string, completion_by string"

    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [tuple(c.split()) for c in schema.split(", ")]

    def scan(seen: pa.Table, lanes: pa.Table) -> pa.Table:
        lane = {row["object_id"]: Lane(**row) for row in lanes.select(Lane._fields).to_pylist()}
        numbers = ("overlap_ratio", "lateral_offset", "lane_heading", "speed", "x", "y")
        columns = [seen[c].to_numpy().tolist() if c in numbers else seen[c].to_pylist() for c in Seen._fields]
        rows = sorted(map(Seen._make, zip(*columns, strict=True)), key=lambda r: (r.track_token, r.frame_index, r.object_id or ""))
        out = [event for token, own in groupby(rows, key=lambda r: r.track_token) for event in run(token, list(own), lane)]
        scenario = seen["scenario_token"][0].as_py() if rows else None
        return pa.table({name: pa.array([(scenario, *event)[i] for event in out], arrow[kind]) for i, (name, kind) in enumerate(fields)})

    def run(token: str, rows: list[Seen], lane: dict[str, Lane]) -> list[tuple]:
        out: list[tuple] = []
        at_frame = {r.frame_index: r for r in rows}
        frames = sorted(at_frame)
        known = [r for r in rows if r.object_id is not None]
        corridor = chains({r.object_id: lane[r.object_id].follower for r in known})
        states = [*sorted(set(corridor.values())), UNKNOWN]
        if len(frames) < 2 or len(states) < 3:
            return out
        place, number = {f: i for i, f in enumerate(frames)}, {s: i for i, s in enumerate(states)}
        best: dict[tuple[int, int], Seen] = {}
        for row in known:
            at = (place[row.frame_index], number[corridor[row.object_id]])
            if at not in best or (row.center_covered, row.overlap_ratio) > (best[at].center_covered, best[at].overlap_ratio):
                best[at] = row
        emission = np.empty((len(frames), len(states)))
        for i in range(len(frames)):
            some = any((i, s) in best for s in range(len(states) - 1))
            emission[i, -1] = COST["unknown"] if some else COST["unknown_alone"]
            for s in range(len(states) - 1):
                row = best.get((i, s))
                if row is None:
                    emission[i, s] = COST["absent"] if some else COST["absent_alone"]
                    continue
                worth = min(1.5, row.overlap_ratio + t.lane_change_center_bonus * row.center_covered + t.lane_change_primary_bonus * bool(row.is_primary) - t.lane_change_ambiguity_penalty * (row.unsure is True))
                cost = COST["base"] - COST["score"] * max(0.0, worth) - COST["overlap"] * row.overlap_ratio - COST["center"] * row.center_covered - COST["primary"] * bool(row.is_primary) + COST["ambiguous"] * (row.unsure is True)
                emission[i, s] = max(0.0, cost)
        side: dict[tuple[int, int], str] = {}
        # neighbours as the vehicle sees them where it is on both lanes, then those that the map states
        ahead = {name: set(lane[name].ahead or ()) for name in corridor}
        for _, beside in groupby(known, key=lambda r: r.frame_index):
            each = list(beside)
            for a, b in permutations(each, 2):
                one, other = corridor[a.object_id], corridor[b.object_id]
                apart = a.lateral_offset - b.lateral_offset
                if one == other or not max(BESIDE["least"], BESIDE["side"]) <= abs(apart) <= BESIDE["most"]:
                    continue
                turn = abs((a.lane_heading - b.lane_heading + np.pi) % (2 * np.pi) - np.pi)
                ways = ahead[a.object_id] | ahead[b.object_id]
                if turn <= BESIDE["heading"] and a.object_id not in ways and b.object_id not in ways:
                    side[number[one], number[other]] = "left" if apart > 0 else "right"
        for name, own in corridor.items():
            for stated, neighbours in ((True, lane[name].beside), (False, lane[name].parallel)):
                for b in neighbours if neighbours is not None else ():
                    if corridor.get(b["adjacent_id"], own) != own:
                        step = number[own], number[corridor[b["adjacent_id"]]]
                        # whole baselines speak where neither the map nor the place of the vehicle does
                        side[step] = b["side"] if stated else side.get(step, b["side"])
        ratio = lambda i, s: best[i, s].overlap_ratio if (i, s) in best else 0.0
        change = np.full((len(frames), len(states), len(states)), COST["far"])
        change[:, -1, :] = change[:, :, -1] = COST["to_unknown"]
        for s in range(len(states)):
            change[:, s, s] = COST["stay"]
        for (a, b), way in side.items():
            for i in range(1, len(frames)):
                gain = ratio(i, b) - ratio(i - 1, b) + ratio(i - 1, a) - ratio(i, a)
                cost = COST["change"] - COST["gain"] * min(COST["most_gain"], max(COST["least_gain"], gain))
                if (i, a) in best and (i - 1, a) in best:
                    drift = (best[i, a].lateral_offset - best[i - 1, a].lateral_offset) * (1 if way == "left" else -1)
                    cost += -min(COST["most_drift"], COST["drift"] * drift) if drift > COST["drift_from"] else min(COST["most_counter_drift"], -drift) if drift < -COST["drift_from"] else 0.0
                if (i, b) in best:
                    cost -= COST["arrived_primary"] * bool(best[i, b].is_primary) + COST["arrived_center"] * best[i, b].center_covered
                cost += min(COST["most_gap"], COST["gap_frame"] * (frames[i] - frames[i - 1] - 1))
                change[i, a, b] = max(COST["least_change"], cost)
        path = smooth([states[s] for s in decode(emission, change)], t.lane_change_unknown_gap)
        cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
        runs = [(path[a], a, b) for a, b in zip(cuts, cuts[1:], strict=False) if path[a] != UNKNOWN]
        time = np.array([at_frame[f].timestamp_us for f in frames])
        share = {(r.frame_index, r.object_id): r.overlap_ratio for r in known}
        for (src, a0, a1), (dst, b0, b1) in zip(runs, runs[1:], strict=False):
            way = side.get((number[src], number[dst]))
            if src == dst or way is None or at_frame[frames[b0]].speed < t.lane_change_speed:
                continue
            source = best.get((a1 - 1, number[src]))
            entry = best.get((b0, number[dst]))
            if source is None or entry is None:
                continue
            since = [i for i in range(a0, b0 + 1) if time[b0] - time[i] <= t.lane_change_onset_search_s * 1e6]
            start = next((best[i, number[src]].object_id for i in since if (i, number[src]) in best), source.object_id)
            first, onset_by = None, "source_end"
            if lane[start].xs is not None and len(lane[start].xs) >= 2:
                at = np.array([(at_frame[frames[i]].x, at_frame[frames[i]].y) for i in since])
                offset = profile(np.stack([lane[start].xs, lane[start].ys], -1), at) * (1 if way == "left" else -1)
                first, onset_by = onset(time[since], offset, np.array([share.get((frames[i], entry.object_id), 0.0) for i in since]), t)
            first = a1 - 1 if first is None else since[first]
            taken = [best.get((i, number[dst])) for i in range(b0, b1)]
            done, completion_by = completion(frames[b0:b1], [r.overlap_ratio if r else None for r in taken], [bool(r and r.center_covered) for r in taken], t)
            done, stable = max(b0 + done, first), completion_by == "stable"
            target = best.get((done, number[dst]), entry)
            score = 2.0 + (1.0 if a1 - a0 >= 2 else 0.5) + (2.0 if stable else 0.75) + 1.5 * bool(target.is_primary) + 1.5 * target.center_covered + (target.overlap_ratio >= 0.5) + 0.5 * (target.overlap_ratio > source.overlap_ratio) - 0.25 * (first == 0) - 0.5 * (not stable)
            out.append((token, source.object_id, target.object_id, src, dst, way, frames[first], frames[b0], frames[done], float(score), stable, first > 0, onset_by, completion_by))
        return out

    return rows.groupBy("scenario_token").cogroup(lanes.groupBy("of_scenario")).applyInArrow(scan, schema)


def lane_change_facts(events: DataFrame, entities: DataFrame, least_score: float = 3.25) -> DataFrame:
    """changesLane in every frame from onset to completion, of events with a score and a history."""
    ok = events.where((F.col("score") >= least_score) & F.col("seen_before"))
    own = entities.select(*KEYS)
    both = ok.join(own, ["scenario_token", "track_token"]).where(F.col("frame_index").between(F.col("onset_frame"), F.col("completion_frame")))
    return both.select(*KEYS, F.lit("changesLane").alias("predicate"), "source_lane", "target_lane", "side", "onset_frame", "completion_frame")


def merges(events: DataFrame, matched: DataFrame, scenarios: DataFrame, paths: DataFrame, t: Thresholds = T) -> DataFrame:
    """mergesInFrontOf and mergesBehind: after a completed lane change, the nearest vehicle on the target's path on either side.

    paths are unbranched ones.  The other vehicle was on the path before the boundary,
    goes the same way, keeps its order for the frames asked after completion, and is within the gap along
    the path, and the headway where it trails.  It changes lanes itself at no time
    between boundary and completion: an interval anti-join of the events with each other.
    """
    maps = scenarios.select("scenario_token", "map_name")
    # places of lanes before and behind the target lane, by their starts
    onward = paths.select("map_name", F.col("src").alias("target_lane"), F.col("dst").alias("primary_id"), F.col("offset").alias("start"))
    back = paths.where("src <> dst").select("map_name", F.col("dst").alias("target_lane"), F.col("src").alias("primary_id"), (-F.col("offset")).alias("start"))
    axis = onward.unionByName(back).groupBy("map_name", "target_lane", "primary_id").agg(F.min_by("start", F.abs("start")).alias("start"))
    own = matched.where(is_vehicle(F.col("agent_type")) & F.col("primary_id").isNotNull()).join(maps, "scenario_token").select("map_name", *KEYS, "primary_id", "progress", "speed", "length_m", "travel_heading")
    bound = matched.select("scenario_token", "track_token", F.col("frame_index").alias("boundary_frame"), F.col("timestamp_us").alias("boundary_us"))
    done = events.where("stable and seen_before").join(bound, ["scenario_token", "track_token", "boundary_frame"]).join(maps, "scenario_token").select("map_name", "scenario_token", "track_token", "target_lane", "boundary_frame", "completion_frame", "boundary_us")
    near = own.join(done.withColumnRenamed("track_token", "s_track"), ["map_name", "scenario_token"]).withColumn("since", (F.col("timestamp_us") - F.col("boundary_us")) / 1e6)
    near = near.where((F.col("since") >= -t.merge_preexistence_s) & (F.col("since") <= t.merge_confirmation_s + t.sample_interval_s * 8)).join(axis, ["map_name", "target_lane", "primary_id"]).withColumn("place", F.col("start") + F.col("progress"))
    key = ["scenario_token", "s_track", "boundary_frame", "completion_frame"]
    s = near.where("track_token = s_track").select(*key, "frame_index", "since", *(F.col(c).alias(f"s_{c}") for c in ("place", "speed", "length_m", "travel_heading")))
    o = near.where("track_token <> s_track").withColumnRenamed("track_token", "o_track")
    there = o.where("since < 0").select(*key, "o_track").distinct()
    both = s.where((F.col("frame_index") >= F.col("completion_frame")) & (F.col("frame_index") < F.col("completion_frame") + t.merge_stable_frames)).join(o.select(*key, "o_track", "frame_index", *(F.col(c).alias(f"o_{c}") for c in ("place", "speed", "length_m", "travel_heading"))), [*key, "frame_index"])
    busy = events.select("scenario_token", F.col("track_token").alias("o_track"), F.col("onset_frame").alias("from_frame"), F.col("completion_frame").alias("to_frame"))
    meets = (both["scenario_token"] == busy["scenario_token"]) & (both["o_track"] == busy["o_track"]) & (F.col("to_frame") >= F.col("boundary_frame")) & (F.col("from_frame") <= both["completion_frame"])
    both = both.join(busy, meets, "left_anti").where(difference(F.col("s_travel_heading"), F.col("o_travel_heading")) <= t.merge_same_flow)
    both = both.withColumn("ahead", F.col("o_place") - F.col("s_place")).withColumn("gap", F.abs("ahead") - (F.col("s_length_m") + F.col("o_length_m")) / 2)
    after = both.groupBy(*key, "o_track").agg(F.count(F.lit(1)).alias("n"), F.min("ahead").alias("lo"), F.max("ahead").alias("hi"), F.min_by("gap", "frame_index").alias("gap"), F.min_by("s_speed", "frame_index").alias("s_v"), F.min_by("o_speed", "frame_index").alias("o_v"))
    after = after.where((F.col("n") >= t.merge_stable_frames) & ((F.col("lo") > 0) | (F.col("hi") < 0)) & F.col("gap").between(0, t.merge_gap))
    behind = F.col("lo") > 0
    trailing = F.when(behind, F.col("s_v")).otherwise(F.col("o_v"))
    after = after.where((trailing <= t.forward_speed) | (F.col("gap") / trailing <= t.merge_headway_s)).join(there, [*key, "o_track"], "left_semi")
    nearest = Window.partitionBy("scenario_token", "s_track", "boundary_frame", behind).orderBy("gap", "o_track")
    first = after.withColumn("rank", F.row_number().over(nearest)).where("rank = 1")
    return first.select(F.when(behind, "mergesBehind").otherwise("mergesInFrontOf").alias("predicate"), "scenario_token", F.col("s_track").alias("track_token"), "o_track", "boundary_frame", "completion_frame", "gap")


def overtakes(pairs: DataFrame, ahead: DataFrame, scenarios: DataFrame, adjacency: DataFrame, t: Thresholds = T) -> DataFrame:
    """One row per overtake: start, departure, side by side, reversal, clearance, return and completion frames.

    pairs: ordered pairs of vehicles within reach, on the axis of both headings, with their primary lanes and speeds as seen.  Lanes
    that lead into each other are one way; a lane is beside another way if it leads
    to, or comes from, a neighbour of it.  SQL first keeps pairs that change order and
    have been beside each other; only those are scanned, one pass over a task's sorted rows, no group a pair.  Completions of one pair close
    in time are one overtake, the one of the largest clearance.
    """
    maps = scenarios.select("scenario_token", "map_name")
    lanes = adjacency.select("map_name", F.col("object_id").alias("src"))
    same = ahead.select("map_name", "src", "dst").unionByName(ahead.select("map_name", F.col("dst").alias("src"), F.col("src").alias("dst")))
    same = same.unionByName(same.select("map_name", "src", F.col("src").alias("dst"))).unionByName(lanes.select("map_name", "src", F.col("src").alias("dst"))).distinct()
    way = same.select("map_name", F.col("src").alias("o_primary_id"), F.col("dst").alias("s_primary_id"), F.lit(True).alias("one_way"))
    near = adjacency.select("map_name", F.col("object_id").alias("o_primary_id"), F.col("adjacent_id").alias("src"), "side").join(same, ["map_name", "src"])
    near = near.groupBy("map_name", "o_primary_id", F.col("dst").alias("s_primary_id")).agg(F.min("side").alias("passing_side")).join(way, ["map_name", "o_primary_id", "s_primary_id"], "left_anti")
    own = pairs.join(maps, "scenario_token").join(way, ["map_name", "o_primary_id", "s_primary_id"], "left").join(near, ["map_name", "o_primary_id", "s_primary_id"], "left")
    one = F.coalesce(F.col("one_way") | (F.col("s_primary_id") == F.col("o_primary_id")), F.col("s_primary_id") == F.col("o_primary_id"), F.lit(False))
    own = own.select("scenario_token", "s_track", "o_track", "frame_index", "timestamp_us", one.alias("same"), "passing_side", "axis_ahead", "axis_aside", "behind_gap", "clearance", "level", "heading_difference", "s_forward_speed_seen", "o_forward_speed_seen")
    key = ["scenario_token", "s_track", "o_track"]
    pair = Window.partitionBy(*key).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = dealt(own, *key).withColumns({"n": F.count(F.lit(1)).over(pair), "hi": F.max("axis_ahead").over(pair), "lo": F.min("axis_ahead").over(pair), "apart": F.count("passing_side").over(pair)})
    kept = own.where((F.col("n") >= t.overtake_common_frames) & (F.col("hi") > 0) & (F.col("lo") < 0) & (F.col("apart") > 0)).drop("n", "hi", "lo", "apart")
    schema = "scenario_token string, s_track string, o_track string, start_frame int, departure_frame int, side_frame int, reversal_frame int, clearance_frame int, return_frame int, completion_frame int, passing_side string, duration_s double"
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    out = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            # the last pair may go on in the next batch
            cuts = pair_cuts(table, key)
            rest = table.slice(cuts[-2]) if len(cuts) > 1 else None
            if len(cuts) > 2:
                yield events(table.slice(0, cuts[-2]), cuts[:-1])
        if rest is not None:
            yield events(rest, [0, rest.num_rows])

    def events(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        rows = []
        for found in overtakes_of(table, cuts, t):
            names = [table[c][found[0]].as_py() for c in key]
            time = [table["timestamp_us"][found[i]].as_py() for i in (0, -1)]
            rows.append((*names, *(table["frame_index"][i].as_py() for i in found), table["passing_side"][found[1]].as_py(), (time[1] - time[0]) / 1e6))
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(out)], schema=out)

    return kept.sortWithinPartitions(*key, "frame_index").mapInArrow(run, schema)


def pair_cuts(table: pa.Table, key: list[str]) -> list[int]:
    """Rows where the key differs from the row's before, with 0 and the number of rows."""
    codes = [pc.fill_null(table[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in key]
    new = np.any([np.diff(c) != 0 for c in codes], axis=0)
    return sorted({0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows})


def overtakes_of(table: pa.Table, cuts: list[int], t: Thresholds = T) -> Iterator[tuple[int, ...]]:
    """Rows of start, departure, side by side, reversal, clearance, return and completion of each overtake; pairs lie between the cuts, their rows in order of time.

    Each condition is decided for all rows at once; what comes next of a pair is the
    next row in the condition's list.
    """
    number = lambda c: table[c].to_numpy().astype(float)
    flag = lambda c: pc.fill_null(table[c], False).to_numpy()
    clear_by, time = number("clearance"), table["timestamp_us"].to_numpy()
    same, beside = flag("same"), pc.is_valid(table["passing_side"]).to_numpy()
    flow = number("heading_difference") <= t.overtake_same_flow
    s_v, o_v = (np.nan_to_num(number(f"{p}_forward_speed_seen")) for p in "so")
    faster = s_v - o_v
    steady = np.convolve(same, np.ones(t.overtake_stable_frames, int))[: len(same)] == t.overtake_stable_frames
    listed = lambda held: np.flatnonzero(held).tolist()
    starts = listed(same & (number("behind_gap") >= t.overtake_behind_gap) & (s_v >= t.overtake_subject_speed) & (o_v >= t.overtake_object_speed) & flow)
    leaves, levels = listed(beside), listed(beside & flag("level") & (np.abs(number("axis_aside")) >= t.overtake_side_lateral) & flow)
    turns, clears, backs, stable = listed(number("axis_ahead") > 0), listed(clear_by >= t.overtake_clearance), listed(same), listed(steady)
    later = ((leaves, 1), (levels, 0), (turns, 0), (clears, 0), (backs, 0), (stable, t.overtake_stable_frames - 1))

    def first(rows: list[int], lo: int, end: int) -> int | None:
        i = bisect_left(rows, lo)
        return rows[i] if i < len(rows) and rows[i] < end else None

    for at, end in zip(cuts, cuts[1:], strict=False):
        found: list[tuple[int, ...]] = []
        while (start := first(starts, at, end)) is not None:
            steps = [start]
            for rows, wait in later:
                step = first(rows, steps[-1] + wait, end)
                if step is None:
                    break
                steps.append(step)
            if len(steps) <= len(later):
                break
            clear, done, at = steps[4], steps[-1], start + 1
            if (time[done] - time[start]) / 1e6 > t.overtake_duration_s or faster[start : clear + 1].max() < t.overtake_relative_speed or flow[start : clear + 1].mean() < t.overtake_same_flow_share:
                continue
            at = done + 1
            # completions close in time are one overtake
            if found and time[done] - time[found[-1][-1]] <= t.overtake_dedupe_s * 1e6:
                found[-1] = max(found[-1], tuple(steps), key=lambda x: (clear_by[x[4]], time[x[0]] - time[x[-1]]))
            else:
                found.append(tuple(steps))
        yield from found


def maneuver_facts(matched: DataFrame, scenarios: DataFrame, adjacency: DataFrame, t: Thresholds = T) -> DataFrame:
    """Entry and exit of connectors, turns over the connector, stable lane changes, keepsLane; by windows over the track.

    A track's first frames and seconds state nothing, as there is no history yet.
    """
    order = Window.partitionBy("scenario_token", "track_token").orderBy("frame_index")
    lag = lambda c, n=1: F.lag(c, n).over(order)
    lane, link = F.when(F.col("primary_kind") == "lane", F.col("primary_id")), F.when(F.col("primary_kind") == "lane_connector", F.col("primary_id"))
    df = matched.join(scenarios.select("scenario_token", "map_name"), "scenario_token").select("map_name", *KEYS, "x", "y", "heading", lane.alias("lane"), link.alias("link"))
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("old", (F.count(F.lit(1)).over(past) > t.maneuver_history_frames) & ((F.col("timestamp_us") - F.first("timestamp_us").over(past)) / 1e6 >= t.maneuver_history_s))
    df = df.withColumns({"p_lane": lag("lane"), "p_link": lag("link"), "turned": F.coalesce(wrap(F.col("heading") - lag("heading")), F.lit(0.0))})
    entered = F.col("p_lane").isNotNull() & F.col("link").isNotNull()
    df = df.withColumn("visit", F.sum(entered.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("scenario_token", "track_token", "visit").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("first_turn", F.first("turned").over(run)).withColumn("sum_turn", F.sum("turned").over(run) - F.col("first_turn")).withColumn("n_exits", F.sum((F.col("p_link").isNotNull() & F.col("lane").isNotNull()).cast("int")).over(run))
    exited = (F.col("visit") > 0) & F.col("p_link").isNotNull() & F.col("lane").isNotNull() & (F.col("n_exits") == 1)
    turn = F.when(F.abs("sum_turn") >= t.uturn_angle, "makesUTurn").when(F.col("sum_turn") >= t.turn_angle, "turnsLeft").when(F.col("sum_turn") <= -t.turn_angle, "turnsRight").otherwise("goesStraight")
    n = t.stable_lane_frames
    steady = lambda end: F.when((F.min("lane").over(order.rowsBetween(end - n + 1, end)) == F.max("lane").over(order.rowsBetween(end - n + 1, end))) & (F.count("lane").over(order.rowsBetween(end - n + 1, end)) == n), F.min("lane").over(order.rowsBetween(end - n + 1, end)))
    df = df.withColumns({"target": steady(0), "source": steady(-n), "p_x": lag("x", n), "p_y": lag("y", n), "p_h": lag("heading", n)})
    near = adjacency.groupBy("map_name", F.col("object_id").alias("source"), F.col("adjacent_id").alias("target")).agg(F.min("side").alias("side"))
    df = df.join(near, ["map_name", "source", "target"], "left")
    shift = F.cos("p_h") * (F.col("y") - F.col("p_y")) - F.sin("p_h") * (F.col("x") - F.col("p_x"))
    way = F.coalesce("side", F.when(F.abs(shift) >= 0.75, F.when(shift > 0, "left").otherwise("right")))
    changed = F.when(F.col("target").isNotNull() & F.col("source").isNotNull() & (F.col("target") != F.col("source")) & F.col("link").isNull() & F.col("p_link").isNull(), F.when(way == "left", "changesLaneLeft").when(way == "right", "changesLaneRight"))
    keeps = ~entered & ~exited & changed.isNull() & (F.col("lane") == F.col("p_lane"))
    each = F.array(F.when(entered, "entersLaneConnector"), F.when(exited, "exitsLaneConnector"), F.when(exited, turn), changed, F.when(keeps, "keepsLane"))
    return df.where("old").select(*KEYS, F.coalesce("link", "lane").alias("object_id"), F.explode(F.filter(each, lambda p: p.isNotNull())).alias("predicate"))

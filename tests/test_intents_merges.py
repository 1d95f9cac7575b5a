"""Shared regions of widened paths, intents from them, and merges into a stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scenes import COLUMNS, frames_of, row

from waygraph.functions.buffers import shared_region
from waygraph.operators import entities, following, future, mapmatch, maneuvers
from waygraph.plans.scene import MAP_SCHEMA


def dense(one, r1, two, r2, step=0.02):
    """Area and centroid of a fine grid of points that lie near both."""
    pts = np.concatenate([one, two])
    r = max(r1, r2)
    gx, gy = (np.arange(pts[:, k].min() - r, pts[:, k].max() + r, step) for k in (0, 1))
    p = np.stack(np.meshgrid(gx, gy), -1).reshape(-1, 1, 2)

    def near(line, radius):
        a, b = line[None, :-1], line[None, 1:]
        t = np.clip(((p - a) * (b - a)).sum(-1) / np.maximum(((b - a) ** 2).sum(-1), 1e-12), 0, 1)[..., None]
        return (((p - a - t * (b - a)) ** 2).sum(-1) <= radius**2).any(1)

    hit = p[near(one, r1) & near(two, r2), 0]
    return (len(hit) * step**2, *hit.mean(0)) if len(hit) else None


def test_straight_crossing_is_a_rectangle():
    one, two = np.array([(-10, 0), (10, 0)], float), np.array([(3, -8), (3, 9)], float)
    area, x, y = shared_region(one, 1.0, two, 0.5)
    assert (area, x, y) == (pytest.approx(2.0, abs=0.06), pytest.approx(3.0), pytest.approx(0.0, abs=0.03))
    assert shared_region(one, 1.0, two + [40, 0], 0.5) is None and shared_region(one, 1.0, two + [0, 60], 0.5) is None


@pytest.mark.parametrize("seed", range(12))
def test_regions_are_dense_samples(seed):
    rng = np.random.default_rng(seed)
    one, two = (np.cumsum(rng.normal(0, 1.2, (6, 2)) + [1.5, 0.4 * k], 0) for k in (-1, 1))
    two = two + rng.normal(0, 1.5, 2) - [0, 2]
    if seed % 4 == 3:
        two = one[::-1] + 0.3  # the same way, back
    got, want = shared_region(one, 0.9, two, 0.6), dense(one, 0.9, two, 0.6)
    assert (got is None) == (want is None)
    if want:
        assert got[0] == pytest.approx(want[0], rel=0.02, abs=0.05) and got[1:] == (pytest.approx(want[1], abs=0.05), pytest.approx(want[2], abs=0.05))


def test_region_keeps_its_place_while_paths_shorten():
    one, two = np.stack([np.linspace(-20, 20, 30), np.sin(np.linspace(-2, 2, 30))], 1), np.array([(4.0, y) for y in np.linspace(-15, 15, 20)])
    regions = {tuple(round(v, 6) for v in shared_region(one[k:], 1.0, two[k // 3 :], 1.0)) for k in range(0, 12, 3)}
    assert len(regions) == 1


def bends(frames=14):
    """A turns left before B, who comes straight on; A brakes, waits until B has passed, and goes."""
    rows = []
    for f in range(frames):
        t = 0.5 * f
        s = min(4.0 * t, 6.0) if t < 4.5 else 6.0 + 3.0 * (t - 4.5)
        v = 4.0 if t < 1.5 else 0.0 if t < 4.5 else 3.0
        x, y = (s, 0.0) if s < 8 else (8 + 4 * math.sin(min((s - 8) / 4, 1.57)), 4 - 4 * math.cos(min((s - 8) / 4, 1.57)))
        rows.append(row(f, "A", 1, x, y, v))
        rows.append(row(f, "B", 2, 30 - 6.0 * t, 2.0, -6.0))
        rows.append(row(f, "P", 3, 9, -4 + t, 0, 1, kind="PEDESTRIAN", size=(0.6, 0.6)))
    return rows


def moved(spark, rows, ids=None):
    df = entities.with_history(entities.with_motion(spark.createDataFrame(rows, COLUMNS)))
    return df.withColumn("primary_id", F.lit(None).cast("string") if ids is None else ids)


def brute_intents(rows, horizon=6.0):
    """The rules by plain loops over each pair and frame; no gaps in the frames."""
    tracks = {}
    for r in rows:
        if r[6] != "PEDESTRIAN":
            tracks.setdefault(r[3], {})[r[1]] = r
    out, state = set(), {}
    for f in sorted({r[1] for r in rows}):
        for s in tracks:
            for o in tracks:
                if s == o or f not in tracks[s] or f not in tracks[o]:
                    continue
                path = {k: [r for g, r in sorted(tracks[k].items()) if f <= g and (r[2] - f * 500_000) / 1e6 <= horizon] for k in (s, o)}
                if min(map(len, path.values())) < 2:
                    continue
                line = {k: np.array([(r[7], r[8]) for r in p]) for k, p in path.items()}
                region = dense(line[s], 1.0, line[o], 1.0, 0.05)
                if region is None:
                    continue
                arrival = {k: next(((r[2] - f * 500_000) / 1e6 for r, p in zip(path[k], line[k], strict=True) if np.hypot(*(p - region[1:])) <= 2.0), None) for k in (s, o)}
                speed = {k: math.hypot(tracks[k][f][12], tracks[k][f][13]) for k in (s, o)}
                slows = {k: f - 1 in tracks[k] and (speed[k] - math.hypot(tracks[k][f - 1][12], tracks[k][f - 1][13])) / 0.5 <= -0.3 for k in (s, o)}
                before = lambda a, b: arrival[a] is not None and (arrival[b] is None or arrival[a] + 1.5 < arrival[b])  # noqa: B023, E731
                gives = lambda a, b: (slows[a] or speed[a] <= 0.3) and before(b, a)  # noqa: B023, E731
                rules = {
                    "yieldingTo": gives(s, o),
                    "waitingFor": speed[s] <= 0.3 and arrival[o] is not None and arrival[o] <= 3,
                    "competingForGapWith": s < o and None not in arrival.values() and abs(arrival[s] - arrival[o]) <= 1.5 and not gives(s, o) and not gives(o, s),
                }
                for name, ok in rules.items():
                    key = (s, o, tuple(round(v, 0) for v in region), name)
                    if not ok:
                        state.pop(key, None)
                    else:
                        start = state.setdefault(key, f)
                        if (f - start) * 0.5 >= 1.0:
                            out.add((f, s, o, name))
    return out


def test_intents_on_bent_paths_are_brute_force(spark):
    rows = bends()
    found = future.conflicts_of_paths(future.future_paths(moved(spark, rows)))
    got = {(r.frame_index, r.s_track, r.o_track, r.predicate) for r in future.intents(found, frames_of(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert got == brute_intents(rows)
    assert {"yieldingTo", "waitingFor"} <= {p for *_, p in got} and all(s == "A" for _, s, _, p in got if p != "competingForGapWith")


def test_intents_end_with_a_gap(spark):
    rows = [r for r in bends() if r[1] != 6]
    found = future.conflicts_of_paths(future.future_paths(moved(spark, rows)))
    got = future.intents(found, frames_of(spark.createDataFrame(rows, COLUMNS))).where("predicate = 'waitingFor'").collect()
    assert got and all(not (r.start_us < 3_000_000 < r.timestamp_us) for r in got)


def test_creating_a_gap(spark):
    """A slows on lane L while B, ahead, gets further away and comes onto L."""
    rows, at = [], 0.0
    for f in range(12):
        v = max(2.0, 8.0 - 0.8 * f)
        rows += [row(f, "A", 1, at, 0, v), row(f, "B", 2, 10 + 4.5 * f, max(0.0, 3.5 - 0.5 * f), 9.0)]
        at += v / 2
    lane = F.when((F.col("track_token") == "A") | (F.col("y") < 1.75), "L").otherwise("K")
    found = future.conflicts_of_paths(future.future_paths(moved(spark, rows, lane)))
    got = future.intents(found, frames_of(spark.createDataFrame(rows, COLUMNS))).where("predicate = 'creatingGapFor'").collect()
    assert got and {(r.s_track, r.o_track) for r in got} == {("A", "B")}
    # once B is on A's lane itself, nothing more is asked for
    assert max(r.frame_index for r in got) < next(f for f in range(12) if max(0.0, 3.5 - 0.5 * f) < 1.75)


LANES = [
    ("m0", "lane", name, [(0.0, y - 2), (100.0, y - 2), (100.0, y + 2), (0.0, y + 2)], [(0.0, y), (100.0, y)], 100.0, None, None, None)
    for name, y in (("S0", 0.0), ("T0", 4.0), ("U0", 8.0))
]
MOVE = [(5.0, 0.0), (10.0, 0.0), (15.0, 0.4), (20.0, 1.4), (25.0, 2.8), (30.0, 4.0), (35.0, 4.0), (40.0, 4.0)]


def merged(spark, others):
    """others: track to (frame, x, y, vx) of the subject's x and frame."""
    rows = [row(f, "subject", 1, x, y, 10.0) for f, (x, y) in enumerate(MOVE)]
    for i, (name, place) in enumerate(others.items()):
        for f, (x, _) in enumerate(MOVE):
            at = place(f, x)
            if at:
                rows.append(row(f, name, 2 + i, at[0], at[1], at[2]))
    shapes, edges = spark.createDataFrame(LANES, MAP_SCHEMA), spark.createDataFrame([], "map_name string, src_id string, dst_id string")
    sides = spark.createDataFrame([], "map_name string, object_id string, side string, adjacent_id string")
    where, route = spark.createDataFrame([("s", "m0")], "scenario_token string, map_name string"), spark.createDataFrame([], "scenario_token string, ordinal int, roadblock_id string")
    df = spark.createDataFrame(rows, COLUMNS)
    found = mapmatch.candidates(df, where, shapes)
    chosen, history = mapmatch.primary(found), entities.with_history(entities.with_motion(df))
    matched = mapmatch.travel_direction(mapmatch.with_map(history, chosen, where, shapes, edges, sides, route))
    events = maneuvers.lane_changes(matched, found, chosen, where, edges, sides, shapes)
    out = maneuvers.merges(events, matched, where, following.unbranched_paths(shapes, edges, 6)).collect()
    return {(r.predicate, r.track_token, r.o_track) for r in out}


@pytest.mark.parametrize(
    "others, want",
    [
        ({"o": lambda f, x: (x - 8, 4.0, 10.0)}, {("mergesInFrontOf", "o")}),
        ({"o": lambda f, x: (x + 10, 4.0, 10.0)}, {("mergesBehind", "o")}),
        ({"o": lambda f, x: (x - 7, 4.0, 10.0), "p": lambda f, x: (x + 12, 4.0, 10.0)}, {("mergesInFrontOf", "o"), ("mergesBehind", "p")}),
        ({"near": lambda f, x: (x - 7, 4.0, 10.0), "far": lambda f, x: (x - 20, 4.0, 10.0)}, {("mergesInFrontOf", "near")}),
        ({"late": lambda f, x: (x - 8, 4.0, 10.0) if f >= 5 else None}, set()),
        ({"against": lambda f, x: (x + 14, 4.0, -10.0)}, set()),
        # it comes into the same lane from the other side, in the same frames
        ({"also": lambda f, x: (x - 9, 8.0 - [0, 0, 0.4, 1.4, 2.8, 4.0, 4.0, 4.0][f], 10.0)}, set()),
    ],
)
def test_merges(spark, others, want):
    assert {(p, o) for p, s, o in merged(spark, others) if s == "subject"} == want

"""Lane sides, corridor lines and lane changes on bent lanes, against dense walks along them."""

import math

import numpy as np
import pytest
from test_scenes import COLUMNS, row

from waygraph.functions import kernels
from waygraph.operators import entities, lanes, mapmatch, maneuvers
from waygraph.plans.scene import MAP_SCHEMA

R, STEP = 80.0, 0.05


def arc(radius, a, b, n=24):
    """Points of an arc about (0, R), driven counter-clockwise from the south."""
    return [(radius * math.sin(t), R - radius * math.cos(t)) for t in np.linspace(a, b, n)]


def lane(name, radius, a, b, kind="lane", width=4.0):
    line = arc(radius, a, b)
    shape = arc(radius + width / 2, a, b) + arc(radius - width / 2, a, b)[::-1]
    return ("m0", kind, name, [tuple(map(float, p)) for p in shape], [tuple(map(float, p)) for p in line], float(np.hypot(*np.diff(np.array(line), axis=0).T).sum()), 13.0, None, None)


#: Two lanes about one centre, the inner one on the left, each in two parts; one lane that crosses, one too far.
LANES = [lane("R1", R, 0.0, 0.5), lane("R2", R, 0.5, 1.2), lane("L1", R - 4, 0.0, 0.6), lane("L2", R - 4, 0.6, 1.2), lane("F", R - 16, 0.0, 1.2)]
ACROSS = ("m0", "lane", "X", [(10.0, -20.0), (14.0, -20.0), (14.0, 30.0), (10.0, 30.0)], [(12.0, -20.0), (12.0, 30.0)], 50.0, None, None, None)
EDGES = [("m0", "R1", "R2"), ("m0", "L1", "L2")]


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([*LANES, ACROSS], MAP_SCHEMA)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "map_name string, src_id string, dst_id string")


def walk(line):
    """A polyline in small steps: points and directions."""
    line, points, ways = np.array(line), [], []
    for p, q in zip(line, line[1:], strict=False):
        n = max(2, int(np.hypot(*(q - p)) / STEP))
        points += [p + (q - p) * k / n for k in range(n)]
        ways += [math.atan2(*(q - p)[::-1])] * n
    return np.array(points), np.array(ways)


def brute_sides():
    out, near = {}, lambda a, b: min(np.hypot(*(walk([*b, b[0]])[0] - p).T).min() for p in walk([*a, a[0]])[0][::10])
    for a in [*LANES, ACROSS]:
        points, ways = walk(a[4])
        middle, way = points[len(points) // 2], ways[len(points) // 2]
        for b in [*LANES, ACROSS]:
            if a is b:
                continue
            others, directions = walk(b[4])
            k = np.hypot(*(others - middle).T).argmin()
            gap, turn = float(np.hypot(*(others[k] - middle))), abs((directions[k] - way + math.pi) % (2 * math.pi) - math.pi)
            lateral = -math.sin(way) * (others[k] - middle)[0] + math.cos(way) * (others[k] - middle)[1]
            if turn <= 0.3 and 2 <= gap <= 6.5 and abs(lateral) > 0.25 and near(a[3], b[3]) <= 1.5:
                out[a[2], b[2]] = ("left" if lateral > 0 else "right", gap)
    return out


def test_lane_sides_are_brute_force(shapes):
    got = {(r.object_id, r.adjacent_id): (r.side, r.gap) for r in lanes.lane_sides(shapes).collect()}
    want = brute_sides()
    assert {k: s for k, (s, _) in got.items()} == {k: s for k, (s, _) in want.items()}
    assert got["R1", "L1"][0] == "left" and got["L2", "R2"][0] == "right" and ("L1", "F") not in got
    assert all(g == pytest.approx(want[k][1], abs=0.05) for k, (_, g) in got.items())


def test_corridor_lines(shapes, edges):
    got = {r.object_id: r for r in lanes.corridor_lines(shapes, edges).collect()}
    assert got["R1"].lanes == ["R1", "R2"] and got["L2"].lanes == ["L2"]
    line = np.stack([got["R1"].xs, got["R1"].ys], 1)
    assert len(line) == 2 * 24 - 1  # the joint counts once
    assert got["R1"].along[0] == 0 and got["R1"].along[-1] == pytest.approx(LANES[0][5] + LANES[1][5])
    assert np.allclose(np.diff(got["R1"].along), np.hypot(*np.diff(line, axis=0).T))


def test_profile_is_a_dense_walk(shapes, edges):
    r = next(r for r in lanes.corridor_lines(shapes, edges).collect() if r.object_id == "R1")
    line = np.stack([r.xs, r.ys], 1)
    rng, (points, _) = np.random.default_rng(1), walk(line)
    for p in [np.array(arc(R + d, t, t, 1)[0]) for t, d in zip(rng.uniform(0.05, 1.15, 60), rng.uniform(-5, 5, 60), strict=True)]:
        far = np.hypot(*(points - p).T)
        inner = np.hypot(*(p - [0, R])) < np.hypot(*(points[far.argmin()] - [0, R]))
        assert lanes.profile(line, p[None])[0] == pytest.approx(far.min() * (1 if inner else -1), abs=0.06)


def drive(offsets, speed=8.0):
    """A vehicle that moves to the inside of the bend by these metres, frame by frame."""
    rows = []
    for f, d in enumerate(offsets):
        t = 0.1 + speed * f * 0.5 / R
        x, y = arc(R - d, t, t, 1)[0]
        r = list(row(f, "a", 1, x, y, speed * math.cos(t), speed * math.sin(t)))
        r[9], r[10], r[11] = t, math.cos(t), math.sin(t)
        rows.append(tuple(r))
    return rows


def changes(spark, offsets, shapes, edges, adjacent=()):
    df = spark.createDataFrame(drive(offsets), COLUMNS)
    where = spark.createDataFrame([("s", "m0")], "scenario_token string, map_name string")
    sides = spark.createDataFrame(list(adjacent), "map_name string, object_id string, side string, adjacent_id string")
    found = mapmatch.candidates(df, where, shapes)
    moving = entities.with_history(entities.with_motion(df))
    return maneuvers.lane_changes(moving, found, mapmatch.primary(found), where, edges, sides, shapes).collect()


OFFSETS = [0, 0, 0, 0, 0.4, 1.5, 2.5, 3.6, 4, 4, 4, 4]


@pytest.mark.parametrize("adjacent", [(), (("m0", "R1", "left", "L1"), ("m0", "R2", "left", "L2"))])
def test_lane_change_on_a_bend(spark, shapes, edges, adjacent):
    """No lane's own end is a change, and the window is that of the offsets which the vehicle was given."""
    (got,) = changes(spark, OFFSETS, shapes, edges, adjacent)
    assert (got.side, got.source_lane[0], got.target_lane[0]) == ("left", "R", "L")
    assert (got.onset_frame, got.boundary_frame, got.completion_frame) == (4, 6, 6)
    assert got.stable and got.seen_before and (got.onset_by, got.completion_by) == ("lateral_speed", "stable")


def test_slow_drift_begins_by_its_offset(spark, shapes, edges):
    offsets = [0.05 * f for f in range(8)] + [0.8, 1.6, 2.4, 3.2, 4, 4, 4]
    (got,) = changes(spark, offsets, shapes, edges)
    moved = np.array(offsets) - 0.025
    assert got.onset_frame == next(i for i in range(len(offsets)) if moved[i] >= 0.15) and got.onset_by == "lateral_offset"


def test_windows():
    us = np.arange(8) * 500_000
    none = np.zeros(8)
    assert maneuvers.onset(us, none, none) == (None, "source_end")
    assert maneuvers.onset(us, none, np.array([0, 0, 0, 0, 0, 0.2, 0.5, 0.9])) == (5, "target_overlap")
    back_and_forth = np.array([0, 0, 0.3, 0.0, 0.2, 0.5, 1.0, 2.0])
    assert maneuvers.onset(us, back_and_forth, none)[0] == 4
    assert maneuvers.completion([3, 4, 5, 6], [0.5, 0.7, 0.8, 0.9], [False, True, True, True]) == (1, "stable")
    assert maneuvers.completion([3, 4, 6, 8], [0.5, 0.7, 0.8, 0.9], [False, True, True, True]) == (3, "single_frame")
    assert maneuvers.completion([3, 4], [0.5, None], [False, False]) == (0, "target_entry")


def test_polygons_distance():
    a = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert kernels.polygons_distance(a, a + [7, 4]) == pytest.approx(3)
    assert kernels.polygons_distance(a, a / 4 + [1, 1]) == 0  # one within the other
    assert kernels.polygons_distance(a, np.array([(-1, 1), (5, 1), (5, 2), (-1, 2)], float)) == 0  # no corner in the other

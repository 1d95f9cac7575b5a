"""Distances to areas and the gates of crossings, on maps made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scenes import COLUMNS, frames_of, row

from waygraph.functions import kernels
from waygraph.operators import areas, crossing, pairs
from waygraph.plans.scene import MAP_SCHEMA


def area(kind, name, points):
    return ("m0", kind, name, [(float(x), float(y)) for x, y in points], [], None, None, None, None)


def box(kind, name, x0, y0, x1, y1):
    return area(kind, name, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


@pytest.fixture(scope="module")
def scenarios(spark):
    return spark.createDataFrame([("s", "m0")], "scenario_token string, map_name string")


def met(kind="PEDESTRIAN", moving=True):
    """The reference's crossing: S along x, O standing north at (4, -1)."""
    rows = []
    for f in range(5):
        rows.append(row(f, "S", 1, f if moving else 0.0, 0, 2.0, kind=kind, size=(0.8, 0.8) if kind == "PEDESTRIAN" else (4.5, 2.0)))
        rows.append(row(f, "O", 2, 4, -1, north=True))
    return rows


def found(spark, scenarios, rows, shapes):
    df = spark.createDataFrame(rows, COLUMNS)
    meetings = crossing.meetings(pairs.with_kinematics(pairs.all_pairs(df)), crossing.track_pairs(df))
    barred = areas.gates(df, scenarios, spark.createDataFrame(shapes, MAP_SCHEMA))
    reasons = {tuple(r) for r in crossing.gated(meetings, barred).where("s_track = 'S'").select("s_reason", "o_reason").distinct().collect()}
    return crossing.crossings(meetings, frames_of(df), barred).where("s_track = 'S'").count(), reasons


ROAD = box("lane", "L", -20, -3, 20, 3)


@pytest.mark.parametrize(
    "kind, shapes, frames, reasons",
    [
        ("PEDESTRIAN", [], 5, {(None, None)}),  # no map: nothing is turned down
        ("PEDESTRIAN", [ROAD], 0, {("far_from_crosswalk", None)}),
        ("PEDESTRIAN", [ROAD, box("crosswalk", "W", 3, 7.9, 6, 12)], 0, {("far_from_crosswalk", None)}),
        ("PEDESTRIAN", [ROAD, box("crosswalk", "W", 0, 4.9, 6, 12)], 5, {(None, None)}),
        ("PEDESTRIAN", [ROAD, box("intersection", "I", 0, 4.9, 6, 12)], 5, {(None, None)}),
        ("VEHICLE", [ROAD], 5, {(None, None)}),
        ("VEHICLE", [ROAD, box("carpark", "P", -30, 0.9, 1, 9)], 1, {("in_carpark", None), (None, None)}),  # by its footprint
        ("VEHICLE", [box("lane", "L", -20, 5.5, 20, 9)], 0, {(None, "parked")}),
        ("VEHICLE", [box("lane", "L", -20, 6.5, 20, 9)], 0, {("far_from_road", "parked")}),
        ("VEHICLE", [ROAD, box("carpark", "P", 6.0, -2, 9, 2)], 4, {("in_carpark", None), (None, None)}),
        ("BICYCLE", [box("drivable_area", "D", -20, 2.9, 20, 9), box("lane", "L", 3.5, -2, 4.5, 0)], 5, {(None, None)}),
        ("BICYCLE", [box("lane", "L", 10.5, -2, 12, 0)], 0, {("far_from_crosswalk_and_road", "parked")}),
    ],
)
def test_gates(spark, scenarios, kind, shapes, frames, reasons):
    if not shapes:
        shapes = [("other", *ROAD[1:])]
    assert found(spark, scenarios, met(kind), shapes) == (frames, reasons)


def test_distances_are_brute_force(spark, scenarios):
    rng = np.random.default_rng(5)
    rows = [row(0, f"t{i}", i, *rng.uniform(-120, 120, 2)) for i in range(150)]
    bent = [(0, 0), (40, 0), (40, 10), (10, 10), (10, 60), (0, 60)]
    kinds = ["lane", "lane_connector", "intersection", "crosswalk", "carpark", "drivable_area"]
    shapes = [area(kinds[i % 6], f"a{i}", [(x + 25 * (i % 7) - 90, y + 21 * (i // 7) - 90) for x, y in bent]) for i in range(40)]
    got = {r.track_token: r for r in areas.area_distances(spark.createDataFrame(rows, COLUMNS), scenarios, spark.createDataFrame(shapes, MAP_SCHEMA)).collect()}
    assert len(got) == 150
    for r in rows:
        p, own = np.array([[r[7], r[8]]]), {}
        for _, kind, _, shape, *_ in shapes:
            ring = np.array(shape)
            # walking the outline in small steps
            walk = np.concatenate([np.linspace(a, b, 2_000) for a, b in zip(ring, np.roll(ring, -1, 0), strict=True)])
            far = 0.0 if kernels.in_polygon(p, ring)[0] else float(np.hypot(*(walk - p).T).min())
            own[kind] = min(own.get(kind, np.inf), far)
        for name, among in (("lane", kinds[:2]), ("road", [*kinds[:3], "drivable_area"]), ("intersection", ["intersection"]), ("crosswalk", ["crosswalk"]), ("carpark", ["carpark"])):
            want = min(own.get(k, np.inf) for k in among)
            value = got[r[3]][f"{name}_distance"]
            assert value is None and want > 11.99 or value == pytest.approx(want, abs=0.02)


def test_still_tracks(spark):
    rows = [row(f, "stands", 1, 0.05 * f, 0, 0.1) for f in range(6)] + [row(f, "brief", 2, 9, 0) for f in range(3)] + [row(f, "creeps", 3, 20 + 0.3 * f, 0, 0.4) for f in range(6)]
    rows += [row(f, "walker", 4, 40, 0, kind="PEDESTRIAN") for f in range(6)] + [row(f, "noisy", 5, 60, 0, 3.0 if f == 2 else 0.0) for f in range(6)]
    got = {r.track_token for r in areas.still_tracks(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {"stands", "noisy"}


def test_users_without_area_have_no_row(spark, scenarios):
    df = spark.createDataFrame(met(), COLUMNS)
    assert areas.gates(df, scenarios, spark.createDataFrame([], MAP_SCHEMA)).count() == 0
    far = areas.area_distances(df, scenarios, spark.createDataFrame([box("carpark", "P", 900, 0, 910, 9)], MAP_SCHEMA))
    assert far.count() == 10 and far.where(F.coalesce(*areas.DISTANCES).isNotNull()).count() == 0

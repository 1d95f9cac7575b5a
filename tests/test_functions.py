"""Scalar labels and planar kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph import catalog
from waygraph.functions import angles, classifiers, kernels
from waygraph.operators.risk import least_clearance


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return row.asDict()


def test_angles(spark):
    got = one(spark, a=angles.wrap(F.lit(3 * math.pi / 2)), b=angles.difference(F.lit(3.1), F.lit(-3.1)), c=angles.mean_of_two(F.lit(3.1), F.lit(-3.1)), d=angles.finite(F.lit(float("inf"))))
    assert got["a"] == pytest.approx(-math.pi / 2)
    assert got["b"] == pytest.approx(2 * math.pi - 6.2)
    assert abs(got["c"]) == pytest.approx(math.pi)
    assert got["d"] is None


@pytest.mark.parametrize(
    ("ahead", "left", "want"),
    [(10, 0, "inFrontOf"), (-10, 0, "behind"), (1, 3, "leftOf"), (0, -3, "rightOf"), (10, 8, "frontLeftOf"), (10, -8, "frontRightOf"), (-10, 8, "rearLeftOf"), (-10, -8, "rearRightOf"), (0.5, 0.5, None), (0, 0, None), (1.5, 0.1, "inFrontOf")],
)
def test_sectors(spark, ahead, left, want):
    assert one(spark, s=classifiers.sector(F.lit(float(ahead)), F.lit(float(left)), F.lit(False)))["s"] == want
    assert one(spark, s=classifiers.sector(F.lit(float(ahead)), F.lit(float(left)), F.lit(True)))["s"] is None


def test_states(spark):
    speed = lambda v, kind="VEHICLE": classifiers.speed_state(F.lit(float(v)), F.lit(kind))
    got = one(spark, a=speed(0.3), b=speed(0.5), c=speed(0.81), d=speed(5, "TRAFFIC_CONE"), e=classifiers.acceleration_state(F.lit(0.3)), f=classifiers.acceleration_state(F.lit(-0.31)), g=classifiers.acceleration_state(F.lit(0.1)))
    assert list(got.values()) == ["isStopped", "isSlow", "isMoving", None, "isAccelerating", "isDecelerating", None]
    contact = lambda d, area=0.0, touch=False: classifiers.contact(F.lit(float(d)), F.lit(float(area)), F.lit(touch))
    got = one(spark, a=contact(0, 1), b=contact(0.0005), c=contact(2), d=contact(5), e=contact(5.1), f=contact(1, 0, True))
    assert list(got.values()) == ["overlapping", "touching", "veryNear", "near", None, "touching"]
    got = one(spark, a=classifiers.heading_state(F.lit(0.3)), b=classifiers.heading_state(F.lit(3.0)), c=classifiers.heading_state(F.lit(1.0)), d=classifiers.parse_boolean(F.lit(" Yes ")), e=classifiers.parse_boolean(F.lit("off")), f=classifiers.parse_boolean(F.lit("?")))
    assert list(got.values()) == ["alignedWith", "oppositeDirectionTo", None, True, False, None]


def box(x, y, h, length, width):
    return kernels.boxes(*(np.array([float(v)]) for v in (x, y, math.cos(h), math.sin(h), length, width)))


def test_boxes():
    a, b = box(0, 0, 0, 4, 2), box(6, 0, 0, 4, 2)
    assert kernels.convex_distance(a, b)[0] == pytest.approx(2)
    assert kernels.convex_overlap(a, b)[0] == 0
    assert kernels.convex_overlap(a, box(1, 0, 0, 4, 2))[0] == pytest.approx(6)
    assert kernels.convex_overlap(a, a)[0] == pytest.approx(8)
    assert kernels.convex_overlap(box(0, 0, 0, 2, 2), box(0, 0, math.pi / 4, 2, 2))[0] == pytest.approx(8 * (math.sqrt(2) - 1))
    assert kernels.convex_distance(a, box(3, 3, math.pi / 4, 2, 2))[0] == pytest.approx(np.hypot(1, 2) - 1, abs=0.3)
    assert kernels.convex_distance(box(0, 0, 0, 4, 4), box(0, 0, 0.3, 1, 1))[0] == 0


def test_polygons():
    hollow = np.array([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)], float)
    points = np.array([(1, 5), (3, 5), (3, 1), (6, 3), (7, 7)], float)
    assert kernels.in_polygon(points, hollow).tolist() == [True, False, True, True, False]
    assert kernels.polygon_overlap(box(3, 3, 0, 6, 6), hollow)[0] == pytest.approx(28)
    along, left, heading = kernels.project(np.array([(5.0, 1.0), (10.0, 5.0)]), np.array([(0, 0), (10, 0), (10, 10)], float))
    assert along.tolist() == [5, 15] and left.tolist() == [1, 0] and heading[1] == pytest.approx(math.pi / 2)


def test_least_clearance_against_a_fine_grid():
    rng = np.random.default_rng(4)
    n = 40
    shape = lambda: kernels.boxes(rng.uniform(-15, 15, n), rng.uniform(-15, 15, n), *(lambda h: (np.cos(h), np.sin(h)))(rng.uniform(0, 6, n)), np.full(n, 4.0), np.full(n, 2.0))
    a, b, dv = shape(), shape(), rng.uniform(-8, 8, (n, 2))
    time, value = least_clearance(a, b, dv, rng.uniform(0, 2, n), 2.0)
    grid = np.stack([kernels.convex_distance(a, b + dv[:, None] * t) for t in np.linspace(0, 2, 400)])
    assert (value <= grid.min(0) + 1e-3).all() and ((time >= 0) & (time <= 2)).all()


def test_catalogue(spark):
    rows = catalog.rows()
    assert len(rows) == len({r[0] for r in rows}) == 156
    assert catalog.definitions(spark).where("status = 'catalog_only'").count() == 5

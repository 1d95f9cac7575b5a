"""Counts work on the rows that facts are read from: none is stated for them, and few pairs go to a kernel; results are those of the facts."""

import numpy as np
from pyspark.sql import functions as F

from waygraph import queries
from waygraph.functions import kernels
from waygraph.operators import future, pairs
from waygraph.plans import shared


def test_counts_equal_the_facts_and_state_none(spark, sf, monkeypatch):
    stages = queries.Stages(spark, sf)
    passed = [f for of in queries.PASSES for f in of]
    assert len(passed) == len(set(passed)) and set(passed) <= set(queries.FAMILIES)
    facts = queries.assertions_of(queries.Stages(spark, sf), tuple(queries.FAMILIES)).groupBy("predicate").count()
    want = {r.predicate: r["count"] for r in facts.collect()}
    # a family of a pass that is stated after all is an error
    none = {f: (lambda s: 1 / 0) if f in passed else build for f, build in queries.FAMILIES.items()}
    monkeypatch.setattr(queries, "FAMILIES", none)
    got = queries.tally_of(stages, tuple(none))
    assert got.columns == ["predicate", "n"] and dict(got.dtypes)["n"] == "bigint"
    assert {r.predicate: r.n for r in got.collect()} == want
    assert not {"scored", "footprints", "futures"} & set(vars(stages))
    assert spark.conf.get(shared.METHOD_LIMIT, None) in (None, "65535")


def test_some_families_alone_are_counted(spark, sf):
    got = {r.predicate: r.n for r in queries.tally_of(queries.Stages(spark, sf), ("velocity", "traffic_light")).collect()}
    assert set(got) == {"hasVelocity", "controls", "hasSignalState"}


def test_footprints_within_a_reach_are_exact_there_and_bounds_beyond(spark):
    rng = np.random.default_rng(5)
    rows = [("s", f, 0, f"t{i}", i, i == 0, "VEHICLE", float(x), float(y), 0.0, float(np.cos(h)), float(np.sin(h)), 0.0, 0.0, None if i == 5 else float("nan") if i == 6 else float(w), 2.0) for f in range(4) for i, (x, y, h, w) in enumerate(zip(*rng.uniform(-25, 25, (2, 24)), rng.uniform(-3, 3, 24), rng.uniform(0.5, 9, 24), strict=True))]
    kinds = "scenario_token string, frame_index int, timestamp_us bigint, track_token string, slot int, is_ego boolean, agent_type string, x double, y double, heading double, cos_h double, sin_h double, vx double, vy double, length_m double, width_m double"
    both = pairs.with_kinematics(pairs.all_pairs(spark.createDataFrame(rows, kinds)))
    asked = ("free_space", "overlap_area", "longitudinal_gap", "lateral_gap", "overlapping", "touching")
    read = lambda df: {(r.frame_index, r.s_track, r.o_track): tuple(r[c] for c in asked) for r in df.select("frame_index", "s_track", "o_track", *asked).collect()}
    whole, within = read(pairs.with_footprints(both)), read(pairs.with_footprints_within(both, 6.0))
    assert whole.keys() == within.keys() and len(whole) == 4 * 24 * 23
    bounds = 0
    for key, (free, *others) in whole.items():
        mine = within[key]
        assert repr(mine[1:]) == repr(tuple(others)) and (free is None) == (mine[0] is None)
        if free is not None and mine[0] != free:
            assert 6.0 < mine[0] <= free
            bounds += 1
    assert bounds > 100 and any(free is not None and free <= 6.0 for free, *_ in whole.values())


def test_meeting_shapes_are_those_of_no_distance():
    rng = np.random.default_rng(6)
    box = lambda n: kernels.boxes(*rng.uniform(-12, 12, (2, n)), *(f(h) for h in [rng.uniform(-3, 3, n)] for f in (np.cos, np.sin)), *rng.uniform(0.5, 9, (2, n)))
    a, b = box(3000), box(3000)
    far = kernels.convex_distance(a, b)
    assert (kernels.convex_meet(a, b) == (far <= 0)).all() and 100 < (far <= 0).sum() < 2900
    # the sums of two that stood here before, bit by bit
    p, s, e = a[:, :, None], b[:, None], np.roll(b, -1, 1)[:, None]
    d = e - s
    t = np.clip(((p - s) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-18), 0, 1)[..., None]
    assert (kernels.points_to_segments(p, s, e) == np.sqrt(((p - s - t * d) ** 2).sum(-1))).all()


def test_future_samples_equal_plain_brackets(spark):
    t, rng, rows = future.T, np.random.default_rng(8), []
    gap, step, wanted = int(t.sample_interval_s * t.maximum_gap_factor * 1e6), int(t.future_step_s * 1e6), int(t.future_horizon_s / t.future_step_s)
    for track in range(12):
        at = np.cumsum(rng.choice([250_000, 499_999, 500_000, 500_001, 750_000, 750_001, 1_500_000], 30))
        rows += [("s", i, int(v), f"t{track}") for i, v in enumerate(at)]
    df = spark.createDataFrame(rows, "scenario_token string, frame_index int, timestamp_us bigint, track_token string")
    got = {(r.track_token, r.frame_index): r.samples for r in future.future_coverage(df).collect()}
    for _, i, now, track in rows:
        times = [r[2] for r in rows if r[3] == track and r[2] >= now]
        n = 0
        for x in range(now + step, now + wanted * step + 1, step):
            before, after = [v for v in times if v <= x], [v for v in times if v >= x]
            n += bool(after) and after[0] - before[-1] <= gap
        assert got[track, i] == n
    assert len(set(got.values())) > 5
    # positions are stated at those times and no others
    users = df.select("*", *(F.lit(0.0).alias(c) for c in ("x", "y", "heading")))
    assert future.future_positions(users).count() == sum(got.values())


def test_judged_pairs_are_written_by_compiled_methods(spark, sf, monkeypatch):
    stages, seen = queries.Stages(spark, sf), []

    class Judged:
        def select(self, *columns):
            return self

    stages.__dict__["judged"] = Judged()
    monkeypatch.setattr(queries, "cut", lambda df: seen.append(spark.conf.get(shared.METHOD_LIMIT, None)))
    before = spark.conf.get(shared.METHOD_LIMIT, None)
    stages.scored  # noqa: B018
    assert seen == ["8000"] and spark.conf.get(shared.METHOD_LIMIT, None) == before

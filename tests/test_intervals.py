"""Intervals at frames and with each other, present times, evidence, speeds as seen, overtaking on the axis of both headings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scenes import COLUMNS, row

from waygraph.operators import assertions, entities, intervals, pairs

EVENTS = "scenario_token string, predicate string, s_track string, o_track string, start_us long, end_us long"


def some_events(n=120, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        start = int(rng.integers(0, 120_000)) * 500
        out.append((f"s{i % 2}", f"p{i % 4}", f"t{i % 3}", f"o{i % 7}", start, start + int(rng.choice([0, 500_000, 9_000_000, 40_000_000]))))
    return out


def test_at_frames_is_between(spark):
    frames = [(f"s{s}", f, f * 500_000) for s in range(2) for f in range(130)]
    events = some_events()
    got = intervals.at_frames(spark.createDataFrame(events, EVENTS), spark.createDataFrame(frames, "scenario_token string, frame_index int, timestamp_us long"))
    want = sorted((e[0], e[1], e[2], e[3], e[4], f[1]) for e in events for f in frames if e[0] == f[0] and e[4] <= f[2] <= e[5])
    assert sorted((r.scenario_token, r.predicate, r.s_track, r.o_track, r.start_us, r.frame_index) for r in got.collect()) == want


def test_together_is_each_with_each(spark):
    events = sorted(set(some_events()))
    got = sorted((r.scenario_token, r.s_track, r["first"], r["second"], r.from_us, r.to_us) for r in intervals.together(spark.createDataFrame(events, EVENTS)).collect())
    want = sorted(
        (a[0], a[2], f"{a[1]} {a[3]}", f"{b[1]} {b[3]}", max(a[4], b[4]), min(a[5], b[5]))
        for a in events for b in events
        if a[0] == b[0] and a[2] == b[2] and (a[1], a[3], a[4]) < (b[1], b[3], b[4]) and a[4] <= b[5] and b[4] <= a[5]
    )
    assert got == want


def test_edges_are_stated_once(spark):
    frames = spark.createDataFrame([("s0", f, f * 500_000) for f in range(6)], "scenario_token string, frame_index int, timestamp_us long")
    events = spark.createDataFrame([("s0", "overtakes", "a", "b", 500_000, 2_000_000), ("s0", "overtakes", "a", "b", 1_500_000, 2_000_000)], EVENTS)
    stated = spark.createDataFrame([("s0", 2, "overtakes", "a", "b"), ("s0", 3, "overtakes", "b", "a")], "scenario_token string, frame_index int, predicate string, s_track string, o_track string")
    assert sorted(r.frame_index for r in intervals.edges_at_frames(events, stated, frames).collect()) == [1, 3, 4]


def test_current_time_by_what_is_there(spark):
    pair = f"pair:s:0:700:agent_to_agent_reverse:{'0a' * 12}"
    rows = [
        ("agent:s:a:300", "agent:s:b:300", 100, 900, 800, '{"current_time_us": 5}', 900),
        ("agent:s:a:300", "agent:s:b:300", 100, None, 800, '{"current_time_us": 5}', 800),
        ("agent:s:a:300", "agent:s:b:300", 100, None, None, '{"current_time_us": 5, "current_timestamp_us": 6}', 6),
        ("agent:s:a:300", "agent:s:b:300", 100, None, None, '{"current_time_us": 5}', 5),
        ("agent:s:a:300", "agent:s:b:300", 100, None, None, '{"current_entity_id": "ego:s:77"}', 77),
        ("agent:s:a:300", "agent:s:b:300", 100, None, None, f'{{"current_pair_id": "{pair}"}}', 700),
        (pair, "agent:s:b:300", 100, None, None, None, 700),
        ("agent:s:a:300", "agent:s:b:400", 100, None, None, "{}", 400),
        ("agent:s:a:300", "lane:17", 100, None, None, "not json", 300),
        ("scenario:x", None, 100, None, None, None, 100),
    ]
    df = spark.createDataFrame(rows, "subject_id string, object_id string, start_us long, end_us long, provenance_us long, evidence string, want long")
    assert intervals.current_time(df).where(~F.col("current_us").eqNullSafe(F.col("want"))).collect() == []


def test_evidence_table(spark):
    facts = spark.createDataFrame([("s", 500, "follows", "a", "ego", 100, 7.5, 2.0), ("s", 500, "queuesBehind", "b:c", "a", 100, None, 2.0)], "scenario_token string, timestamp_us long, predicate string, s_track string, o_track string, start_us long, gap double, duration_s double")
    asserted = assertions.stated(facts, assertions.entity("s_track"), assertions.entity("o_track"), start=F.col("start_us"), evidence=("gap", "duration_s"))
    got = {r.predicate: (r.current_us, r.s_track, r.o_track, r.start_us, r.gap, r.duration_s) for r in intervals.evidence_table(asserted, ("follows", "queuesBehind")).collect()}
    assert got["follows"] == (500, "a", "ego", 100, 7.5, 2.0) and got["queuesBehind"][4:] == (None, 2.0)
    with pytest.raises(ValueError, match="one kind"):
        intervals.evidence_table(asserted, ("follows", "crossesInFrontOf"))


def turned(r, heading):
    r = list(r)
    r[9], r[10], r[11] = heading, math.cos(heading), math.sin(heading)
    return tuple(r)


def test_forward_speed_as_seen(spark):
    rows = [turned(row(f, "a", 1, 3.0 * f * math.cos(0.4), 3.0 * f * math.sin(0.4)), 0.4 + (0.2 if f % 2 else -0.2)) for f in range(4)] + [row(0, "lone", 2, 0, 0)]
    got = {(r.track_token, r.frame_index): r.forward_speed_seen for r in entities.with_forward_speed(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(got["a", f] == pytest.approx(6.0) for f in range(4)) and got["lone", 0] is None


@pytest.mark.parametrize("a, b", [(0.0, 0.0), (0.3, -0.3), (3.0, -3.0), (1.2, 0.7)])
def test_pair_axis_is_projected_corners(spark, a, b):
    rows = [turned(row(0, "s", 1, 4, 2, size=(5.0, 2.0)), a), turned(row(0, "o", 2, -3, 1, size=(4.0, 1.8)), b)]
    r = pairs.with_pair_axis(pairs.with_kinematics(pairs.agent_pairs(spark.createDataFrame(rows, COLUMNS)))).where("s_track = 's'").first()
    axis = math.atan2(math.sin(a) + math.sin(b), math.cos(a) + math.cos(b))

    def along(x, y, heading, length, width):
        corners = [(x + math.cos(heading) * i * length / 2 - math.sin(heading) * j * width / 2, y + math.sin(heading) * i * length / 2 + math.cos(heading) * j * width / 2) for i in (1, -1) for j in (1, -1)]
        own = [math.cos(axis) * p + math.sin(axis) * q for p, q in corners]
        return min(own), max(own)

    s, o = along(4, 2, a, 5, 2), along(-3, 1, b, 4, 1.8)
    assert (r.behind_gap, r.clearance) == (pytest.approx(o[0] - s[1]), pytest.approx(s[0] - o[1]))
    assert r.level == (min(s[1], o[1]) - max(s[0], o[0]) >= -0.001)
    assert r.axis_ahead == pytest.approx(math.cos(axis) * 7 + math.sin(axis) * 1) and r.axis_aside == pytest.approx(math.cos(axis) * 1 - math.sin(axis) * 7)

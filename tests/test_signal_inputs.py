"""Signals reach relevance and yields."""

import pytest
from pyspark.sql import functions as F

from waygraph import queries
from waygraph.operators import crossing, relevance, traffic

SF = "/root/testdata/sf0.001"


def test_shared_control_is_joined(spark):
    stages = queries.Stages(spark, SF)
    found = {(r.scenario_token, r.frame_index, r.connector_id) for r in stages.signals.collect()}
    ways = {(r.scenario_token, r.frame_index, r.track_token): {r.primary_id, *r.outgoing} for r in stages.matched.collect()}
    lit = {}
    for s, f, c in found:
        lit.setdefault((s, f), set()).add(c)
    rows = stages.scored.select("scenario_token", "frame_index", "s_track", "o_track", "shared_control", "center_distance", "reasons").collect()
    for r in rows:
        want = bool(lit.get((r.scenario_token, r.frame_index), set()) & ways[r.scenario_token, r.frame_index, r.s_track] & ways[r.scenario_token, r.frame_index, r.o_track])
        assert r.shared_control == want
        assert ("shared_traffic_control" in r.reasons) == (want and r.center_distance <= relevance.R.traffic_control)
    assert any("shared_traffic_control" in r.reasons for r in rows)


@pytest.mark.parametrize("states", [("RED",), ("GREEN",), ("RED", "RED"), ()])
def test_red_frames(spark, states):
    matched = spark.createDataFrame([("s", 0, 0, "a", "lane", ["C0", "C1"]), ("s", 0, 0, "b", "lane_connector", ["C0", "C1"])], "scenario_token string, frame_index int, timestamp_us long, track_token string, primary_kind string, outgoing array<string>")
    found = spark.createDataFrame([("s", 0, 0, f"C{i}", state) for i, state in enumerate(states)], "scenario_token string, frame_index int, timestamp_us long, connector_id string, state string")
    assert [r.track_token for r in traffic.red_frames(matched, found).collect()] == (["a"] if states == ("RED",) else [])


def test_yields_query_hands_red_frames_over(spark, monkeypatch):
    given = []
    monkeypatch.setattr(crossing, "yields", lambda found, entities, red=None: given.append(red) or red)
    queries.QUERIES["way_yields"](spark, SF)
    assert given[0] is not None and given[0].where(F.col("track_token").isNotNull()).count() > 0


def test_nearest_snapshot(spark):
    from waygraph.operators import query

    rows = spark.createDataFrame([("s", 0), ("s", 10), ("s", 30)], "scenario_token string, timestamp_us long")
    asked = spark.createDataFrame([("s", -5), ("s", 5), ("s", 10), ("s", 21), ("s", 99), ("none", 1)], "scenario_token string, at_us long")
    assert {(r.scenario_token, r.at_us): r.timestamp_us for r in query.nearest_snapshot(rows, asked).collect()} == {("s", -5): 0, ("s", 5): 0, ("s", 10): 10, ("s", 21): 30, ("s", 99): 30}

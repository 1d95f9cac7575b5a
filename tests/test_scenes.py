"""Families over small scenes made by hand, and queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from waygraph import catalog, queries
from waygraph.operators import crossing, entities, future, maneuvers, pairs, query, relevance, spatial
from waygraph.plans.scene import MAP_SCHEMA
from waygraph.sources import tables

SF = "/root/testdata/sf0.001"
COLUMNS = "scenario_token string, frame_index int, timestamp_us long, track_token string, slot int, is_ego boolean, agent_type string, x double, y double, heading double, cos_h double, sin_h double, vx double, vy double, length_m double, width_m double, height_m double, ax double, ay double"


def row(frame, track, slot, x, y, vx=0.0, vy=0.0, north=False, kind="VEHICLE", us=None, size=(4.0, 2.0)):
    return ("s", frame, frame * 500_000 if us is None else us, track, slot, track == "ego", "EGO" if track == "ego" else kind, float(x), float(y), 1.5707963267948966 if north else 0.0, 0.0 if north else 1.0, 1.0 if north else 0.0, float(vx), float(vy), size[0], size[1], 1.5, None, None)


def frames_of(df):
    return df.select("scenario_token", "frame_index", "timestamp_us").distinct()


def test_history_restarts_after_a_gap(spark):
    rows = [row(f, "a", 1, 2.0 * f, 0, 4.0 + f) for f in (0, 1, 2, 4, 5, 6, 7)]
    got = {r.frame_index: r for r in entities.with_history(entities.with_motion(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert [got[f].continuous_count for f in (0, 1, 2, 4, 5, 6, 7)] == [1, 2, 3, 1, 2, 3, 4]
    assert [got[f].total_count for f in (0, 4, 7)] == [1, 4, 7]
    assert got[4].displacement_m is None and got[1].displacement_m == 2.0
    assert got[2].acceleration_state is None and got[7].acceleration_state == "isAccelerating"
    assert got[1].estimated_acceleration == pytest.approx(2.0)


def test_ego_velocity_turns_into_the_global_frame(spark):
    rows = [row(0, "ego", 0, 0, 0, north=True)]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"body_vx": F.lit(3.0), "body_vy": F.lit(1.0), "omega": F.lit(0.5), "arm": F.lit(2.0)})
    got = entities.ego_velocity(df, omega="omega", rear_to_center="arm").first()
    assert (got.vx, got.vy) == (pytest.approx(-2.0), pytest.approx(3.0))


def test_pair_kinematics_and_footprints(spark):
    rows = [row(0, "ego", 0, 0, 0, 5), row(0, "a", 1, 10, 1, 3), row(0, "b", 2, 3, 0, 5)]
    df = pairs.with_footprints(pairs.with_kinematics(pairs.all_pairs(spark.createDataFrame(rows, COLUMNS))))
    got = {(r.s_track, r.o_track): r for r in df.collect()}
    assert len(got) == 6
    p = got["ego", "a"]
    assert p.closing_speed == pytest.approx(20 / 101**0.5) and p.free_space == pytest.approx(6) and p.longitudinal_gap == pytest.approx(6)
    assert got["ego", "b"].overlap_area == pytest.approx(2) and got["ego", "b"].overlapping
    assert got["b", "a"].tag == "agent_to_agent_reverse"


def test_grid_join_finds_what_a_full_join_finds(spark):
    rows = [row(0, f"t{i}", i, (i * 37) % 300, (i * 53) % 200) for i in range(60)]
    df = spark.createDataFrame(rows, COLUMNS)
    near = {(r.s_track, r.o_track) for r in pairs.near_agent_pairs(df, 60.0).collect()}
    full = {(r.s_track, r.o_track) for r in pairs.with_kinematics(pairs.agent_pairs(df)).where("s_slot < o_slot and center_distance <= 60").collect()}
    assert near == full


def test_ray_crossing_and_yield(spark):
    rows = []
    for f in range(24):
        t = f / 2
        v = 6.0 if f < 6 else 2.0 if f < 16 else 5.0
        x = 3.0 * f if f < 6 else 18.0 + (f - 6) if f < 16 else 28.0 + 2.5 * (f - 16)
        rows.append(row(f, "car", 1, x, 0, v))
        rows.append(row(f, "bike", 2, 27.0, -12.0 + 3.0 * t, 0, 3.0, north=True, kind="BICYCLE", size=(1.8, 0.8)))
    df = spark.createDataFrame(rows, COLUMNS)
    found = crossing.crossings(crossing.meetings(pairs.with_kinematics(pairs.all_pairs(df)), crossing.track_pairs(df)), frames_of(df))
    assert {(r.s_track, r.o_track) for r in found.collect()} == {("bike", "car")}
    assert all(abs(r.conflict_x - 27) < 1e-6 and abs(r.conflict_y) < 1e-6 for r in found.collect())
    got = crossing.yields(found, df).collect()
    assert got and {(r.s_track, r.o_track) for r in got} == {("car", "bike")}
    assert all(r.reaction_us <= r.clear_us < r.proceed_us for r in got)


def test_decoder():
    import numpy as np

    emission = np.array([[0, 3], [0, 3], [2, 1], [3, 0], [3, 0]], float)
    change = np.tile(np.array([[0.05, 1.0], [1.0, 0.05]]), (5, 1, 1))
    assert maneuvers.decode(emission, change).tolist() == [0, 0, 1, 1, 1]
    assert maneuvers.smooth(["a", "?", "a", "b", "a", "?", "b", "b"]) == ["a", "a", "a", "a", "a", "?", "b", "b"]


@pytest.fixture(scope="module")
def stages(spark):
    return queries.Stages(spark, SF)


def test_lane_changes_merges_and_overtakes(stages):
    changes = {(r.track_token, r.source_lane, r.target_lane, r.side) for r in stages.lane_changes.where("scenario_token = 'sc0'").collect()}
    assert {("t2", "A1", "A2", "left"), ("t2", "A2", "A1", "right"), ("t3", "A0", "A1", "left")} <= changes
    merged = queries.BUILD["merges"](stages).where("scenario_token = 'sc0'").collect()
    assert ("t3", "ego") in {(r.track_token, r.o_track) for r in merged}
    over = queries.BUILD["overtakes"](stages).where("scenario_token = 'sc0'").collect()
    assert {(r.s_track, r.o_track) for r in over} == {("t2", "ego")}
    assert all(r.start_frame < r.departure_frame <= r.side_frame <= r.reversal_frame <= r.clearance_frame <= r.return_frame < r.completion_frame for r in over)


def test_following_and_topology(stages):
    follows = {(r.s_track, r.o_track) for r in queries.BUILD["follow_facts"](stages).where("predicate = 'follows'").collect()}
    assert ("ego", "t1") in follows and ("t1", "ego") not in follows
    kinds = {r.map_relation for r in stages.topology.select("map_relation").distinct().collect()}
    assert {"same_map", "adjacent_left", "adjacent_right", "successor", "predecessor", "unrelated"} <= kinds


def test_directions_need_relevance(stages):
    facts = {r.predicate for r in spatial.spatial_facts(stages.scored).select("predicate").distinct().collect()}
    assert {"inFrontOf", "behind", "alignedWith"} <= facts
    chosen = relevance.select_for_ego(stages.scored)
    assert chosen.groupBy(*pairs.FRAME).count().agg(F.max("count")).first()[0] <= 14
    assert relevance.audit(stages.scored, chosen).where("selected").count() == chosen.count()


def test_future_coverage(spark):
    rows = [row(f, "a", 1, f, 0) for f in range(14)]
    got = {r.frame_index: r for r in future.future_coverage(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[0].samples == 12 and not got[0].insufficient and got[13].samples == 0 and got[13].insufficient


def test_sinks_round_trip(spark, stages, tmp_path):
    assert stages.scene.scenarios.count() > 1
    facts = queries.assertions_of(stages, ("structure", "pose", "precedes", "map_membership")).cache()
    assert facts.select("assertion_id").distinct().count() == facts.count()
    for kind in ("parquet", "json", "csv"):
        tables.write_facts(facts, str(tmp_path / kind), kind)
    assert tables.read_facts(spark, str(tmp_path / "parquet")).count() == facts.count()
    assert spark.read.json(str(tmp_path / "json")).count() == facts.count()
    tables.write_facts(query.triples(facts), str(tmp_path / "nt"), "ntriples")
    lines = spark.read.text(str(tmp_path / "nt"))
    assert lines.count() == 6 * facts.count() and lines.where("not value rlike '^<[^ <>]+> <[^ <>]+> (<[^ <>]+>|\"[^\"]*\"(\\\\^\\\\^<[^ <>]+>)?) [.]$'").count() == 0
    assert tables.inventory(spark, str(tmp_path / "parquet")).agg(F.sum("n")).first()[0] == facts.count()


def test_assertions_hold_in_time_and_have_evidence(spark, stages):
    from waygraph.operators import assertions

    facts = queries.assertions_of(stages, ("following", "overtake", "pairwise")).cache()
    over = facts.where("predicate = 'overtakes'").first()
    assert over.start_us < over.end_us and "passing_side" in over.evidence
    middle = (over.start_us + over.end_us) // 2
    assert over.assertion_id in {r.assertion_id for r in assertions.holding_at(facts, over.scenario_token, middle).collect()}
    assert over.assertion_id not in {r.assertion_id for r in assertions.holding_at(facts, over.scenario_token, over.end_us + 1).collect()}
    assert assertions.deduplicated(facts.union(facts)).count() == facts.select("assertion_id").distinct().count()
    members = spark.createDataFrame([("p", "x", "y")], "pair_id string, s_id string, o_id string")
    rows = spark.createDataFrame([("p", 1), ("q", 2)], "subject_id string, n int")
    assert {(r.n, r.member_subject) for r in assertions.with_pairs(rows, members).collect()} == {(1, "x"), (2, None)}


def test_two_maps_of_equal_ids_stay_apart(spark, stages):
    from waygraph.operators import mapmatch

    s = stages.scene
    second = lambda df: df.unionByName(df.withColumn("map_name", F.lit("m1")))
    got = mapmatch.with_map(stages.history, stages.primary, s.scenarios, second(s.map_objects), second(s.map_edges), second(s.map_adjacency), s.route)
    assert got.count() == stages.history.count()
    assert maneuvers.maneuver_facts(stages.matched, s.scenarios, second(s.map_adjacency)).count() == maneuvers.maneuver_facts(stages.matched, s.scenarios, s.map_adjacency).count()


def test_chains_keep_branches_apart():
    same = lambda up: {frozenset(k for k in up if up[k] == v) for v in set(up.values())}
    assert same(maneuvers.chains({"A": "C", "C": "B", "B": None})) == {frozenset("ACB")}
    assert same(maneuvers.chains({"A2": None, "C2": "B2", "B2": None, "C2R": None})) == {frozenset({"A2"}), frozenset({"C2", "B2"}), frozenset({"C2R"})}
    assert same(maneuvers.chains({"A": "X", "B": "A"})) == {frozenset("AB")}


def test_lane_change_between_parallel_connectors(spark):
    """Two ways out of one lane, without a stated neighbour: geometry tells the side."""
    frames = list(range(12))
    y = [0, 0, 0, 0, 1, 2, 3, 4, 4, 4, 4, 4]
    own = spark.createDataFrame([row(f, "a", 1, 10.0 + 3 * f, y[f], 6.0) for f in frames], COLUMNS)
    found, chosen = [], []
    for f in frames:
        for name, at in (("P", 0.0), ("Q", 4.0)):
            share = max(0.0, min(1.0, (min(y[f] + 1, at + 2) - max(y[f] - 1, at - 2)) / 2))
            if share > 0:
                found.append(("s", f, f * 500_000, "a", name, "lane_connector", abs(y[f] - at) <= 2, 8 * share, share, 10.0 + 3 * f, y[f] - at, 0.0, 0.0))
        chosen.append(("s", f, "a", "P" if y[f] < 2 else "Q", False))
    found = spark.createDataFrame(found, "scenario_token string, frame_index int, timestamp_us long, track_token string, object_id string, kind string, center_covered boolean, overlap_area double, overlap_ratio double, progress double, lateral_offset double, map_heading double, curvature double")
    chosen = spark.createDataFrame(chosen, "scenario_token string, frame_index int, track_token string, primary_id string, ambiguous boolean")
    scenarios = spark.createDataFrame([("s", "m")], "scenario_token string, map_name string")
    edges = spark.createDataFrame([("m", "L", "P"), ("m", "L", "Q")], "map_name string, src_id string, dst_id string")
    beside = spark.createDataFrame([], "map_name string, object_id string, side string, adjacent_id string")
    moved = entities.with_motion(own)
    shapes = [("m", "lane_connector", n, [(0.0, y - 2), (60.0, y - 2), (60.0, y + 2), (0.0, y + 2)], [(0.0, y), (60.0, y)], 60.0, None, None, None) for n, y in (("P", 0.0), ("Q", 4.0))]
    for known in (shapes, []):  # of lanes that the map lacks nothing is known but the matches
        got = maneuvers.lane_changes(moved, found, chosen, scenarios, edges, beside, spark.createDataFrame(known, MAP_SCHEMA)).collect()
        assert [(r.source_lane, r.target_lane, r.side) for r in got] == [("P", "Q", "left")]
        assert [r.onset_by for r in got] == ["lateral_speed" if known else "source_end"]
    reach = {(r.src, r.dst) for r in maneuvers.reachable(spark.createDataFrame([("m", f"n{i}", f"n{i + 1}") for i in range(8)], "map_name string, src_id string, dst_id string"), 5).collect()}
    assert ("n0", "n5") in reach and ("n0", "n6") not in reach


def test_streamed_motion_equals_batch(spark, stages, tmp_path):
    from waygraph.streaming import causal

    stages.scene.entities.write.parquet(str(tmp_path / "in"))
    stream = causal.stream_motion(spark.readStream.schema(stages.scene.entities.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("streamed").exceptAll(entities.motion_facts(stages.moving)).count() == 0
    assert spark.table("streamed").count() == entities.motion_facts(stages.moving).count()


@pytest.mark.parametrize("name", ["way_closing_speed_of_ego_pairs", "way_temporal_facts", "way_motion_states", "way_pair_footprints", "way_map_memberships", "way_signal_facts", "way_pair_edges"])
def test_queries_equal_their_sql(spark, name):
    base = duckdb.connect()
    base.execute(f"create view events as select * from '{SF}/events.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = base.execute(queries.SQL[name]).df()[list(got.columns)]
    text = lambda df: sorted(map(str, df.replace({-0.0: 0.0}).itertuples(index=False, name=None)))
    assert text(got) == text(want)

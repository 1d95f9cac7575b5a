"""What keeps the scene's queries in proportion to their input: narrow groups, few copies, counts before names."""

import numpy as np
from pyspark.sql import functions as F

from waygraph.functions import kernels
from waygraph.operators import future, mapmatch, maneuvers, pairs, relevance, risk
from waygraph.operators.entities import unpivot
from waygraph.queries import QUERIES, Stages


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lane_changes_take_no_pandas_group_a_track(spark, sf):
    made = plan(Stages(spark, sf).lane_changes)
    assert "CoGroupsInArrow" in made and "CoGroupsInPandas" not in made


def test_agent_pairs_take_no_group_a_frame(spark):
    rows = [("s", f, f * 500000, "agent_to_agent", f"t{a}", f"t{b}", False, False, 10.0 * a + b + f, 5.0 * b, a == 0 and b == 1) for f in range(3) for a in range(9) for b in range(a + 1, 9)]
    df = spark.createDataFrame(rows, "scenario_token string, frame_index int, timestamp_us bigint, tag string, s_track string, o_track string, s_is_ego boolean, o_is_ego boolean, score double, free_space double, critical boolean")
    df = df.withColumns({"relevant": F.lit(True), "mandatory": F.lit(False), "center_distance": F.col("free_space")})
    got = relevance.select_agent_pairs(df)
    assert "FlatMapGroupsInPandas" not in plan(got)
    r, want = relevance.R, set()
    for f in range(3):
        seen, n = {}, 0
        for x in sorted((x for x in rows if x[1] == f), key=lambda x: (not x[10], -x[8], x[9], x[4], x[5])):
            a, b = x[4], x[5]
            if not x[10]:
                if seen.get(a, 0) >= r.most_neighbours or seen.get(b, 0) >= r.most_neighbours or n >= r.most_pairs:
                    continue
                n, seen[a], seen[b] = n + 1, seen.get(a, 0) + 1, seen.get(b, 0) + 1
            want.add((f, a, b))
    assert {(x.frame_index, x.s_track, x.o_track) for x in got.collect()} == want


def test_near_pairs_copy_a_row_to_few_cells_and_lose_none(spark):
    rng = np.random.default_rng(3)
    spots = [(f"t{i}", i, i == 0, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 300, (60, 2)))]
    df = spark.createDataFrame(spots, "track_token string, slot int, is_ego boolean, x double, y double")
    df = df.select(F.lit("s").alias("scenario_token"), F.lit(0).alias("frame_index"), F.lit(0).cast("bigint").alias("timestamp_us"), "*", F.lit("VEHICLE").alias("agent_type"), *(F.lit(0.0).alias(c) for c in ("heading", "sin_h", "vx", "vy")), *(F.lit(1.0).alias(c) for c in ("cos_h", "length_m", "width_m")))
    got = {(x.s_track, x.o_track) for x in pairs.near_pairs(df, 50.0).collect()}
    assert got == {(a[0], b[0]) for a in spots for b in spots if a != b and np.hypot(a[3] - b[3], a[4] - b[4]) <= 50.0}
    assert "array(struct" not in plan(pairs.near_pairs(df, 50.0))


def test_paths_whose_widened_bounds_are_apart_go_to_no_kernel(spark):
    kinds = "scenario_token string, frame_index int, timestamp_us bigint, track_token string, slot int, x double, y double, speed double, estimated_acceleration double, primary_id string, width double, us array<bigint>, xs array<double>, ys array<double>, ids array<string>"
    row = lambda name, slot, y: ("s", 0, 0, name, slot, 0.0, y, 5.0, 0.0, "A", 2.0, [0, 500000], [0.0, 9.0], [y, y], ["A", "A"])
    paths = spark.createDataFrame([row("a", 1, 0.0), row("b", 2, 1.5), row("c", 3, 30.0)], kinds)
    got = future.conflicts_of_paths(paths)
    assert [(x.s_track, x.o_track) for x in got.collect()] == [("a", "b")] and "s_y1" in plan(got)


def test_all_pairs_join_once_and_unpivot_stays_compiled(spark, sf):
    users = Stages(spark, sf).scene.entities.select(*pairs.FRAME, *pairs.SIDE)
    assert "Union" not in plan(pairs.all_pairs(users))
    both = pairs.ego_pairs(users).unionByName(pairs.agent_pairs(users))
    assert pairs.all_pairs(users).select(*pairs.PAIR).exceptAll(both.select(*pairs.PAIR)).isEmpty() and pairs.all_pairs(users).count() == both.count()
    made = unpivot(users, pairs.FRAME, {"x": F.col("x"), "none": F.lit(None).cast("double")})
    assert "lambda" not in plan(made) and made.select("predicate").distinct().collect() == [("x",)]


def test_counts_name_no_facts(spark, sf):
    assert "assertion_id" not in plan(QUERIES["way_frame_truth_counts"](spark, sf))


def test_shapes_with_bounds_apart_are_left_out_of_the_overlap():
    one = kernels.boxes(*(np.array(v, float) for v in ([0, 0], [0, 0], [1, 1], [0, 0], [4, 4], [2, 2])))
    two = kernels.boxes(*(np.array(v, float) for v in ([2, 50], [0, 0], [1, 1], [0, 0], [4, 4], [2, 2])))
    assert kernels.bounds_meet(one, two).tolist() == [True, False]
    assert kernels.convex_overlap(one, two).tolist() == [4.0, 0.0] and kernels.convex_distance(one, two).tolist() == [0.0, 46.0]
    assert maneuvers.Seen._fields[0] == "track_token"


def test_history_is_sorted_once(spark, sf):
    made = Stages(spark, sf).history._jdf.queryExecution().executedPlan().toString()
    assert made.split("== Initial Plan ==")[-1].count("Sort [") == 1


def test_footprints_off_a_polygons_bounds_go_to_no_kernel(spark, sf):
    s = Stages(spark, sf)
    found = mapmatch.candidates(s.scene.entities, s.scene.scenarios, s.scene.map_objects)
    assert "high_x" in plan(found)


def test_rules_of_relevance_are_decided_once(spark):
    numbers = "center_distance free_space reference_distance o_x s_x o_y s_y o_vx s_vx o_vy s_vy s_length_m s_width_m o_length_m o_width_m travel_longitudinal travel_lateral".split()
    df = spark.range(1).select(*((F.col("id") + i).cast("double").alias(c) for i, c in enumerate(numbers)), F.lit("same_map").alias("map_relation"), F.lit("VEHICLE").alias("o_agent_type"), *(F.lit(True).alias(c) for c in ("same_flow", "s_is_ego", "shared_intersection", "o_in_crosswalk")), *(F.lit(1).alias(c) for c in ("s_route_rank", "o_route_rank")))
    got = relevance.with_relevance(df)
    assert "held_same_lane_ahead" in got._jdf.queryExecution().analyzed().toJSON()
    row = got.first()
    assert row.reasons == sorted(row.reasons) and "same_lane_ahead" in row.reasons and row.relevant and row.mandatory
    assert relevance.PRIORITY[row.primary_reason] == max(relevance.PRIORITY[x] for x in row.reasons)


def test_overtakes_take_no_group_a_pair_and_equal_a_plain_scan(spark):
    t = maneuvers.T
    rng = np.random.default_rng(11)
    rows = []
    for p in range(60):
        at, speed = -rng.uniform(2, 30), rng.uniform(1.0, 4.0)
        for f in range(40):
            at += speed * 0.5 * (1 if rng.random() < 0.9 or p % 3 else -1)
            aside = abs(at) < 12
            rows.append((f"s{p % 2}", f"a{p}", "b", f, f * 500_000, bool(not aside and rng.random() < 0.95), "left" if aside and rng.random() < 0.8 else None, at, 3.0 if aside else 0.2, -at - 4.5, at - 4.5, abs(at) < 4.5, float(rng.choice([0.0, 0.9], p=[0.93, 0.07])), float(rng.uniform(1.5, 9)), float(rng.uniform(0.4, 4))))
    kinds = "scenario_token string, s_track string, o_track string, frame_index int, timestamp_us bigint, same boolean, passing_side string, axis_ahead double, axis_aside double, behind_gap double, clearance double, level boolean, heading_difference double, s_forward_speed_seen double, o_forward_speed_seen double"

    def plain(own):
        fit = lambda r: r[13] >= t.overtake_subject_speed and r[14] >= t.overtake_object_speed
        flow = [r[12] <= t.overtake_same_flow for r in own]
        first = lambda lo, ok: next((i for i in range(lo, len(own)) if ok(i)), None)
        at, found = 0, []
        while (start := first(at, lambda i: own[i][5] and own[i][9] >= t.overtake_behind_gap and fit(own[i]) and flow[i])) is not None:
            at = start + 1
            leave = first(at, lambda i: own[i][6] is not None)
            level = leave and first(leave, lambda i: own[i][6] is not None and own[i][11] and abs(own[i][8]) >= t.overtake_side_lateral and flow[i])
            turn = level and first(level, lambda i: own[i][7] > 0)
            clear = turn and first(turn, lambda i: own[i][10] >= t.overtake_clearance)
            back = clear and first(clear, lambda i: own[i][5])
            n = t.overtake_stable_frames
            done = back and first(back + n - 1, lambda i: all(r[5] for r in own[i - n + 1 : i + 1]))
            if not done:
                break
            if (own[done][4] - own[start][4]) / 1e6 <= t.overtake_duration_s and max(r[13] - r[14] for r in own[start : clear + 1]) >= t.overtake_relative_speed and np.mean(flow[start : clear + 1]) >= t.overtake_same_flow_share:
                found.append((start, leave, level, turn, clear, back, done))
                at = done + 1
        out = []
        for x in found:
            if out and own[x[-1]][4] - own[out[-1][-1]][4] <= t.overtake_dedupe_s * 1e6:
                out[-1] = max(out[-1], x, key=lambda x: (own[x[4]][10], own[x[0]][4] - own[x[-1]][4]))
            else:
                out.append(x)
        return out

    want = {(r[0][0], r[0][1], *x) for r in ([r for r in rows if r[1] == f"a{p}"] for p in range(60)) for x in plain(r)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        # lanes as the join asks for them: those of one way are equal, those beside it stated
        pairs_of = spark.createDataFrame(rows, kinds).withColumns({"o_primary_id": F.lit("L"), "s_primary_id": F.when(F.col("passing_side").isNotNull(), "M").when(F.col("same"), "L")}).drop("same", "passing_side")
        none = spark.createDataFrame([], "map_name string, src string, dst string")
        beside = spark.createDataFrame([("m", "L", "left", "M"), ("m", "M", "right", "L")], "map_name string, object_id string, side string, adjacent_id string")
        got = maneuvers.overtakes(pairs_of, none, spark.createDataFrame([("s0", "m"), ("s1", "m")], "scenario_token string, map_name string"), beside)
        assert "FlatMapGroupsInPandas" not in plan(got) and "CoalescedShuffle" not in plan(got)
        steps = ("start", "departure", "side", "reversal", "clearance", "return", "completion")
        assert {(x.scenario_token, x.s_track, *(x[f"{s}_frame"] for s in steps)) for x in got.collect()} == want and len(want) > 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dear_steps_are_dealt_to_a_fixed_number_of_tasks(spark, sf):
    users = Stages(spark, sf).scene.entities
    near = pairs.with_kinematics(pairs.ego_pairs(users)).withColumn("free_space", F.col("center_distance"))
    for made in (future.future_positions(users), future.future_coverage(users), pairs.with_pair_history(near)):
        assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_risks_are_judged_in_first_directions_and_rank_no_wide_rows(spark, sf):
    found = risk.conflicts(Stages(spark, sf).near_scored)
    assert "Window" not in plan(found)
    rows = [(x.scenario_token, x.frame_index, *sorted((x.s_track, x.o_track))) for x in found.collect()]
    assert rows and len(rows) == len(set(rows)) and {x.tag for x in found.select("tag").distinct().collect()} <= {"ego_to_agent", "agent_to_agent"}

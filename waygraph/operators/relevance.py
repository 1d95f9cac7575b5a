"""Which pairs matter: an additive score with reasons, and selections by rank."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.config import R, Relevance
from waygraph.functions.classifiers import is_static, is_vulnerable
from waygraph.operators.pairs import FRAME, PAIR, with_cpa

#: Rank of a reason when the main one is named.
PRIORITY = {
    "generator_predicted_path_intersection": 115,
    "generator_within_distance": 110,
    "generator_forward_corridor": 105,
    "generator_same_lane": 100,
    "predicted_close_approach": 100,
    "immediate_proximity": 95,
    "vulnerable_road_user_near_ego_path": 90,
    "static_obstacle_on_ego_path": 85,
    "shared_intersection_conflict": 80,
    "same_lane_ahead": 75,
    "connected_successor": 70,
    "connected_predecessor": 65,
    "shared_traffic_control": 60,
    "same_lane_behind": 55,
    "adjacent_left": 50,
    "adjacent_right": 50,
    "ego_route_corridor": 40,
    "reverse_of_selected_pair": 10,
}


def _falling(most: float, share: Column) -> Column:
    return F.greatest(F.lit(0.0), most * (1.0 - share))


def route_relation(s: Column, o: Column) -> Column:
    d = o - s
    return F.when(d.isNull(), F.when(o.isNotNull(), "object_on_route").otherwise("off_or_unknown_route")).when(d == 0, "same_route_roadblock").when(d > 0, F.concat(F.lit("route_ahead_"), d.cast("string"))).otherwise(F.concat(F.lit("route_behind_"), (-d).cast("string")))


def with_relevance(pairs: DataFrame, r: Relevance = R) -> DataFrame:
    """reasons, score, critical, mandatory, primary_reason, route_relation, directional (or why not) of pairs with footprints and topology.

    shared_control is read where it is there.
    """
    df = with_cpa(pairs, r.cpa_horizon_s)
    ego = with_cpa(df, r.ego_prediction_s, "ego_cpa")
    c = F.col
    d, free, path, rel, flow = c("center_distance"), c("free_space"), c("reference_distance"), c("map_relation"), c("same_flow")
    control = F.coalesce(c("shared_control"), F.lit(False)) if "shared_control" in df.columns else F.lit(False)
    close = F.coalesce(free <= r.free_space, F.lit(False))
    step = c("o_route_rank") - c("s_route_rank")
    on_route = c("s_is_ego") & (step.between(0, r.route_ahead) & (d <= r.lane_ahead) | step.between(-r.route_behind, -1) & (d <= r.lane_behind))
    approach = c("cpa_closing") & (c("cpa_clearance") <= r.cpa_clearance)
    from_ego = c("s_is_ego")
    rules: list[tuple[str, Column, Column]] = [
        ("immediate_proximity", close, 100.0 - F.least(F.lit(50.0), free * 5.0)),
        ("same_lane_ahead", (rel == "same_map") & flow & (path > 0) & (path <= r.lane_ahead), 70.0 + _falling(30.0, path / r.lane_ahead)),
        ("same_lane_behind", (rel == "same_map") & flow & (path < 0) & (path >= -r.lane_behind), 45.0 + _falling(20.0, F.abs(path) / r.lane_behind)),
        *((side, (rel == side) & flow & (d <= r.adjacent), 45.0 + _falling(20.0, d / r.adjacent)) for side in ("adjacent_left", "adjacent_right")),
        *((f"connected_{kind}", (rel == kind) & flow & (d <= r.connected), 55.0 + _falling(15.0, d / r.connected)) for kind in ("successor", "predecessor")),
        ("ego_route_corridor", on_route, 35.0 - 5.0 * F.abs(step)),
        ("shared_intersection_conflict", c("shared_intersection") & (d <= r.shared_intersection), 65.0 + _falling(20.0, d / r.shared_intersection)),
        ("shared_traffic_control", control & (d <= r.traffic_control), F.lit(55.0)),
        ("vulnerable_road_user_near_ego_path", is_vulnerable(c("o_agent_type")) & (d <= r.vulnerable) & (c("o_route_rank").isNotNull() | c("o_in_crosswalk") | c("shared_intersection") | control | close), F.lit(90.0)),
        ("static_obstacle_on_ego_path", is_static(c("o_agent_type")) & (d <= r.static) & (c("o_route_rank").isNotNull() | close), F.lit(80.0)),
        ("predicted_close_approach", approach, 95.0 - F.least(F.lit(40.0), c("cpa_time_s") * 5.0)),
        ("generator_within_distance", from_ego & (d <= r.ego_distance), F.lit(0.0)),
        ("generator_forward_corridor", from_ego & c("travel_longitudinal").between(0, r.ego_corridor_length) & (F.abs("travel_lateral") <= r.ego_corridor_half_width), F.lit(0.0)),
        ("generator_same_lane", from_ego & (rel == "same_map") & flow, F.lit(0.0)),
        ("generator_predicted_path_intersection", from_ego & (c("ego_cpa_clearance") <= r.ego_path_clearance) & (c("ego_cpa_closing") | (c("ego_cpa_time_s") <= 1e-9)), F.lit(0.0)),
    ]
    inside = F.coalesce(d <= r.hard_distance, F.lit(False))
    # each rule is decided once, in a column of its own; what follows reads flags and names, as one long expression over
    # all rules would pass the size up to which the JVM compiles a method
    df = ego.withColumns({f"held_{name}": inside & F.coalesce(cond, F.lit(False)) for name, cond, _ in rules})
    held = {name: c(f"held_{name}") for name, _, _ in rules}
    score = sum((F.when(held[name], points).otherwise(F.lit(0.0)) for name, _, points in rules), F.lit(0.0))
    main = F.when(~inside, "outside_hard_range")
    for name in sorted(held, key=lambda n: -PRIORITY[n]):
        main = main.when(held[name], name)
    critical = (
        (held["immediate_proximity"] & (free <= 1.0))
        | (held["vulnerable_road_user_near_ego_path"] & (d <= 12.0))
        | (held["predicted_close_approach"] & (c("cpa_time_s") <= r.critical_cpa_s) & (c("cpa_clearance") <= r.critical_clearance))
    )
    df = df.withColumn("reasons", F.array_compact(F.array(*(F.when(held[n], n) for n in sorted(held))))).withColumn("relevant", F.size("reasons") > 0)
    df = df.withColumns(
        {
            "score": score,
            "critical": F.coalesce(critical, F.lit(False)),
            "mandatory": reduce(or_, (held[n] for n in held if n.startswith("generator_"))),
            "primary_reason": main.otherwise("not_relevant"),
            "route_relation": route_relation(c("s_route_rank"), c("o_route_rank")),
        }
    )
    no = (
        F.when(~inside, "outside_hard_range")
        .when(~c("relevant"), "pair_not_relevant")
        .when(~flow, "cross_or_opposite_flow")
        .when((rel == "same_map") & path.isNotNull(), F.when(~(path.between(-r.directional_behind, r.directional_ahead) & (F.abs(path) > 1e-6)), "same_lane_outside_directional_range"))
        .when(rel.isin("adjacent_left", "adjacent_right"), F.when(d > r.directional_adjacent, "adjacent_lane_outside_directional_range"))
        .when(rel.isin("successor", "predecessor"), F.when(d > r.directional_connected, "connected_lane_outside_directional_range"))
        .otherwise("no_common_lane_path_frame")
    )
    return df.withColumn("direction_omission", no).withColumn("directional", c("direction_omission").isNull()).drop(*(f"held_{name}" for name in held))


def select_for_ego(scored: DataFrame, r: Relevance = R) -> DataFrame:
    """Ego's pairs in the selection: all mandatory and critical ones, then the best others up to the caps; a rank over the frame."""
    frame = Window.partitionBy(*FRAME)
    own = scored.where("s_is_ego and relevant").withColumn("kept", F.col("mandatory") | F.col("critical"))
    order = Window.partitionBy(*FRAME, "kept").orderBy(F.desc("score"), F.asc_nulls_last("center_distance"), "o_track")
    own = own.withColumn("n_kept", F.sum(F.col("kept").cast("int")).over(frame)).withColumn("place", F.row_number().over(order))
    room = F.least(F.lit(r.most_ordinary), F.greatest(F.lit(0), r.most_agents - F.col("n_kept")))
    return own.where(F.col("kept") | (F.col("place") <= room)).drop("n_kept", "place", "kept")


def reverse_of(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """PAIR, mandatory, critical, score, primary_reason, reasons of the other direction of chosen pairs: judged by itself, relevant in any case, mandatory as the chosen one."""
    back = chosen.select("scenario_token", "frame_index", F.col("s_track").alias("o_track"), F.col("o_track").alias("s_track"), F.col("mandatory").alias("chosen_mandatory"))
    own = scored.join(back, ["scenario_token", "frame_index", "s_track", "o_track"])
    why = F.array_sort(F.array_append("reasons", F.lit("reverse_of_selected_pair")))
    main = F.when(F.size("reasons") == 0, F.lit("reverse_of_selected_pair")).otherwise(F.col("primary_reason"))
    return own.select(*PAIR, F.col("chosen_mandatory").alias("mandatory"), "critical", "score", main.alias("primary_reason"), F.array_join(why, "|").alias("reasons"))


def select_agent_pairs(scored: DataFrame, r: Relevance = R) -> DataFrame:
    """PAIR and critical of agents' pairs in the selection: critical ones, then others greedily under a cap for each agent and frame.

    The greedy pass is sequential in a frame alone: frames are dealt over the tasks and sorted there, and one
    pass over a task's rows begins anew with each frame.
    """
    own = scored.where("relevant and not s_is_ego and not o_is_ego").select(*PAIR, "critical", "mandatory", "score", F.coalesce("free_space", "center_distance").alias("distance"))
    order = [*FRAME, F.desc("critical"), F.desc("mandatory"), F.desc("score"), F.asc_nulls_last("distance"), "s_track", "o_track"]
    dealt = own.repartition("scenario_token", "frame_index").sortWithinPartitions(*order).select(*PAIR, "critical")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, ordinary = None, {}, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            rows = zip(*(batch.column(c).to_pylist() for c in (*FRAME, "s_track", "o_track", "critical")), strict=True)
            for i, (*frame, a, b, critical) in enumerate(rows):
                if frame != now:
                    now, seen, ordinary = frame, {}, 0
                if not critical:
                    if seen.get(a, 0) >= r.most_neighbours or seen.get(b, 0) >= r.most_neighbours or ordinary >= r.most_pairs:
                        continue
                    ordinary += 1
                    seen[a], seen[b] = seen.get(a, 0) + 1, seen.get(b, 0) + 1
                keep[i] = True
            yield batch.filter(pa.array(keep))

    return dealt.mapInArrow(pick, dealt.schema)


def relevance_facts(scored: DataFrame) -> DataFrame:
    """One row per reason of each relevant pair, with the score and the main reason."""
    return scored.where("relevant").select(
        *PAIR, F.when(F.col("s_is_ego"), "isRelevantToEgo").otherwise("isRelevantPair").alias("predicate"), "score", "primary_reason", "route_relation", F.explode("reasons").alias("reason")
    )


def decisions(scored: DataFrame) -> DataFrame:
    """One row for each relevant pair, with its score and reasons."""
    return scored.where("relevant").select(*PAIR, F.when(F.col("s_is_ego"), "isRelevantToEgo").otherwise("isRelevantPair").alias("predicate"), "score", "primary_reason", "route_relation", "reasons")


def decision_texts(scored: DataFrame) -> DataFrame:
    """Reasons, main reason and route relation of each relevant pair."""
    named = F.transform("reasons", lambda r: F.struct(F.lit("hasRelevanceReason").alias("predicate"), r.alias("object")))
    more = F.array(*(F.struct(F.lit(p).alias("predicate"), F.col(c).alias("object")) for p, c in (("hasPrimaryRelevanceReason", "primary_reason"), ("hasRouteRelation", "route_relation"))))
    return scored.where("relevant").select(*PAIR, F.explode(F.concat(named, more)).alias("p")).select(*PAIR, "p.predicate", "p.object")


def decision_scores(scored: DataFrame) -> DataFrame:
    """hasRelevanceScore of each relevant pair."""
    return scored.where("relevant").select(*PAIR, F.lit("hasRelevanceScore").alias("predicate"), F.col("score").alias("value"))


def audit(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every ego decision, and whether it was selected."""
    picked = chosen.select(*PAIR).withColumn("selected", F.lit(True))
    return scored.where("s_is_ego").join(picked, list(PAIR), "left").select(*PAIR, F.coalesce("selected", F.lit(False)).alias("selected"), "relevant", "critical", "mandatory", "score", "primary_reason", F.array_join("reasons", "|").alias("reasons"), "directional", "direction_omission")

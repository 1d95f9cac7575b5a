"""Every operator as a query over the scene of the events table, and SQL for the same rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waygraph import catalog
from waygraph.config import R, T
from waygraph.functions.classifiers import is_vehicle, speed_state
from waygraph.operators import areas, crossing, entities, following, future, intervals, lanes, mapmatch, maneuvers, pairs, query, relevance, risk, spatial, tallies, traffic, visibility
from waygraph.operators.assertions import entity, identified, of_entities, of_pairs, stated, united
from waygraph.oracles import SQL  # noqa: F401
from waygraph.plans import registry
from waygraph.plans.scene import Scene, scene
from waygraph.plans.shared import compiled, cut, dealt


#: The longest free space that relevance and contact states tell from longer ones.
REACH = max(R.free_space, T.near)


@dataclass
class Stages:
    """The wide tables that families share, each built once it is asked for."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def scene(self) -> Scene:
        return scene(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        """The scene's entities, worked out once for all families that join them; dealt by scenario, as a file may come in few parts."""
        return cut(dealt(self.scene.entities, "scenario_token"))

    @cached_property
    def moving(self) -> DataFrame:
        return entities.with_motion(self.users)

    @cached_property
    def history(self) -> DataFrame:
        return entities.with_history(self.moving)

    @cached_property
    def found(self) -> DataFrame:
        s = self.scene
        return cut(mapmatch.candidates(self.moving, s.scenarios, s.map_objects))

    @cached_property
    def primary(self) -> DataFrame:
        return mapmatch.primary(self.found)

    @cached_property
    def matched(self) -> DataFrame:
        s = self.scene
        return cut(mapmatch.travel_direction(mapmatch.with_map(self.history, self.primary, s.scenarios, s.map_objects, s.map_edges, s.map_adjacency, s.route)))

    @cached_property
    def signals(self) -> DataFrame:
        return traffic.signals(self.scene.traffic_lights, self.scene.scenarios)

    @cached_property
    def kinematic(self) -> DataFrame:
        return pairs.with_kinematics(pairs.all_pairs(self.users))

    @cached_property
    def footprints(self) -> DataFrame:
        """What footprints, pair history and contact states are stated from, and no more."""
        asked = ("center_distance", "longitudinal", "lateral", "free_space", "overlap_area", "longitudinal_gap", "lateral_gap", "overlapping", "touching")
        return cut(pairs.with_footprints(self.kinematic).select(*pairs.PAIR, *asked))

    @cached_property
    def areas_of(self) -> DataFrame:
        s = self.scene
        return mapmatch.candidates(self.moving, s.scenarios, s.map_objects, ("intersection", "crosswalk"))

    @cached_property
    def known(self) -> DataFrame:
        """Road users with all that pairs ask of either side, and no more."""
        users = traffic.with_controls(mapmatch.with_areas(self.matched, self.areas_of), self.signals)
        return cut(users.select(*dict.fromkeys((*pairs.FRAME, *pairs.SIDE, *mapmatch.MAP_COLUMNS, "controls"))))

    def _topology(self, meet: Callable[..., DataFrame], footprints: Callable[[DataFrame], DataFrame] = pairs.with_footprints) -> DataFrame:
        both = pairs.with_kinematics(meet(self.known, *mapmatch.MAP_COLUMNS, "controls")).withColumn("shared_control", F.arrays_overlap("s_controls", "o_controls"))
        return footprints(mapmatch.with_topology(both))

    @cached_property
    def topology(self) -> DataFrame:
        return self._topology(pairs.all_pairs)

    @cached_property
    def judged(self) -> DataFrame:
        """All pairs of a frame with their relevance and spatial states."""
        return spatial.with_spatial(relevance.with_relevance(self.topology))

    @cached_property
    def near_footprints(self) -> DataFrame:
        """All pairs of a frame with footprints for counts, which ask no distance beyond REACH."""
        return pairs.with_footprints_within(pairs.with_kinematics(self._dealt_pairs(self.users)), REACH)

    @cached_property
    def near_judged(self) -> DataFrame:
        """judged for counts: no rule and no state asks a distance beyond REACH."""
        return spatial.with_spatial(relevance.with_relevance(self._topology(self._dealt_pairs, lambda both: pairs.with_footprints_within(both, REACH))))

    @staticmethod
    def _dealt_pairs(users: DataFrame, *extra: str) -> DataFrame:
        """All pairs, in a fixed number of tasks: road users are few bytes, of which one task would be made, and their pairs are many."""
        return pairs.all_pairs(dealt(users, *pairs.FRAME), *extra)

    @cached_property
    def scored(self) -> DataFrame:
        """What facts state of all pairs of a frame, written once for the families that share it."""
        stated_of = ("progress_difference", "path_distance", "travel_difference", "travel_longitudinal", "travel_lateral", "same_lane", "shared_intersection", "map_relation")
        decided = ("relevant", "score", "primary_reason", "route_relation", "reasons", "directional", "direction_omission", "s_is_ego", "s_agent_type", "o_agent_type", "sector", "contact_state", "heading_state")
        with compiled(self.spark):
            return cut(self.judged.select(*pairs.PAIR, *stated_of, *decided))

    @cached_property
    def near_scored(self) -> DataFrame:
        """Pairs within the distance beyond which none is relevant, through the grid."""
        return relevance.with_relevance(self._topology(lambda users, *extra: pairs.near_pairs(users, R.hard_distance, *extra)))

    @cached_property
    def ego_scored(self) -> DataFrame:
        """Decisions on ego's pairs alone."""
        decided = ("s_is_ego", "relevant", "critical", "mandatory", "score", "center_distance", "primary_reason", "reasons", "directional", "direction_omission")
        return cut(relevance.with_relevance(self._topology(pairs.ego_pairs)).select(*pairs.PAIR, *decided))

    @cached_property
    def vehicle_pairs(self) -> DataFrame:
        cars = entities.with_forward_speed(self.matched.where(is_vehicle(F.col("agent_type"))))
        return pairs.with_pair_axis(pairs.with_kinematics(pairs.near_pairs(cars, T.overtake_radius, "primary_id", "forward_speed_seen")))

    @cached_property
    def lane_changes(self) -> DataFrame:
        s = self.scene
        return maneuvers.lane_changes(self.matched, self.found, self.primary, s.scenarios, s.map_edges, s.map_adjacency, s.map_objects)

    @cached_property
    def leaders(self) -> DataFrame:
        s = self.scene
        return following.leaders(self.matched, following.unbranched_paths(s.map_objects, s.map_edges), s.scenarios)

    @cached_property
    def futures(self) -> DataFrame:
        return future.future_positions(self.users)

    @cached_property
    def run_facts(self) -> DataFrame:
        """Frames of follows, queues and crossings, each with the start of its run."""
        key = ("scenario_token", "frame_index", "timestamp_us", "predicate", "s_track", "o_track", "start_us")
        crossed = self.crossings.withColumn("predicate", F.lit("crossesInFrontOf"))
        return BUILD["follow_facts"](self).select(*key).unionByName(crossed.select(*key))

    @cached_property
    def track_events(self) -> DataFrame:
        """Lane changes, merges, overtakes and yields as intervals: predicate, s_track, o_track (a lane for lane changes), start_us, end_us."""
        key = ("scenario_token", "predicate", "s_track", "o_track", "start_us", "end_us")
        at = lambda frame, name: self.scene.frames.select("scenario_token", F.col("frame_index").alias(frame), F.col("timestamp_us").alias(name))
        timed = lambda df, a, b: df.join(at(a, "start_us"), ["scenario_token", a]).join(at(b, "end_us"), ["scenario_token", b])
        changed = self.lane_changes.where("seen_before").select("scenario_token", F.lit("changesLane").alias("predicate"), F.col("track_token").alias("s_track"), F.concat(F.lit("lane:"), "target_lane").alias("o_track"), "onset_frame", "completion_frame")
        merged = BUILD["merges"](self).withColumnRenamed("track_token", "s_track")
        passed = BUILD["overtakes"](self).withColumn("predicate", F.lit("overtakes"))
        yielded = BUILD["yields"](self).withColumn("predicate", F.lit("yieldsTo")).withColumn("start_us", F.col("reaction_us")).withColumn("end_us", F.col("proceed_us"))
        parts = [timed(changed, "onset_frame", "completion_frame"), timed(merged, "boundary_frame", "completion_frame"), timed(passed, "start_frame", "completion_frame"), yielded]
        return cut(united(p.select(*key) for p in parts))

    @cached_property
    def path_conflicts(self) -> DataFrame:
        return cut(future.conflicts_of_paths(future.future_paths(self.matched)))

    @cached_property
    def meetings(self) -> DataFrame:
        return cut(crossing.meetings(self.kinematic, crossing.track_pairs(self.users)))

    @cached_property
    def barred(self) -> DataFrame:
        """Of those that meet only: distances to areas are asked for no others."""
        met = self.meetings.select("scenario_token", "frame_index", F.explode(F.array("s_track", "o_track")).alias("track_token")).distinct()
        tracks = self.users.join(met.select("scenario_token", "track_token").distinct(), ["scenario_token", "track_token"], "left_semi")
        return areas.gates(tracks, self.scene.scenarios, self.scene.map_objects).join(met, ["scenario_token", "frame_index", "track_token"], "left_semi")

    @cached_property
    def crossings(self) -> DataFrame:
        return crossing.crossings(self.meetings, self.scene.frames, self.barred)


#: Families of facts: the categories that they state, and how.
FAMILIES: dict[str, Callable[[Stages], DataFrame]] = {
    "structure": lambda s: of_entities(entities.structure_facts(s.scene.entities, s.scene.scenarios)),
    "pose": lambda s: of_entities(entities.pose_facts(s.scene.entities)),
    "motion": lambda s: of_entities(entities.motion_facts(s.moving)),
    "velocity": lambda s: stated(entities.velocity_vectors(s.moving), entity("track_token"), value=F.to_json("vector")),
    "temporal": lambda s: of_entities(entities.temporal_facts(s.history)),
    "precedes": lambda s: stated(entities.precedes(s.history), F.col("subject_id"), F.col("object_id")),
    "motion_state": lambda s: of_entities(entities.motion_states(s.history)),
    "map_membership": lambda s: stated(mapmatch.memberships(s.found), entity("track_token"), F.col("object_id")),
    "area_membership": lambda s: stated(BUILD["area_memberships"](s), entity("track_token"), F.col("object_id")),
    "map": lambda s: of_entities(mapmatch.map_facts(s.matched)),
    "map_relation": lambda s: of_entities(mapmatch.map_relations(s.matched)),
    "pairwise": lambda s: stated(pairs.identity_facts(s.kinematic), F.col("pair_id"), F.col("object")),
    "pair_kinematics": lambda s: of_pairs(pairs.kinematic_facts(s.kinematic)),
    "pair_footprints": lambda s: of_pairs(pairs.footprint_facts(s.footprints)),
    "pair_history": lambda s: of_pairs(pairs.pair_history_facts(pairs.with_pair_history(s.footprints))),
    "pair_topology": lambda s: of_pairs(mapmatch.topology_facts(s.scored)),
    "pair_map": lambda s: of_pairs(mapmatch.topology_states(s.scored)),
    "pair_relation": lambda s: of_pairs(mapmatch.topology_texts(s.scored)),
    "relevance_texts": lambda s: of_pairs(relevance.decision_texts(s.scored)),
    "relevance_scores": lambda s: of_pairs(relevance.decision_scores(s.scored)),
    "spatial": lambda s: of_pairs(spatial.spatial_facts(s.scored)),
    "relevance": lambda s: of_pairs(relevance.decisions(s.scored), ("score", "primary_reason", "route_relation", "reasons")),
    "traffic_light": lambda s: stated(traffic.signal_facts(s.signals), F.col("signal_id"), F.col("object")),
    "relevant_signal": lambda s: stated(BUILD["relevant_signals"](s), entity("track_token"), F.col("signal_id")),
    "following": lambda s: stated(BUILD["follow_facts"](s), entity("s_track"), entity("o_track"), start=F.col("start_us"), evidence=("gap", "duration_s")),
    "crossing": lambda s: stated(s.crossings.withColumn("predicate", F.lit("crossesInFrontOf")), entity("s_track"), entity("o_track"), start=F.col("start_us"), evidence=("conflict_x", "conflict_y", "angle", "s_eta", "eta_gap", "score")),
    "maneuver": lambda s: stated(BUILD["maneuvers"](s), entity("track_token"), F.col("object_id")),
    "future_position": lambda s: stated(s.futures.withColumn("predicate", F.lit("hasFuturePosition")), entity("track_token"), value=F.to_json(F.struct("x", "y", "heading")), end=F.col("at_us"), evidence=("sample", "at_us")),
    "future_footprint": lambda s: stated(future.footprints_at(s.futures, s.users).withColumn("predicate", F.lit("hasFutureFootprint")), entity("track_token"), value=F.to_json("corners"), end=F.col("at_us"), evidence=("sample", "at_us")),
    "future": lambda s: of_entities(future.coverage_facts(future.future_coverage(s.users))),
}
#: Those that come from scans of whole tracks or from kernels, which SQL can't state.
EVENT_FAMILIES: dict[str, Callable[[Stages], DataFrame]] = {
    "intent": lambda s: stated(BUILD["intents"](s), entity("s_track"), entity("o_track"), start=F.col("start_us"), evidence=("region", "duration_s")),
    "lane_change": lambda s: stated(BUILD["lane_changes"](s), entity("track_token"), F.concat(F.lit("lane:"), "target_lane"), evidence=("source_lane", "target_lane", "side", "onset_frame", "completion_frame")),
    "merge": lambda s: stated(query.at_frame(BUILD["merges"](s).withColumnRenamed("track_token", "s_track"), s.scene.frames, "completion_frame"), entity("s_track"), entity("o_track"), evidence=("gap", "boundary_frame", "completion_frame")),
    "overtake": lambda s: stated(query.at_frame(BUILD["overtakes"](s), s.scene.frames, "completion_frame").withColumn("predicate", F.lit("overtakes")), entity("s_track"), entity("o_track"), start=F.col("timestamp_us") - F.col("duration_s") * 1e6, evidence=("start_frame", "departure_frame", "side_frame", "reversal_frame", "clearance_frame", "return_frame", "passing_side")),
    "yield": lambda s: stated(BUILD["yields"](s).withColumnRenamed("reaction_us", "timestamp_us").withColumn("predicate", F.lit("yieldsTo")), entity("s_track"), entity("o_track"), end=F.col("clear_us"), evidence=("clear_us", "proceed_us")),
    "risk": lambda s: stated(BUILD["conflict_risks"](s), entity("s_track"), entity("o_track"), evidence=("basis", "risk_time_s", "risk_least_clearance", "braking_demand", "unsafe_lane_change")),
    "visibility": lambda s: stated(BUILD["visibility_facts"](s), entity("o_track"), F.when(F.col("object").isNotNull(), entity("object"))),
}


def assertions_of(stages: Stages, families: tuple[str, ...] = ()) -> DataFrame:
    """All facts of the families, or of all families, with ids, categories and evidence."""
    every = FAMILIES | EVENT_FAMILIES
    return identified(united(every[f](stages) for f in families or every), catalog.definitions(stages.spark))


def _history_counts(s: Stages) -> tuple[DataFrame, dict[str, tallies.Counts | list]]:
    df = s.history
    return df, {
        "motion": entities.motion_facts(df, tallies.numbers)[1],
        "velocity": {"hasVelocity": F.count_if(F.col("vx").isNotNull() & F.col("vy").isNotNull())},
        "temporal": entities.temporal_facts(df, tallies.numbers)[1],
        "precedes": {"precedes": F.count_if("continuous")},
        "motion_state": entities.motion_states(df, tallies.labels)[1],
    }


def _pair_counts(s: Stages) -> tuple[DataFrame, dict[str, tallies.Counts | list]]:
    df = s.near_footprints
    return df, {
        "pairwise": {p: F.count(F.lit(1)) for p in ("hasPairwiseState", "pairSubject", "pairObject")},
        "pair_kinematics": pairs.kinematic_facts(df, tallies.numbers)[1],
        "pair_footprints": pairs.footprint_facts(df, tallies.numbers)[1],
    }


def _judged_counts(s: Stages) -> tuple[DataFrame, dict[str, tallies.Counts | list]]:
    df, relevant = s.near_judged, F.count_if("relevant")
    from_ego = F.coalesce("s_is_ego", F.lit(False))
    return df, {
        "pair_topology": mapmatch.topology_facts(df, tallies.numbers)[1],
        "pair_map": {"inSameLaneAs": F.count_if("same_lane"), "sharesIntersectionWith": F.count_if("shared_intersection")},
        "pair_relation": {"hasSpatialMapRelation": F.count(F.lit(1))},
        "relevance_texts": {"hasRelevanceReason": F.sum(F.when(F.col("relevant"), F.size("reasons"))), "hasPrimaryRelevanceReason": relevant, "hasRouteRelation": relevant},
        "relevance_scores": {"hasRelevanceScore": relevant},
        "spatial": spatial.spatial_facts(df, tallies.labels)[1],
        "relevance": {"isRelevantToEgo": F.count_if(F.col("relevant") & from_ego), "isRelevantPair": F.count_if(F.col("relevant") & ~from_ego)},
    }


def _future_counts(s: Stages) -> tuple[DataFrame, dict[str, tallies.Counts | list]]:
    """A target time that two samples bracket is one position, and one footprint for each entity of its key."""
    df = future.future_coverage(s.users).withColumn("same_key", F.count(F.lit(1)).over(Window.partitionBy(*entities.KEYS)))
    return df, {
        "future_position": {"hasFuturePosition": F.sum("samples")},
        "future_footprint": {"hasFutureFootprint": F.sum(F.col("samples") * F.col("same_key"))},
        "future": future.coverage_facts(df, tallies.numbers)[1],
    }


#: Families that are counted in one pass over a table: the table, and what each of them states of it.
PASSES: dict[tuple[str, ...], Callable[[Stages], tuple[DataFrame, dict[str, tallies.Counts | list]]]] = {
    ("structure",): lambda s: (lambda df, n: (df, {"structure": n}))(*entities.structure_facts(s.scene.entities, s.scene.scenarios, tallies.numbers)),
    ("pose",): lambda s: (s.scene.entities, {"pose": entities.pose_facts(s.scene.entities, state=tallies.numbers)[1]}),
    ("motion", "velocity", "temporal", "precedes", "motion_state"): _history_counts,
    ("map", "map_relation"): lambda s: (s.matched, {"map": mapmatch.map_facts(s.matched, tallies.numbers)[1], "map_relation": mapmatch.map_relations(s.matched, tallies.numbers)[1]}),
    ("pairwise", "pair_kinematics", "pair_footprints"): _pair_counts,
    ("pair_history",): lambda s: (lambda df: (df, {"pair_history": pairs.pair_history_facts(df, tallies.numbers)[1]}))(pairs.with_pair_history(s.near_footprints.select(*pairs.PAIR, "center_distance", "free_space"))),
    ("pair_topology", "pair_map", "pair_relation", "relevance_texts", "relevance_scores", "spatial", "relevance"): _judged_counts,
    ("future_position", "future_footprint", "future"): _future_counts,
}


def tally_of(stages: Stages, families: tuple[str, ...] = ()) -> DataFrame:
    """predicate, n: how often all families, or some, state each predicate of the catalogue.

    Families of PASSES are counted where they are read, without a row a fact; each other one
    counts before the catalogue is joined, so that no fact is named or moved.
    """
    every = FAMILIES | EVENT_FAMILIES
    asked = list(families or every)
    parts = []
    for of, counted in PASSES.items():
        if own := [f for f in of if f in asked]:
            df, counts = counted(stages)
            parts.append(tallies.tallied(df, [counts[f] for f in own]))
    passed = {f for of in PASSES for f in of}
    if others := [f for f in asked if f not in passed]:
        parts.append(united(every[f](stages).select("predicate") for f in others).groupBy("predicate").agg(F.count(F.lit(1)).alias("n")))
    n = united(parts).groupBy("predicate").agg(F.sum("n").alias("n"))
    return n.join(F.broadcast(catalog.definitions(stages.spark).select("predicate")), "predicate", "left_semi")


def assertions_of_categories(stages: Stages, categories: tuple[str, ...]) -> DataFrame:
    """All facts of some categories: their families alone, over the stages alone that these are built on, each once."""
    families = registry.families_of(categories)
    for stage in registry.stages_of(families):
        getattr(stages, stage)
    return assertions_of(stages, tuple(families)).where(F.col("category").isin(*categories))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


BUILD: dict[str, Callable[[Stages], DataFrame]] = {
    "closing_speed_of_ego_pairs": lambda s: pairs.kinematic_facts(pairs.with_kinematics(pairs.ego_pairs(s.users))).where("predicate = 'hasClosingSpeedTo'"),
    "scenes": lambda s: s.scene.entities,
    "structure_facts": lambda s: entities.structure_facts(s.scene.entities, s.scene.scenarios),
    "pose_facts": lambda s: entities.pose_facts(s.scene.entities),
    "motion_facts": lambda s: entities.motion_facts(s.moving),
    "velocity_vectors": lambda s: entities.velocity_vectors(s.moving).select(*entities.KEYS, "predicate", F.get("vector", F.lit(0)).alias("vx"), F.get("vector", F.lit(1)).alias("vy")),
    "speed_states": lambda s: entities.states(s.scene.entities.withColumn("state", speed_state(F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2), F.col("agent_type"))), entities.KEYS, [F.col("state")]),
    "temporal_facts": lambda s: entities.temporal_facts(s.history),
    "precedes": lambda s: entities.precedes(s.history),
    "continuity_breaks": lambda s: entities.continuity_breaks(s.history),
    "motion_states": lambda s: entities.motion_states(s.history),
    "pair_identity": lambda s: pairs.identity_facts(s.kinematic),
    "pair_kinematics": lambda s: pairs.kinematic_facts(s.kinematic),
    "pair_footprints": lambda s: pairs.footprint_facts(s.footprints),
    "pair_history": lambda s: pairs.pair_history_facts(pairs.with_pair_history(s.footprints)),
    "closest_approach": lambda s: pairs.with_cpa(s.kinematic).select(*pairs.PAIR, "cpa_time_s", "cpa_distance", "cpa_clearance", "cpa_closing"),
    "near_agent_pairs": lambda s: pairs.near_agent_pairs(s.users).select(*pairs.PAIR),
    "body_sectors": lambda s: entities.states(spatial.with_spatial(s.footprints), pairs.PAIR, [F.col("sector")]),
    "contact_states": lambda s: entities.states(spatial.with_spatial(s.footprints), pairs.PAIR, [F.col("contact_state")]),
    "map_memberships": lambda s: mapmatch.memberships(s.found),
    "area_memberships": lambda s: mapmatch.memberships(s.areas_of),
    "primary_lanes": lambda s: s.primary,
    "map_facts": lambda s: mapmatch.map_facts(s.matched),
    "map_relations": lambda s: mapmatch.map_relations(s.matched),
    "pair_topology": lambda s: s.topology.select(*pairs.PAIR, "map_relation", "path_distance", "progress_difference", "travel_difference", "travel_longitudinal", "travel_lateral", "same_flow", "same_lane", "shared_intersection"),
    "relevance_facts": lambda s: relevance.relevance_facts(s.near_scored),
    "relevance_audit": lambda s: relevance.audit(s.ego_scored, relevance.select_for_ego(s.ego_scored)),
    "relevant_ego_pairs": lambda s: relevance.select_for_ego(s.ego_scored).select(*pairs.PAIR, "score", "primary_reason"),
    "reverse_pairs": lambda s: relevance.reverse_of(s.ego_scored, relevance.select_for_ego(s.ego_scored)),
    "relevant_agent_pairs": lambda s: relevance.select_agent_pairs(s.near_scored),
    "spatial_facts": lambda s: spatial.spatial_facts(s.judged),
    "sector_omissions": lambda s: spatial.sector_omissions(s.judged),
    "signal_facts": lambda s: traffic.signal_facts(traffic.signals(s.scene.traffic_lights, s.scene.scenarios)),
    "relevant_signals": lambda s: traffic.relevant_signals(s.matched, mapmatch.memberships(s.found), traffic.signals(s.scene.traffic_lights, s.scene.scenarios)),
    "visibility_facts": lambda s: visibility.visibility_facts(visibility.visibility(s.kinematic)),
    "conflict_risks": lambda s: risk.conflicts(s.near_scored),
    "leaders": lambda s: s.leaders,
    "follow_facts": lambda s: following.follow_facts(s.leaders, s.scene.frames),
    "area_distances": lambda s: areas.area_distances(s.users, s.scene.scenarios, s.scene.map_objects),
    "crossing_gates": lambda s: crossing.gated(s.meetings, s.barred).select(*pairs.FRAME, "s_track", "o_track", "s_reason", "o_reason"),
    "crossings": lambda s: s.crossings,
    "run_frames": lambda s: intervals.at_frames(intervals.runs(s.run_facts), s.scene.frames).select(*pairs.FRAME, "predicate", "s_track", "o_track", "start_us", "end_us"),
    "runs_together": lambda s: intervals.together(intervals.runs(s.run_facts)),
    "event_edges": lambda s: intervals.edges_at_frames(s.track_events, s.run_facts, s.scene.frames),
    "current_times": lambda s: intervals.current_time(assertions_of(s, ("following", "crossing", "precedes")).drop("end_us")).select("predicate", "subject_id", "object_id", "start_us", "current_us"),
    "follow_evidence": lambda s: intervals.evidence_table(assertions_of(s, ("following",)), ("follows", "queuesBehind")),
    "forward_speeds": lambda s: entities.with_forward_speed(s.users).select(*entities.KEYS, "forward_speed_seen"),
    "pair_axes": lambda s: s.vehicle_pairs.select(*pairs.FRAME, "s_track", "o_track", "axis_ahead", "axis_aside", "behind_gap", "clearance", "level"),
    "yields": lambda s: crossing.yields(s.crossings, s.users, traffic.red_frames(s.matched, s.signals)),
    "track_pairs": lambda s: crossing.track_pairs(s.users),
    "lane_neighbours": lambda s: lanes.neighbours(s.matched, s.scene.scenarios, lanes.lane_sides(s.scene.map_objects)),
    "corridor_progress": lambda s: lanes.corridor_progress(s.matched, s.scene.scenarios, lanes.corridor_lines(s.scene.map_objects, s.scene.map_edges)),
    "lane_changes": lambda s: maneuvers.lane_change_facts(s.lane_changes, s.users),
    "merges": lambda s: maneuvers.merges(s.lane_changes, s.matched, s.scene.scenarios, following.unbranched_paths(s.scene.map_objects, s.scene.map_edges, T.merge_hops)),
    "overtakes": lambda s: maneuvers.overtakes(s.vehicle_pairs, maneuvers.reachable(s.scene.map_edges), s.scene.scenarios, s.scene.map_adjacency),
    "maneuvers": lambda s: maneuvers.maneuver_facts(s.matched, s.scene.scenarios, s.scene.map_adjacency),
    "future_links": lambda s: future.future_links(s.users),
    "future_coverage": lambda s: future.future_coverage(s.users),
    "future_positions": lambda s: s.futures,
    "coverage": lambda s: query.coverage(tally_of(s), catalog.definitions(s.spark)),
    "frame_coverage": lambda s: query.coverage(tally_of(s, tuple(FAMILIES)), catalog.definitions(s.spark)),
    "scenario_summaries": lambda s: query.scenario_summaries(s.scene.entities, s.scene.scenarios),
    "path_conflicts": lambda s: s.path_conflicts.select(*pairs.FRAME, "s_track", "o_track", "area", "cx", "cy", "s_arrival", "o_arrival"),
    "intents": lambda s: future.intents(s.path_conflicts, s.scene.frames),
    "assertions": lambda s: assertions_of(s),
    "signal_assertions": lambda s: assertions_of_categories(s, ("traffic_light", "motion_state")).select("scenario_token", "timestamp_us", "category", "predicate", "subject_id", "object_id"),
    "predicate_counts": lambda s: query.counts(tally_of(s), catalog.definitions(s.spark)),
    "frame_predicate_counts": lambda s: query.counts(tally_of(s, tuple(FAMILIES)), catalog.definitions(s.spark)),
    "truth_counts": lambda s: query.truth_counts(tally_of(s), catalog.definitions(s.spark)),
    "frame_truth_counts": lambda s: query.truth_counts(tally_of(s, tuple(FAMILIES)), catalog.definitions(s.spark)),
    "unknown_predicates": lambda s: query.unknown_predicates(entities.temporal_facts(s.history).withColumn("predicate", F.when(F.col("frame_index") % 10 == 3, F.concat("predicate", F.lit("Raw"))).otherwise(F.col("predicate"))), catalog.definitions(s.spark)),
    "pair_edges": lambda s: query.pair_edges(entities.states(spatial.with_spatial(s.footprints), pairs.PAIR, [F.col("contact_state"), F.col("sector")])),
    "semantic_edges": lambda s: query.semantic_edges(assertions_of(s, ("pairwise", "following", "crossing", "precedes")), query.pair_members(s.kinematic)),
    "collapsed_edges": lambda s: query.collapse(query.pair_edges(entities.states(spatial.with_spatial(s.footprints), pairs.PAIR, [F.col("contact_state"), F.col("sector")]).select(*pairs.FRAME, "s_track", "o_track", "predicate").unionByName(s.run_facts.select(*pairs.FRAME, "s_track", "o_track", "predicate")))),
    "scenarios_by_facts": lambda s: query.scenarios_by_facts(s.scene.scenarios, s.run_facts, ("crossesInFrontOf",)),
    "display_numbers": lambda s: query.display_numbers(s.scene.entities),
    "scenario_filter": lambda s: query.filter_scenarios(s.scene.scenarios, types=("crossing",), logs=("log0", "log1"), per_type=5),
    "interesting_agents": lambda s: query.interesting_agents(pairs.with_kinematics(pairs.ego_pairs(s.users))),
    "n_triples": lambda s: query.triples(assertions_of(s, ("structure", "pose", "precedes", "map_membership"))),
}


def _query(build: Callable[[Stages], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(build(Stages(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"way_{name}": _query(build) for name, build in BUILD.items()}

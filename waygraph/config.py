"""Thresholds of the predicates."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the predicate definitions, in SI units."""

    sample_interval_s: float = 0.5
    maximum_gap_factor: float = 1.5
    minimum_acceleration_samples: int = 3
    acceleration_window: int = 5
    stopped_speed: float = 0.3
    moving_speed: float = 0.8
    acceleration: float = 0.3
    forward_speed: float = 0.3
    side_band: float = 2.0
    longitudinal_deadband: float = 1.0
    lateral_deadband: float = 0.75
    front_lateral_base: float = 2.5
    front_lateral_ratio: float = 0.3
    colocated: float = 0.001
    direction_speed: float = 0.75
    direction_displacement: float = 0.4
    direction_agreement: float = 0.45
    map_motion_tolerance: float = 0.6
    same_flow: float = 0.45
    near: float = 5.0
    very_near: float = 2.0
    distance_epsilon: float = 0.001
    overlap_area: float = 0.0001
    aligned: float = 0.35
    opposite: float = 0.35
    follow_headway_s: float = 5.0
    follow_duration_s: float = 1.0
    follow_distance: float = 80.0
    queue_speed: float = 2.0
    queue_leader_speed: float = 4.0
    queue_gap: float = 12.0
    follow_reverse_speed: float = 0.3
    leader_tie: float = 0.5
    follow_hops: int = 3
    overtake_subject_speed: float = 2.0
    overtake_object_speed: float = 0.5
    overtake_relative_speed: float = 0.3
    overtake_clearance: float = 1.0
    overtake_same_flow: float = 0.55
    overtake_stable_frames: int = 2
    overtake_duration_s: float = 30.0
    overtake_radius: float = 80.0
    overtake_common_frames: int = 5
    overtake_behind_gap: float = 1.0
    overtake_side_lateral: float = 1.25
    overtake_same_flow_share: float = 0.8
    overtake_dedupe_s: float = 2.0
    maneuver_history_frames: int = 1
    maneuver_history_s: float = 0.5
    lane_change_speed: float = 0.1
    lane_change_hops: int = 5
    lane_change_onset_search_s: float = 6.0
    lane_change_lateral_onset: float = 0.15
    lane_change_center_bonus: float = 0.35
    lane_change_primary_bonus: float = 0.1
    lane_change_ambiguity_penalty: float = 0.05
    lane_change_unknown_gap: int = 3
    lane_change_lateral_speed_onset: float = 0.15
    lane_change_future_gain: float = 0.4
    lane_change_onset_frames: int = 2
    lane_change_source_frames: int = 1
    lane_change_complete_overlap: float = 0.6
    lane_change_single_overlap: float = 0.8
    lane_change_completion_frames: int = 2
    lane_side_polygon_distance: float = 1.5
    lane_side_least: float = 2.0
    lane_side_most: float = 6.5
    lane_side_turn: float = 0.3
    lane_side_lateral: float = 0.25
    merge_preexistence_s: float = 2.0
    merge_confirmation_s: float = 2.0
    merge_stable_frames: int = 2
    merge_gap: float = 40.0
    merge_headway_s: float = 5.0
    merge_hops: int = 6
    merge_same_flow: float = 0.55
    crossing_observations: int = 3
    crossing_displacement: float = 0.3
    crossing_common_s: float = 1.0
    crossing_pair_distance: float = 30.0
    crossing_ray: float = 10.0
    crossing_least_angle_deg: float = 25.0
    crossing_most_angle_deg: float = 155.0
    crossing_speed: float = 0.3
    crossing_margin_s: float = 0.25
    crossing_arrival_s: float = 6.0
    crossing_stationary_speed: float = 0.05
    crossing_map_radius: float = 12.0
    crossing_road_distance: float = 6.0
    crossing_crosswalk_distance: float = 5.0
    crossing_bicycle_road_distance: float = 3.0
    parked_speed: float = 0.5
    parked_duration_s: float = 2.0
    parked_displacement: float = 1.0
    parked_lane_distance: float = 1.5
    yield_before_s: float = 4.0
    yield_after_s: float = 4.0
    yield_eta_s: float = 2.5
    yield_baseline_speed: float = 1.0
    yield_speed_drop: float = 0.75
    yield_relative_drop: float = 0.15
    yield_conflict_distance: float = 18.0
    yield_proceed_speed: float = 0.8
    yield_proceed_distance: float = 1.5
    future_horizon_s: float = 6.0
    future_step_s: float = 0.5
    future_coverage: float = 0.75
    turn_angle: float = 0.35
    uturn_angle: float = 2.5
    stable_lane_frames: int = 2
    primary_overlap: float = 0.2
    primary_margin: float = 0.05
    primary_lateral_margin: float = 0.5
    fov_deg: float = 120.0
    fov_range: float = 80.0
    intent_duration_s: float = 1.0
    gap_increase: float = 2.0
    arrival_tolerance_s: float = 1.5
    risk_horizon_s: float = 2.0
    risk_closing_speed: float = 0.5
    risk_clearance: float = 0.5
    risk_vru_distance: float = 30.0
    risk_corridor_lateral: float = 2.5
    risk_corridor_center: float = 45.0
    risk_crossing_angle_deg: float = 25.0
    risk_crossing_distance: float = 40.0
    risk_braking: float = 5.0
    risk_target_deceleration: float = 3.0
    risk_gap_time_s: float = 1.0


@dataclass(frozen=True)
class Relevance:
    """Ranges and caps of the relevance decision."""

    hard_distance: float = 120.0
    most_agents: int = 14
    most_ordinary: int = 10
    lane_ahead: float = 100.0
    lane_behind: float = 35.0
    adjacent: float = 45.0
    connected: float = 70.0
    route_ahead: int = 3
    route_behind: int = 1
    free_space: float = 6.0
    vulnerable: float = 35.0
    static: float = 25.0
    cpa_horizon_s: float = 8.0
    cpa_clearance: float = 2.0
    critical_cpa_s: float = 4.0
    critical_clearance: float = 1.0
    shared_intersection: float = 55.0
    traffic_control: float = 45.0
    directional_ahead: float = 80.0
    directional_behind: float = 25.0
    directional_adjacent: float = 35.0
    directional_connected: float = 50.0
    ego_distance: float = 40.0
    ego_corridor_length: float = 70.0
    ego_corridor_half_width: float = 3.5
    ego_prediction_s: float = 5.0
    ego_path_clearance: float = 3.0
    grid_radius: float = 60.0
    most_neighbours: int = 10
    most_pairs: int = 150


T = Thresholds()
R = Relevance()

#: Markers of agent types, matched as parts of the upper-cased type.
STATIC = "STATIC|BARRIER|CZONE_SIGN|TRAFFIC_CONE|GENERIC_OBJECT"
DYNAMIC = "VEHICLE|CAR|TRUCK|BUS|MOTORCYCLE|BICYCLE|CYCLIST|PEDESTRIAN|EGO"
VEHICLE = "VEHICLE|CAR|TRUCK|BUS|MOTORCYCLE|BICYCLE|EGO"
VULNERABLE = "PEDESTRIAN|BICYCLE|CYCLIST"
LANE_USING = "VEHICLE|CAR|TRUCK|BUS|MOTORCYCLE|BICYCLE|EGO"

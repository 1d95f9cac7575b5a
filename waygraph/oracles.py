"""SQL over the tables for the rows of the queries."""

from __future__ import annotations

from waygraph import catalog
from waygraph.plans.scene import entities_sql, map_rows

E = f"with e as ({entities_sql()})"
CONTINUOUS = "coalesce(frame_index = last_frame_index + 1 and (timestamp_us - last_timestamp_us) / 1e6 > 0 and (timestamp_us - last_timestamp_us) / 1e6 <= 0.75, false)"
KEYS = "scenario_token, frame_index, timestamp_us, track_token"
PAIR = "scenario_token, frame_index, timestamp_us, tag, s_track, o_track"
WRAP = "(((({0}) + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi())"
ID = "case when is_ego then concat('ego:', scenario_token, ':', timestamp_us) else concat('agent:', scenario_token, ':', track_token, ':', timestamp_us) end"
MOVE = E + ", m as (select *, sqrt(vx * vx + vy * vy) as speed from e)"
HISTORY = MOVE + f""", l as (select *, {", ".join(f"lag({c}) over w as last_{c}" for c in ("frame_index", "timestamp_us", "x", "y", "heading", "speed"))}, lag({ID}) over w as last_id, {ID} as own_id
    from m window w as (partition by scenario_token, track_token order by frame_index)),
c as (select *, {CONTINUOUS} as ok from l),
i as (select *, sum(case when ok then 0 else 1 end) over (partition by scenario_token, track_token order by frame_index) as streak from c),
h as (select *, (timestamp_us - last_timestamp_us) / 1e6 as dt, sqrt((x - last_x) * (x - last_x) + (y - last_y) * (y - last_y)) as moved,
    row_number() over (partition by scenario_token, track_token order by frame_index) as n_all, (timestamp_us - first_value(timestamp_us) over (partition by scenario_token, track_token order by frame_index)) / 1e6 as t_all,
    row_number() over (partition by scenario_token, track_token, streak order by frame_index) as n_own, (timestamp_us - first_value(timestamp_us) over (partition by scenario_token, track_token, streak order by frame_index)) / 1e6 as t_own from i)"""
SIDES = ", ".join(f"{p}.{c} as {p}_{c.replace('track_token', 'track')}" for p in "so" for c in ("track_token", "slot", "is_ego", "agent_type", "x", "y", "heading", "cos_h", "sin_h", "vx", "vy", "length_m", "width_m"))
PAIRS = E + f""", q as (select s.scenario_token, s.frame_index, s.timestamp_us, {SIDES},
    case when s.is_ego then 'ego_to_agent' when o.is_ego then 'agent_to_ego' when s.slot < o.slot then 'agent_to_agent' else 'agent_to_agent_reverse' end as tag
    from e s join e o on s.scenario_token = o.scenario_token and s.frame_index = o.frame_index and s.slot <> o.slot),
k as (select *, o_x - s_x as dx, o_y - s_y as dy, o_vx - s_vx as dvx, o_vy - s_vy as dvy, sqrt((o_x - s_x) * (o_x - s_x) + (o_y - s_y) * (o_y - s_y)) as d,
    s_cos_h * (o_x - s_x) + s_sin_h * (o_y - s_y) as ahead, s_cos_h * (o_y - s_y) - s_sin_h * (o_x - s_x) as aside,
    (abs(s_cos_h) * s_length_m + abs(s_sin_h) * s_width_m) / 2 as shx, (abs(s_sin_h) * s_length_m + abs(s_cos_h) * s_width_m) / 2 as shy,
    (abs(o_cos_h) * o_length_m + abs(o_sin_h) * o_width_m) / 2 as ohx, (abs(o_sin_h) * o_length_m + abs(o_cos_h) * o_width_m) / 2 as ohy from q),
f as (select *, sqrt(power(greatest(0, abs(dx) - shx - ohx), 2) + power(greatest(0, abs(dy) - shy - ohy), 2)) as free,
    greatest(0, least(s_x + shx, o_x + ohx) - greatest(s_x - shx, o_x - ohx)) * greatest(0, least(s_y + shy, o_y + ohy) - greatest(s_y - shy, o_y - ohy)) as area,
    abs(o_cos_h * s_cos_h + o_sin_h * s_sin_h) as cd, abs(o_sin_h * s_cos_h - o_cos_h * s_sin_h) as sd from k),
g as (select *, (cd * o_length_m + sd * o_width_m) / 2 as hx, (sd * o_length_m + cd * o_width_m) / 2 as hy from f)"""


def _facts(prefix: str, source: str, keys: str, values: dict[str, str], column: str = "value", kind: str = "double") -> str:
    places = "round(cast({0} as double), 6)" if kind == "double" else "cast({0} as varchar)"
    parts = [f"select {keys}, '{p}' as predicate, {places.format(e)} as {column} from {source} where ({e}) is not null" for p, e in values.items()]
    return prefix + " " + " union all ".join(parts)


_KINEMATIC = {
    "hasCenterDistanceTo": "d",
    "hasLongitudinalDistanceTo": "ahead",
    "hasLateralDistanceTo": "aside",
    "hasBearingTo": "atan2(case when aside = 0 then 0.0 else aside end, ahead)",
    "hasHeadingDifferenceTo": f"abs({WRAP.format('o_heading - s_heading')})",
    "hasRelativeSpeedTo": "sqrt(dvx * dvx + dvy * dvy)",
    "hasLongitudinalRelativeSpeedTo": "s_cos_h * dvx + s_sin_h * dvy",
    "hasLateralRelativeSpeedTo": "s_cos_h * dvy - s_sin_h * dvx",
    "hasClosingSpeedTo": "case when d = 0 then 0.0 else -(dx * dvx + dy * dvy) / d end",
    "hasVelocityTowardTarget": "case when d = 0 then 0.0 else (s_vx * dx + s_vy * dy) / d end",
    "hasSubjectForwardSpeed": "s_cos_h * s_vx + s_sin_h * s_vy",
}
_CONTACT = "case when area > 0.0001 then 'overlapping' when free <= 0.001 then 'touching' when free <= 2 then 'veryNear' when free <= 5 then 'near' end"
_SECTOR = """case when area > 0.0001 or sqrt(ahead * ahead + aside * aside) <= 0.001 then null
    when abs(ahead) <= 2 then case when aside >= 0.75 then 'leftOf' when aside <= -0.75 then 'rightOf' when ahead >= 1 then 'inFrontOf' when ahead <= -1 then 'behind' end
    when ahead > 0 then case when abs(aside) <= 2.5 + 0.3 * abs(ahead) then 'inFrontOf' when aside > 0 then 'frontLeftOf' else 'frontRightOf' end
    else case when abs(aside) <= 2.5 + 0.3 * abs(ahead) then 'behind' when aside > 0 then 'rearLeftOf' else 'rearRightOf' end end"""
_SPEED = "case when agent_type = 'BARRIER' then null when speed <= 0.3 then 'isStopped' when speed <= 0.8 then 'isSlow' else 'isMoving' end"
_POSE = {"hasX": "x", "hasY": "y", "hasHeading": "heading", "hasRearAxleX": "case when is_ego then x - 1.461 * cos_h end", "hasRearAxleY": "case when is_ego then y - 1.461 * sin_h end", "hasLength": "length_m", "hasWidth": "width_m", "hasHeight": "height_m", "hasArea": "length_m * width_m"}
_BOXES = ", ".join(f"('{i}', '{kind}', {x0}, {y0}, {x1}, {y1})" for i, kind, x0, y0, x1, y1 in [(f"{p}{k}", n, a, 4.0 * k - 2, b, 4.0 * k + 2) for k in range(3) for p, n, a, b in (("A", "Lane", 0.0, 200.0), ("C", "LaneConnector", 200.0, 240.0), ("B", "Lane", 240.0, 700.0))] + [("C2R", "LaneConnector", 200.0, 6.0, 240.0, 10.0), ("X0", "Lane", 218.0, -80.0, 222.0, 60.0)])
_AREAS = "('I0', 'Intersection', 200.0, -2.0, 240.0, 10.0), ('W0', 'Crosswalk', 190.0, -4.0, 194.0, 14.0)"


def _membership(boxes: str) -> str:
    return (
        E
        + f""", b(object_id, kind, x0, y0, x1, y1) as (values {boxes}),
j as (select e.*, b.*, (abs(cos_h) * length_m + abs(sin_h) * width_m) / 2 as hx, (abs(sin_h) * length_m + abs(cos_h) * width_m) / 2 as hy from e, b),
a as (select *, greatest(0, least(x + hx, x1) - greatest(x - hx, x0)) * greatest(0, least(y + hy, y1) - greatest(y - hy, y0)) as area from j)
select {KEYS}, object_id, concat('in', kind) as predicate from a where x between x0 and x1 and y between y0 and y1
union all select {KEYS}, object_id, concat('intersects', kind) from a where area > 0.0001"""
    )


_SCENARIO = E + ", s as (select scenario_token, concat('log', cast(cast(substring(scenario_token, 3) as bigint) % 3 as varchar)) as log_name, case when cast(substring(scenario_token, 3) as bigint) % 2 = 0 then 'following' else 'crossing' end as scenario_type, 'm0' as map_name, count(*) as n_frames from e where is_ego group by scenario_token)"

SQL: dict[str, str] = {
    "closing_speed_of_ego_pairs": _facts(PAIRS, "(select * from k where s_is_ego or o_is_ego) z", PAIR, {"hasClosingSpeedTo": _KINEMATIC["hasClosingSpeedTo"]}),
    "scenes": E + " select " + "scenario_token, frame_index, timestamp_us, track_token, slot, is_ego, agent_type, " + ", ".join(f"round({c}, 6) as {c}" for c in ("x", "y", "heading", "cos_h", "sin_h", "vx", "vy", "length_m", "width_m", "height_m", "ax", "ay")) + " from e",
    "structure_facts": _facts(_SCENARIO + ", z as (select e.*, scenario_type, log_name from e join s using (scenario_token))", "z", KEYS, {"hasTimestamp": "case when is_ego then timestamp_us end", "hasScenarioType": "case when is_ego and frame_index = 0 then scenario_type end", "hasLogName": "case when is_ego and frame_index = 0 then log_name end", "hasEgoState": f"case when is_ego then {ID} end", "hasTrackedObject": f"case when not is_ego then {ID} end", "hasTrackToken": "case when not is_ego then track_token end", "hasAgentType": "case when not is_ego then agent_type end"}, "object", "text"),
    "pose_facts": _facts(E, "e", KEYS, _POSE),
    "motion_facts": _facts(MOVE, "m", KEYS, {"hasVelocityX": "vx", "hasVelocityY": "vy", "hasSpeed": "speed", "hasVelocityHeading": f"case when speed >= 0.75 then {WRAP.format('atan2(vy, vx)')} end", "hasAccelerationX": "ax", "hasAccelerationY": "ay", "hasAcceleration": "sqrt(ax * ax + ay * ay)"}),
    "velocity_vectors": E + f" select {KEYS}, 'hasVelocity' as predicate, round(vx, 6) as vx, round(vy, 6) as vy from e",
    "speed_states": MOVE + f" select {KEYS}, {_SPEED} as predicate from m where {_SPEED} is not null",
    "temporal_facts": _facts(HISTORY, "h", KEYS, {"hasDeltaTimeFromPrevious": "case when ok then dt end", "hasDisplacementFromPrevious": "case when ok then moved end", "hasHeadingChangeFromPrevious": f"case when ok then {WRAP.format('heading - last_heading')} end", "hasDisplacementHeading": f"case when ok and moved >= 0.4 then {WRAP.format('atan2(y - last_y, x - last_x)')} end", "hasSpeedChangeFromPrevious": "case when ok then speed - last_speed end", "hasEstimatedAcceleration": "case when ok then (speed - last_speed) / dt end", "hasObservedFrameCount": "n_own", "hasObservedDuration": "t_own", "hasTotalObservedFrameCount": "n_all", "hasTotalObservedSpan": "t_all", "hasContinuousObservedFrameCount": "n_own", "hasContinuousObservedDuration": "t_own"}),
    "precedes": HISTORY + f" select {KEYS}, 'precedes' as predicate, last_id as subject_id, own_id as object_id from h where ok",
    "continuity_breaks": HISTORY + f" select {KEYS}, last_frame_index, last_timestamp_us from h where last_frame_index is not null and not ok",
    "motion_states": HISTORY + f""", r as (select *, list_sort(list_filter(list(case when ok then (speed - last_speed) / dt end) over (partition by scenario_token, track_token, streak order by frame_index rows between 4 preceding and current row), lambda v: v is not null)) as recent from h),
    z as (select *, case when len(recent) >= 3 then (recent[cast(floor((len(recent) + 1) / 2) as int)] + recent[cast(floor(len(recent) / 2) as int) + 1]) / 2 end as robust from r)
    select {KEYS}, {_SPEED} as predicate from z where {_SPEED} is not null union all select {KEYS}, case when robust >= 0.3 then 'isAccelerating' else 'isDecelerating' end from z where robust >= 0.3 or robust <= -0.3""",
    "pair_kinematics": _facts(PAIRS, "k", PAIR, _KINEMATIC),
    "pair_footprints": _facts(PAIRS, "g", PAIR, {"hasFreeSpaceDistanceTo": "free", "hasIntersectionArea": "area", "hasLongitudinalFootprintGap": "case when ahead >= 0 then ahead - hx - s_length_m / 2 else ahead + hx + s_length_m / 2 end", "hasLateralFootprintGap": "case when aside >= 0 then aside - hy - s_width_m / 2 else aside + hy + s_width_m / 2 end"}),
    "pair_history": _facts(PAIRS + f""", l as (select *, lag(frame_index) over w as last_frame_index, lag(timestamp_us) over w as last_timestamp_us, lag(d) over w as last_d, lag(free) over w as last_free from g window w as (partition by scenario_token, s_track, o_track, tag order by frame_index)),
    c as (select *, {CONTINUOUS} as ok from l), i as (select *, sum(case when ok then 0 else 1 end) over (partition by scenario_token, s_track, o_track, tag order by frame_index) as streak from c),
    z as (select *, row_number() over (partition by scenario_token, s_track, o_track, tag, streak order by frame_index) as n_own, (timestamp_us - first_value(timestamp_us) over (partition by scenario_token, s_track, o_track, tag, streak order by frame_index)) / 1e6 as t_own from i)""", "z", PAIR, {"hasPairObservedFrameCount": "n_own", "hasPairObservedDuration": "t_own", "hasCenterDistanceChangeFromPrevious": "case when ok then d - last_d end", "hasFreeSpaceDistanceChangeFromPrevious": "case when ok then free - last_free end"}),
    "near_agent_pairs": PAIRS + f" select scenario_token, frame_index, timestamp_us, 'agent_to_agent' as tag, s_track, o_track from k where not s_is_ego and not o_is_ego and s_slot < o_slot and dx * dx + dy * dy <= 3600",
    "body_sectors": PAIRS + f" select {PAIR}, {_SECTOR} as predicate from g where {_SECTOR} is not null",
    "contact_states": PAIRS + f" select {PAIR}, {_CONTACT} as predicate from g where {_CONTACT} is not null",
    "map_memberships": _membership(_BOXES),
    "area_memberships": _membership(_AREAS),
    "future_links": E + f" select a.scenario_token, a.frame_index, a.timestamp_us, a.track_token, b.frame_index as later_frame, b.timestamp_us as later_us from e a join e b on a.scenario_token = b.scenario_token and a.track_token = b.track_token and b.timestamp_us > a.timestamp_us and b.timestamp_us <= a.timestamp_us + 6000000",
    "display_numbers": E + ", d as (select scenario_token, track_token, min(frame_index) as first_frame, min(slot) as slot from e where not is_ego group by all) select scenario_token, track_token, first_frame, cast(dense_rank() over (partition by scenario_token order by first_frame, slot) as int) as display_id from d",
    "scenario_filter": _SCENARIO + " select scenario_token, log_name, scenario_type, map_name, n_frames from (select *, row_number() over (partition by scenario_type order by scenario_token) as place from s where scenario_type = 'crossing' and log_name in ('log0', 'log1')) where place <= 5",
    "signal_facts": _SCENARIO + """, f as (select scenario_token, frame_index, timestamp_us, cast(substring(scenario_token, 3) as bigint) as n from e where is_ego),
    l as (select scenario_token, frame_index, timestamp_us, c as connector_id, case (cast(floor(frame_index / 10) as bigint) + n) % 3 when 0 then 'GREEN' when 1 then 'YELLOW' else 'RED' end as state from f, (values ('C0'), ('C1'), ('C2')) v(c)),
    z as (select scenario_token, frame_index, timestamp_us, connector_id, case when connector_id = 'C2' and frame_index % 25 = 0 then 'UNKNOWN' else state end as state, concat('traffic_signal:m0:control:', connector_id) as signal_id from l)
    select scenario_token, frame_index, timestamp_us, signal_id, 'controls' as predicate, concat('controlled_movement:', connector_id) as object from z union all select scenario_token, frame_index, timestamp_us, signal_id, 'hasSignalState', concat('signal_state:', state) from z""",
}
SQL["pair_edges"] = f"select scenario_token, frame_index, timestamp_us, s_track, o_track, string_agg(predicate, ',' order by predicate) as predicates, count(distinct predicate) as n_predicates from ({SQL['body_sectors']} union all select * from ({SQL['contact_states']})) group by all"
SQL["closest_approach"] = PAIRS + f""", v as (select *, dvx * dvx + dvy * dvy as vv, dx * dvx + dy * dvy as rv from k), z as (select *, case when vv <= 1e-9 then 0.0 else greatest(0.0, least(8.0, -rv / vv)) end as ct from v),
    y as (select *, sqrt((dx + dvx * ct) * (dx + dvx * ct) + (dy + dvy * ct) * (dy + dvy * ct)) as cd2 from z)
    select {PAIR}, round(cast(ct as double), 6) as cpa_time_s, round(cd2, 6) as cpa_distance, round(cd2 - sqrt(s_length_m * s_length_m + s_width_m * s_width_m) / 2 - sqrt(o_length_m * o_length_m + o_width_m * o_width_m) / 2, 6) as cpa_clearance, rv < 0 as cpa_closing from y"""
SQL = {f"way_{name}": text for name, text in SQL.items()}


def _lanes() -> str:
    """The map's lanes and connectors as rows of VALUES."""
    objects, edges, adjacent = map_rows()
    text = lambda v: "null" if v is None else f"'{v}'"
    many = lambda v: "[" + ", ".join(f"'{x}'" for x in sorted(v)) + "]::varchar[]"
    rows = []
    for name, kind, polygon, line, length, limit, block, crossing in objects:
        if kind in ("lane", "lane_connector"):
            xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
            lists = ([b for a, b in edges if a == name], [a for a, b in edges if b == name], *([b for a, s, b in adjacent if a == name and s == side] for side in ("left", "right")))
            rows.append(f"('{name}', '{kind}', {min(xs)}, {min(ys)}, {max(xs)}, {max(ys)}, {line[0][0] == line[1][0]}, {length}, {limit}, {text(block)}, {text(crossing)}, {', '.join(map(many, lists))})")
    return ", ".join(rows)


_ON = lambda x0, y0, x1, y1: f"(x between {x0} and {x1} and y between {y0} and {y1} or greatest(0, least(x + (abs(cos_h) * length_m + abs(sin_h) * width_m) / 2, {x1}) - greatest(x - (abs(cos_h) * length_m + abs(sin_h) * width_m) / 2, {x0})) * greatest(0, least(y + (abs(sin_h) * length_m + abs(cos_h) * width_m) / 2, {y1}) - greatest(y - (abs(sin_h) * length_m + abs(cos_h) * width_m) / 2, {y0})) > 0.0001)"
DIFF = f"abs({WRAP.format('({0}) - ({1})')})"
MATCHED = HISTORY + f""", o(object_id, kind, x0, y0, x1, y1, upright, len, lim, block, crossing, outs, ins, lefts, rights) as (values {_lanes()}),
    c0 as (select h.*, o.*, (abs(cos_h) * length_m + abs(sin_h) * width_m) / 2 as hx, (abs(sin_h) * length_m + abs(cos_h) * width_m) / 2 as hy from h, o),
    c1 as (select *, greatest(0, least(x + hx, x1) - greatest(x - hx, x0)) * greatest(0, least(y + hy, y1) - greatest(y - hy, y0)) as area, x between x0 and x1 and y between y0 and y1 as covered,
        case when upright then least(greatest(y - y0, 0), len) else least(greatest(x - x0, 0), len) end as progress, case when upright then (x0 + x1) / 2 - x else y - (y0 + y1) / 2 end as lat, case when upright then pi() / 2 else 0.0 end as way from c0),
    c2 as (select *, least(1.0, area / greatest(length_m * width_m, 1e-12)) as ratio from c1 where covered or area > 0),
    p0 as (select *, row_number() over w as place, lead(covered) over w as n_covered, lead(ratio) over w as n_ratio, lead(lat) over w as n_lat from c2 where covered or ratio >= 0.2
        window w as (partition by scenario_token, frame_index, track_token order by covered desc, round(ratio, 9) desc, abs(lat) asc nulls last, (kind = 'lane') desc, object_id desc)),
    p1 as (select *, case when n_covered is null then 'single' when covered <> n_covered then 'center' when ratio - n_ratio >= 0.05 then 'overlap' when abs(lat) + 0.5 < abs(n_lat) then 'lateral' else 'ambiguous' end as reason from p0 where place = 1),
    pr as (select scenario_token, frame_index, timestamp_us, track_token, reason = 'ambiguous' as ambiguous, reason as match_reason, {", ".join(f"case when reason <> 'ambiguous' then {a} end as {b}" for a, b in (("object_id", "primary_id"), ("kind", "primary_kind"), ("ratio", "overlap_ratio"), ("progress", "progress"), ("lat", "lateral_offset"), ("way", "map_heading"), ("0.0", "curvature")))} from p1),
    m0 as (select h.*, coalesce(pr.ambiguous, false) as ambiguous, match_reason, primary_id, primary_kind, overlap_ratio, progress, lateral_offset, map_heading, curvature, len, lim, block, crossing,
        coalesce(outs, []) as outs, coalesce(ins, []) as ins, coalesce(lefts, []) as lefts, coalesce(rights, []) as rights, case block when 'RA' then 0 when 'RC' then 1 when 'RB' then 2 end as route_rank,
        case when speed >= 0.75 then {WRAP.format("atan2(vy, vx)")} end as velocity, case when ok and moved >= 0.4 then {WRAP.format("atan2(y - last_y, x - last_x)")} end as displaced
        from h left join pr using (scenario_token, frame_index, track_token) left join o on o.object_id = pr.primary_id),
    m1 as (select *, case when velocity is not null and displaced is not null then case when sqrt(power(cos(velocity) + cos(displaced), 2) + power(sin(velocity) + sin(displaced), 2)) <= 1e-12 then {WRAP.format("velocity")}
        else {WRAP.format("atan2(sin(velocity) + sin(displaced), cos(velocity) + cos(displaced))")} end else coalesce(velocity, displaced) end as motion,
        case when velocity is not null and displaced is not null then 'velocity_and_displacement' when velocity is not null then 'velocity' when displaced is not null then 'temporal_displacement' end as source from m0),
    m2 as (select *, case when coalesce({DIFF.format("velocity", "displaced")} > 0.45, false) or coalesce({DIFF.format("map_heading", "motion")} > 0.6, false) or map_heading is null and motion is null then 'unreliable'
        when map_heading is not null and motion is not null then concat('map_confirmed_by_', source) when map_heading is not null then 'map_low_speed' else source end as travel_source from m1),
    mt as (select *, case when travel_source <> 'unreliable' then coalesce(map_heading, motion) end as travel_heading, list_filter(['C0', 'C1', 'C2'], lambda z: z = primary_id or list_contains(outs, z)) as controls,
        list_filter([crossing, case when {_ON(200.0, -2.0, 240.0, 10.0)} then 'I0' end], lambda z: z is not null) as inters, {_ON(190.0, -4.0, 194.0, 14.0)} as walk from m2)"""
_MAP = {"hasPrimaryMapOverlapRatio": "overlap_ratio", "hasBaselineProgress": "progress", "hasBaselineLateralOffset": "lateral_offset", "hasMapHeading": "map_heading", "hasMapSpeedLimit": "lim", "hasBaselineCurvature": "curvature", "hasRouteRoadblockRank": "route_rank", "hasEffectiveTravelHeading": "travel_heading"}
_RELATIONS = {
    "hasPrimaryLane": "case when primary_kind = 'lane' then concat('lane:', primary_id) end",
    "hasPrimaryLaneConnector": "case when primary_kind = 'lane_connector' then concat('lane_connector:', primary_id) end",
    "hasParentRoadblock": "case when primary_kind = 'lane' and block is not null then concat('roadblock:', block) end",
    "hasParentRoadblockConnector": "case when primary_kind = 'lane_connector' and block is not null then concat('roadblock_connector:', block) end",
    "hasPrimaryMapIntersection": "case when crossing is not null then concat('intersection:', crossing) end",
    "hasAmbiguousMapMatch": "case when ambiguous then 'true' end",
    "onExpertRoute": "case when route_rank is not null then concat('roadblock:', block) end",
    "hasTravelDirectionSource": "case when travel_source <> 'unreliable' then travel_source end",
}
_OWN = ("ambiguous", "primary_id", "primary_kind", "progress", "lateral_offset", "map_heading", "len", "outs", "ins", "lefts", "rights", "route_rank", "inters", "walk", "travel_heading", "speed", "controls")
#: Pairs with footprints (as in PAIRS) and the map columns of both sides.
TOPOLOGY = MATCHED + PAIRS[len(E) :].replace(", q as", ", q as").replace(" l as ", " l9 as ") + f""",
    t0 as (select g.*, {", ".join(f"{p}m.{c} as {p}_{c}" for p in "so" for c in _OWN)} from g join mt sm on g.scenario_token = sm.scenario_token and g.frame_index = sm.frame_index and g.s_track = sm.track_token join mt om on g.scenario_token = om.scenario_token and g.frame_index = om.frame_index and g.o_track = om.track_token),
    t1 as (select *, case when s_ambiguous or o_ambiguous then 'ambiguous' when s_primary_id is null or o_primary_id is null then 'unrelated' when s_primary_id = o_primary_id and s_primary_kind = o_primary_kind then 'same_map'
        when list_contains(s_lefts, o_primary_id) then 'adjacent_left' when list_contains(o_rights, s_primary_id) and not list_contains(s_rights, o_primary_id) then 'adjacent_left' when list_contains(s_rights, o_primary_id) or list_contains(o_lefts, s_primary_id) then 'adjacent_right'
        when list_contains(s_outs, o_primary_id) or list_contains(o_ins, s_primary_id) then 'successor' when list_contains(s_ins, o_primary_id) or list_contains(o_outs, s_primary_id) then 'predecessor' else 'unrelated' end as rel from t0),
    t2 as (select *, case rel when 'same_map' then o_progress - s_progress when 'successor' then greatest(0, s_len - s_progress) + greatest(0, o_progress) when 'predecessor' then -(greatest(0, o_len - o_progress) + greatest(0, s_progress)) end as path,
        {DIFF.format("s_travel_heading", "o_travel_heading")} as turn, cos(s_travel_heading) * dx + sin(s_travel_heading) * dy as t_ahead, cos(s_travel_heading) * dy - sin(s_travel_heading) * dx as t_aside from t1),
    tp as (select *, coalesce(path, case when rel in ('adjacent_left', 'adjacent_right') then dx * cos(s_map_heading) + dy * sin(s_map_heading) end) as ref, coalesce(turn <= 0.45, false) as flow, coalesce(list_has_any(s_inters, o_inters), false) as shared,
        coalesce(rel = 'same_map' and s_primary_kind = 'lane', false) as same_lane, list_has_any(s_controls, o_controls) as control from t2)"""
_CPA = "case when vv <= 1e-9 then 0.0 else greatest(0.0, least({0}, -rv / vv)) end"
_RULES = (
    ("immediate_proximity", 95, "free <= 6", "100 - least(50, free * 5)"),
    ("same_lane_ahead", 75, "rel = 'same_map' and flow and ref > 0 and ref <= 100", "70 + greatest(0, 30 * (1 - ref / 100))"),
    ("same_lane_behind", 55, "rel = 'same_map' and flow and ref < 0 and ref >= -35", "45 + greatest(0, 20 * (1 - abs(ref) / 35))"),
    ("adjacent_left", 50, "rel = 'adjacent_left' and flow and d <= 45", "45 + greatest(0, 20 * (1 - d / 45))"),
    ("adjacent_right", 50, "rel = 'adjacent_right' and flow and d <= 45", "45 + greatest(0, 20 * (1 - d / 45))"),
    ("connected_successor", 70, "rel = 'successor' and flow and d <= 70", "55 + greatest(0, 15 * (1 - d / 70))"),
    ("connected_predecessor", 65, "rel = 'predecessor' and flow and d <= 70", "55 + greatest(0, 15 * (1 - d / 70))"),
    ("ego_route_corridor", 40, "s_is_ego and (step between 0 and 3 and d <= 100 or step = -1 and d <= 35)", "35 - 5 * abs(step)"),
    ("shared_intersection_conflict", 80, "shared and d <= 55", "65 + greatest(0, 20 * (1 - d / 55))"),
    ("shared_traffic_control", 60, "control and d <= 45", "55"),
    ("vulnerable_road_user_near_ego_path", 90, "o_agent_type in ('PEDESTRIAN', 'BICYCLE') and d <= 35 and (o_route_rank is not null or o_walk or shared or control or coalesce(free <= 6, false))", "90"),
    ("static_obstacle_on_ego_path", 85, "o_agent_type = 'BARRIER' and d <= 25 and (o_route_rank is not null or coalesce(free <= 6, false))", "80"),
    ("predicted_close_approach", 100, "rv < 0 and clear8 <= 2", "95 - least(40, ct8 * 5)"),
    ("generator_within_distance", 110, "s_is_ego and d <= 40", "0"),
    ("generator_forward_corridor", 105, "s_is_ego and t_ahead between 0 and 70 and abs(t_aside) <= 3.5", "0"),
    ("generator_same_lane", 100, "s_is_ego and rel = 'same_map' and flow", "0"),
    ("generator_predicted_path_intersection", 115, "s_is_ego and clear5 <= 3 and (rv < 0 or ct5 <= 1e-9)", "0"),
)
_HALVES = "sqrt(s_length_m * s_length_m + s_width_m * s_width_m) / 2 + sqrt(o_length_m * o_length_m + o_width_m * o_width_m) / 2"
SCORED = TOPOLOGY + f""",
    v0 as (select *, dvx * dvx + dvy * dvy as vv, dx * dvx + dy * dvy as rv, o_route_rank - s_route_rank as step from tp), v1 as (select *, {_CPA.format("8.0")} as ct8, {_CPA.format("5.0")} as ct5 from v0),
    v2 as (select *, sqrt(power(dx + dvx * ct8, 2) + power(dy + dvy * ct8, 2)) - ({_HALVES}) as clear8, sqrt(power(dx + dvx * ct5, 2) + power(dy + dvy * ct5, 2)) - ({_HALVES}) as clear5 from v1),
    v3 as (select *, {", ".join(f"d <= 120 and coalesce({cond}, false) as r{i}" for i, (_, _, cond, _) in enumerate(_RULES))} from v2),
    v4 as (select *, {" + ".join(f"case when r{i} then {points} else 0 end" for i, (*_, points) in enumerate(_RULES))} as score, list_filter([{", ".join(f"case when r{i} then '{name}' end" for i, (name, *_) in enumerate(_RULES))}], lambda z: z is not null) as held,
        coalesce(r0 and free <= 1 or r10 and d <= 12 or r12 and ct8 <= 4 and clear8 <= 1, false) as critical, r13 or r14 or r15 or r16 as mandatory,
        list_max(list_filter([{", ".join(f"case when r{i} then {rank * 1000 - i} end" for i, (_, rank, *_) in enumerate(_RULES))}], lambda z: z is not null)) as top from v3),
    v5 as (select *, len(held) > 0 as relevant, list_sort(held) as reasons, case when d > 120 then 'outside_hard_range' when len(held) = 0 then 'not_relevant' else case top {" ".join(f"when {rank * 1000 - i} then '{name}'" for i, (name, rank, *_) in enumerate(_RULES))} end end as primary_reason,
        case when o_route_rank is null then 'off_or_unknown_route' when s_route_rank is null then 'object_on_route' when step = 0 then 'same_route_roadblock' when step > 0 then concat('route_ahead_', step) else concat('route_behind_', -step) end as route_relation from v4),
    v6 as (select *, case when d > 120 then 'outside_hard_range' when not relevant then 'pair_not_relevant' when not flow then 'cross_or_opposite_flow'
        when rel = 'same_map' and ref is not null then case when not (ref between -25 and 80 and abs(ref) > 1e-6) then 'same_lane_outside_directional_range' end
        when rel in ('adjacent_left', 'adjacent_right') then case when d > 35 then 'adjacent_lane_outside_directional_range' end
        when rel in ('successor', 'predecessor') then case when d > 50 then 'connected_lane_outside_directional_range' end else 'no_common_lane_path_frame' end as omission from v5),
    sc as (select *, omission is null as directional, s_agent_type <> 'BARRIER' and o_agent_type <> 'BARRIER' as dynamic, {_SECTOR} as sector, {_CONTACT} as contact, case when turn <= 0.35 then 'alignedWith' when abs(pi() - turn) <= 0.35 then 'oppositeDirectionTo' end as heading_state from v6),
    w0 as (select *, mandatory or critical as kept from sc where s_is_ego and relevant),
    w1 as (select *, sum(case when kept then 1 else 0 end) over (partition by scenario_token, frame_index) as n_kept, row_number() over (partition by scenario_token, frame_index, kept order by score desc, d asc nulls last, o_track) as place from w0),
    ch as (select * from w1 where kept or place <= least(10, greatest(0, 14 - n_kept)))"""
_SIGNALS = ", f9 as" + SQL["way_signal_facts"].split(", f as", 1)[1].split(" select scenario_token, frame_index, timestamp_us, signal_id, 'controls'")[0].replace("from f,", "from f9,").replace("l as (", "l9 as (").replace("from l)", "from l9)").replace("z as (", "z9 as (")
_NEW = {
    "primary_lanes": MATCHED + " select scenario_token, frame_index, timestamp_us, track_token, ambiguous, match_reason, primary_id, primary_kind, " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in ("overlap_ratio", "progress", "lateral_offset", "map_heading", "curvature")) + " from pr",
    "map_facts": _facts(MATCHED, "mt", KEYS, _MAP),
    "map_relations": _facts(MATCHED, "mt", KEYS, _RELATIONS, "object", "text"),
    "pair_topology": TOPOLOGY + f" select {PAIR}, rel as map_relation, round(cast(path as double), 6) as path_distance, round(cast(case when rel = 'same_map' then o_progress - s_progress end as double), 6) as progress_difference, round(turn, 6) as travel_difference, round(t_ahead, 6) as travel_longitudinal, round(t_aside, 6) as travel_lateral, flow as same_flow, same_lane, shared as shared_intersection from tp",
    "relevance_facts": SCORED + f" select {PAIR}, case when s_is_ego then 'isRelevantToEgo' else 'isRelevantPair' end as predicate, round(cast(score as double), 6) as score, primary_reason, route_relation, unnest(reasons) as reason from sc where relevant",
    "relevance_audit": SCORED + f" select {', '.join('sc.' + c for c in PAIR.split(', '))}, ch.s_track is not null as selected, sc.relevant, sc.critical, sc.mandatory, round(cast(sc.score as double), 6) as score, sc.primary_reason, array_to_string(sc.reasons, '|') as reasons, sc.directional, sc.omission as direction_omission from sc left join ch on sc.scenario_token = ch.scenario_token and sc.frame_index = ch.frame_index and sc.s_track = ch.s_track and sc.o_track = ch.o_track where sc.s_is_ego",
    "reverse_pairs": SCORED + f" select {', '.join('sc.' + c for c in PAIR.split(', '))}, ch.mandatory, sc.critical, round(cast(sc.score as double), 6) as score, case when len(sc.held) = 0 then 'reverse_of_selected_pair' else sc.primary_reason end as primary_reason, array_to_string(list_sort(list_append(sc.held, 'reverse_of_selected_pair')), '|') as reasons from sc join ch on sc.scenario_token = ch.scenario_token and sc.frame_index = ch.frame_index and sc.s_track = ch.o_track and sc.o_track = ch.s_track",
    "relevant_ego_pairs": SCORED + f" select {PAIR}, round(cast(score as double), 6) as score, primary_reason from ch",
    "spatial_facts": SCORED + f" select {PAIR}, sector as predicate from sc where dynamic and directional and sector is not null union all select {PAIR}, contact from sc where contact is not null union all select {PAIR}, heading_state from sc where heading_state is not null",
    "sector_omissions": SCORED + " select reason, count(*) as n from (select case when not dynamic then 'non_dynamic_road_user' when not directional then omission when sector is null then 'body_frame_inside_deadband_or_overlap' end as reason from sc) where reason is not null group by reason",
    "relevant_signals": MATCHED + _SIGNALS + f""", u as (select * from mt where agent_type not in ('PEDESTRIAN', 'BARRIER')), a9 as (select {', '.join('u.' + c for c in KEYS.split(', '))}, signal_id from u join z9 on u.scenario_token = z9.scenario_token and u.frame_index = z9.frame_index and list_contains(u.outs, z9.connector_id) where u.primary_kind = 'lane'),
        on9 as (select distinct c2.scenario_token, c2.frame_index, c2.track_token from c2 where object_id in ('C0', 'C1', 'C2') and (covered or area > 0.0001)), n9 as (select {KEYS}, min(signal_id) as signal_id from a9 group by all having count(*) = 1)
        select {KEYS}, 'isRelevantSignal' as predicate, signal_id from n9 anti join on9 using (scenario_token, frame_index, track_token)""",
    "pair_identity": PAIRS + f""", z as (select *, concat('pair:', scenario_token, ':', timestamp_us, ':', tag, ':', substring(sha256(concat(scenario_token, '|', timestamp_us, '|', tag, '|', s_track, '|', o_track)), 1, 24)) as pair_id from k)
        select {PAIR}, pair_id, 'hasPairwiseState' as predicate, pair_id as object from z union all select {PAIR}, pair_id, 'pairSubject', s_track from z union all select {PAIR}, pair_id, 'pairObject', o_track from z""",
    "interesting_agents": PAIRS + ", z as (select scenario_token, o_track, d, " + f"list_min([{', '.join(f'sqrt(power(dx + dvx * {i / 2}, 2) + power(dy + dvy * {i / 2}, 2))' for i in range(11))}]) - (sqrt(s_length_m * s_length_m + s_width_m * s_width_m) + sqrt(o_length_m * o_length_m + o_width_m * o_width_m)) / 2 as least, ahead, aside from k where s_is_ego) select scenario_token, o_track, count(*) as n_frames, round(min(d), 6) as least_distance from z where d <= 40 or ahead between 0 and 70 and abs(aside) <= 3.5 or least <= 3 group by all",
    "future_positions": E + f""", t as (select {KEYS}, list({{'t': timestamp_us, 'x': x, 'y': y, 'h': heading}}) over (partition by scenario_token, track_token order by timestamp_us range between current row and 6750000 following) as seen from e),
        i as (select *, unnest(range(1, 13)) as sample from t), j as (select *, timestamp_us + sample * 500000 as at_us from i), k as (select *, list_filter(seen, lambda v: v.t <= at_us)[-1] as a, list_filter(seen, lambda v: v.t >= at_us)[1] as b from j),
        l as (select *, case when b.t = a.t then 0.0 else (at_us - a.t) / (b.t - a.t) end as share from k where b.t - a.t <= 750000)
        select {KEYS}, cast(sample as int) as sample, at_us, round(a.x + share * (b.x - a.x), 6) as x, round(a.y + share * (b.y - a.y), 6) as y, round({WRAP.format("a.h + share * " + WRAP.format("b.h - a.h"))}, 6) as heading from l""",
    "scenario_summaries": _SCENARIO + " select scenario_token, scenario_type, n_frames, count(distinct track_token) as n_tracks, count(*) as n_states, round((max(timestamp_us) - min(timestamp_us)) / 1e6, 6) as seconds, round(avg(sqrt(vx * vx + vy * vy)), 6) as mean_speed, round(count(*) / nullif((max(timestamp_us) - min(timestamp_us)) / 1e6, 0), 6) as states_per_second from e join s using (scenario_token) group by scenario_token, scenario_type, n_frames",
    "future_coverage": E + f""", t as (select {KEYS}, list(timestamp_us) over (partition by scenario_token, track_token order by timestamp_us range between current row and 6750000 following) as times from e),
        a as (select *, list_filter(range(1, 13), lambda i: coalesce(list_min(list_filter(times, lambda v: v >= timestamp_us + i * 500000)) - list_max(list_filter(times, lambda v: v <= timestamp_us + i * 500000)) <= 750000 and list_max(list_filter(times, lambda v: v <= timestamp_us + i * 500000)) > timestamp_us + i * 500000 - 750000 and list_min(list_filter(times, lambda v: v >= timestamp_us + i * 500000)) < timestamp_us + i * 500000 + 750000, false)) as held from t)
        select {KEYS}, len(held) as samples, len(held) * 0.5::double as duration_s, round(len(held) / 12, 6) as coverage, len(held) / 12 < 0.75 as insufficient from a""",
    "track_pairs": E + """, b as (select scenario_token, track_token, agent_type, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from e where agent_type <> 'BARRIER' group by all having count(*) >= 3 and (agent_type not in ('PEDESTRIAN', 'BICYCLE') or sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) >= 0.3))
        select a.scenario_token, a.track_token as s_track, b.track_token as o_track from b a join b on a.scenario_token = b.scenario_token and a.track_token <> b.track_token where not (a.agent_type = 'PEDESTRIAN' and b.agent_type = 'PEDESTRIAN') and sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) <= 30""",
}
SQL |= {f"way_{name}": text for name, text in _NEW.items()}


def _paths(hops: int = 3) -> str:
    """Unbranched ways (src, dst, offset of dst's start from src's) as rows of VALUES."""
    objects, edges, _ = map_rows()
    length = {name: size for name, kind, _, _, size, *_ in objects if kind in ("lane", "lane_connector")}
    rows = []
    for src in length:
        at, offset = src, 0.0
        rows.append(f"('{src}', '{src}', 0.0)")
        for _ in range(hops):
            ways = [b for a, b in edges if a == at]
            if len(ways) != 1:
                break
            at, offset = ways[0], offset + length[at]
            rows.append(f"('{src}', '{at}', {offset})")
    return ", ".join(rows)


def _streaks(rows: str, key: str, name: str = "st") -> str:
    """CTEs that give rows (a CTE) start_us and duration_s of their run of consecutive frames."""
    return f""", {name}p as (select scenario_token, frame_index, sum(step) over (partition by scenario_token order by frame_index) as part from (select *, case when frame_index = lag(frame_index) over w + 1 and (timestamp_us - lag(timestamp_us) over w) / 1e6 <= 0.75 then 0 else 1 end as step
        from (select distinct scenario_token, frame_index, timestamp_us from e where is_ego) window w as (partition by scenario_token order by frame_index))),
    {name}i as (select r.*, part, r.frame_index - row_number() over (partition by r.scenario_token, {key} order by r.frame_index) as island from {rows} r join {name}p on r.scenario_token = {name}p.scenario_token and r.frame_index = {name}p.frame_index),
    {name}j as (select *, first_value(timestamp_us) over (partition by scenario_token, {key}, part, island order by frame_index) as start_us from {name}i), {name} as (select *, (timestamp_us - start_us) / 1e6 as duration_s from {name}j)"""


FRAME = "scenario_token, frame_index, timestamp_us"
_RAYS = "(dx * o_sin_h - dy * o_cos_h) / nullif(s_cos_h * o_sin_h - s_sin_h * o_cos_h, 0) as s_far, (dx * s_sin_h - dy * s_cos_h) / nullif(s_cos_h * o_sin_h - s_sin_h * o_cos_h, 0) as o_far, abs(s_cos_h * o_sin_h - s_sin_h * o_cos_h) > 1e-9 as meets, sqrt(s_vx * s_vx + s_vy * s_vy) as s_v, sqrt(o_vx * o_vx + o_vy * o_vy) as o_v"
LEADERS = MATCHED + f""", ways(src, dst, start) as (values {_paths()}),
    own as (select *, (abs(cos(heading - map_heading)) * length_m + abs(sin(heading - map_heading)) * width_m) / 2 as half, vx * cos(map_heading) + vy * sin(map_heading) as forward from mt where agent_type in ('VEHICLE', 'EGO') and primary_id is not null and not ambiguous),
    met as (select {', '.join('s.' + c for c in FRAME.split(', '))}, s.track_token as s_track, t.track_token as o_track, start + t.progress - s.progress as distance, start + greatest(0, t.progress - t.half) - least(s.len, s.progress + s.half) as gap, s.forward as s_forward, t.forward as o_forward, s.travel_heading as s_way, t.travel_heading as o_way
        from own s join ways on s.primary_id = src join own t on t.primary_id = dst and s.scenario_token = t.scenario_token and s.frame_index = t.frame_index and s.track_token <> t.track_token),
    near as (select *, row_number() over w as place, lead(distance) over w as next from met where distance > 0.001 window w as (partition by scenario_token, frame_index, s_track order by distance, gap, o_track)),
    led as (select {FRAME}, s_track, o_track, distance, gap, s_forward, o_forward, case when s_forward > 0.3 then gap / s_forward end as headway_s, s_way is not null and o_way is not null and gap > 0.001 and s_forward >= -0.3 and o_forward >= -0.3 and gap <= 80 as sound from near where place = 1 and (next is null or next - distance > 0.5)),
    lead as (select * exclude (sound), case when sound and headway_s > 0 and headway_s <= 5 then 'moving' when sound and s_forward <= 2 and o_forward <= 4 and gap <= 12 then 'queue' end as mode from led)"""
_ROUND = lambda names: ", ".join(f"round(cast({c} as double), 6) as {c}" for c in names.split(", "))
_MORE = {
    "leaders": LEADERS + f" select {FRAME}, s_track, o_track, {_ROUND('distance, gap, s_forward, o_forward, headway_s')}, mode from lead",
    "follow_facts": LEADERS + ", v9 as (select * from lead where mode is not null), q9 as (select * from lead where mode = 'queue')" + _streaks("v9", "s_track, o_track", "fa") + _streaks("q9", "s_track, o_track", "fb") + f" select 'follows' as predicate, {FRAME}, s_track, o_track, start_us, {_ROUND('duration_s, gap')} from fa where duration_s >= 1 union all select 'queuesBehind', {FRAME}, s_track, o_track, start_us, {_ROUND('duration_s, gap')} from fb where duration_s >= 1",
    "maneuvers": MATCHED + f""", n0 as (select *, case primary_kind when 'lane' then primary_id end as lane, case primary_kind when 'lane_connector' then primary_id end as link from mt),
        n1 as (select *, lag(lane) over w as p_lane, lag(link) over w as p_link, coalesce({WRAP.format("heading - lag(heading) over w")}, 0) as turned, lag(lane, 2) over w as l2, lag(lane, 3) over w as l3, lag(x, 2) over w as p_x, lag(y, 2) over w as p_y, lag(heading, 2) over w as p_h, count(*) over w > 1 and (timestamp_us - first_value(timestamp_us) over w) / 1e6 >= 0.5 as old
            from n0 window w as (partition by scenario_token, track_token order by frame_index)),
        n2 as (select *, p_lane is not null and link is not null as entered, p_link is not null and lane is not null as leaves, case when lane = p_lane then lane end as target, case when l2 = l3 then l2 end as src from n1),
        n3 as (select *, sum(case when entered then 1 else 0 end) over (partition by scenario_token, track_token order by frame_index) as visit from n2),
        n4 as (select *, sum(turned) over w - first_value(turned) over w as turn, sum(case when leaves then 1 else 0 end) over w as n_exits from n3 window w as (partition by scenario_token, track_token, visit order by frame_index)),
        n5 as (select n4.*, visit > 0 and leaves and n_exits = 1 as exited, cos(p_h) * (y - p_y) - sin(p_h) * (x - p_x) as shift, case when list_contains(b9.lefts, target) then 'left' when list_contains(b9.rights, target) then 'right' end as side from n4 left join o b9 on b9.object_id = src),
        n6 as (select *, coalesce(side, case when abs(shift) >= 0.75 then case when shift > 0 then 'left' else 'right' end end) as way from n5),
        n7 as (select *, case when target is not null and src is not null and target <> src and link is null and p_link is null then case way when 'left' then 'changesLaneLeft' when 'right' then 'changesLaneRight' end end as changed from n6)
        select {KEYS}, coalesce(link, lane) as object_id, unnest(list_filter([case when entered then 'entersLaneConnector' end, case when exited then 'exitsLaneConnector' end, case when exited then case when abs(turn) >= 2.5 then 'makesUTurn' when turn >= 0.35 then 'turnsLeft' when turn <= -0.35 then 'turnsRight' else 'goesStraight' end end, changed,
            case when not entered and not exited and changed is null and lane = p_lane then 'keepsLane' end], lambda z: z is not null)) as predicate from n7 where old""",
}
SQL |= {f"way_{name}": text for name, text in _MORE.items()}


def _areas() -> str:
    """Bounds of the map's areas, which are boxes, as rows of VALUES."""
    return ", ".join(f"('{kind}', {min(x for x, _ in shape)}, {min(y for _, y in shape)}, {max(x for x, _ in shape)}, {max(y for _, y in shape)})" for _, kind, shape, *_ in map_rows()[0])


_LEAST = lambda *kinds: f"min(case when kind in ({', '.join(map(repr, kinds))}) and far <= 12 then far end)"
AREAS = f""", ar(kind, x0, y0, x1, y1) as (values {_areas()}),
    a0 as (select e.*, ar.kind, sqrt(power(greatest(x0 - x, x - x1, 0), 2) + power(greatest(y0 - y, y - y1, 0), 2)) as far, (abs(cos_h) * length_m + abs(sin_h) * width_m) / 2 as hx, (abs(sin_h) * length_m + abs(cos_h) * width_m) / 2 as hy, x0, y0, x1, y1 from e, ar),
    a1 as (select {KEYS}, agent_type, {_LEAST("lane", "lane_connector")} as lane_distance, {_LEAST("lane", "lane_connector", "drivable_area", "intersection")} as road_distance, {", ".join(f"{_LEAST(k)} as {k}_distance" for k in ("intersection", "crosswalk", "carpark"))},
        max(kind = 'carpark' and (far = 0 or greatest(0, least(x + hx, x1) - greatest(x - hx, x0)) * greatest(0, least(y + hy, y1) - greatest(y - hy, y0)) > 1e-6)) as in_carpark from a0 group by {KEYS}, agent_type)"""
BARRED = AREAS + """, s0 as (select *, first_value(x) over w as fx, first_value(y) over w as fy from e window w as (partition by scenario_token, track_token order by timestamp_us)),
    s1 as (select scenario_token, track_token, true as still from s0 group by all having (max(timestamp_us) - min(timestamp_us)) / 1e6 >= 2 and median(sqrt(vx * vx + vy * vy)) <= 0.5 and max(sqrt(power(x - fx, 2) + power(y - fy, 2))) <= 1 and max(agent_type) not in ('PEDESTRIAN', 'EGO')),
    a2 as (select *, coalesce(crosswalk_distance <= 5, false) as by_walk, coalesce(intersection_distance <= 5, false) as by_junction, coalesce(road_distance <= 3, false) as by_road from a1 left join s1 using (scenario_token, track_token)),
    bar as (select *, case when agent_type in ('VEHICLE', 'EGO') and in_carpark then 'in_carpark' when still and (coalesce(carpark_distance <= 1.5, false) or not coalesce(lane_distance <= 1.5, false)) then 'parked'
        when agent_type = 'PEDESTRIAN' then case when not (by_walk or by_junction and by_road) then 'far_from_crosswalk' end when agent_type = 'BICYCLE' then case when not (by_walk or by_road) then 'far_from_crosswalk_and_road' end
        when not coalesce(road_distance <= 6, false) then 'far_from_road' end as reason from a2)"""
MEETINGS = PAIRS + ", tr as (" + _NEW["track_pairs"][len(E) :].lstrip(", ").replace("b as (select", "with b as (select", 1) + f"""),
    x0 as (select k.*, count(*) over w as n, (max(timestamp_us) over w - min(timestamp_us) over w) / 1e6 as span, {_RAYS}, {DIFF.format("s_heading", "o_heading")} * 180 / pi() as angle from k semi join tr on k.scenario_token = tr.scenario_token and k.s_track = tr.s_track and k.o_track = tr.o_track window w as (partition by scenario_token, s_track, o_track)),
    x1 as (select *, greatest(0, s_far) as s_ray, greatest(0, o_far) as o_ray, o_v <= 0.05 as stationary from x0 where n >= 3 and span >= 1 and meets and s_far between -1e-9 and 10 + 1e-9 and o_far between -1e-9 and 10 + 1e-9 and angle between 25 and 155 and s_v >= 0.3),
    x2 as (select *, s_ray / greatest(s_v, 0.05) as s_eta from x1), x3 as (select *, case when not stationary then o_ray / o_v - s_eta end as eta_gap from x2),
    x4 as (select *, greatest(0, 3 - abs(angle - 90) / 30) + greatest(0, 2 - greatest(s_ray, o_ray) / 10) + least(2, s_v) as score, s_x + s_cos_h * s_ray as conflict_x, s_y + s_sin_h * s_ray as conflict_y from x3 where stationary or eta_gap between 0.25 and 6)""" + BARRED + """,
    xg as (select x4.*, sb.reason as s_reason, ob.reason as o_reason from x4 join bar sb on x4.scenario_token = sb.scenario_token and x4.frame_index = sb.frame_index and x4.s_track = sb.track_token join bar ob on x4.scenario_token = ob.scenario_token and x4.frame_index = ob.frame_index and x4.o_track = ob.track_token),
    x5 as (select * from (select *, row_number() over (partition by scenario_token, frame_index, least(s_track, o_track), greatest(s_track, o_track) order by score desc, s_track) as place from xg where s_reason is null and o_reason is null) where place = 1)"""
SQL["way_area_distances"] = E + AREAS + f" select {KEYS}, {_ROUND('lane_distance, road_distance, intersection_distance, crosswalk_distance, carpark_distance')}, in_carpark from a1"
SQL["way_crossing_gates"] = MEETINGS + f" select {FRAME}, s_track, o_track, s_reason, o_reason from xg"
SQL["way_crossings"] = MEETINGS + _streaks("x5", "s_track, o_track") + f" select {FRAME}, s_track, o_track, {_ROUND('conflict_x, conflict_y, angle, s_eta, eta_gap')}, stationary, {_ROUND('score, duration_s')}, start_us from st"


#: The catalogue as rows of VALUES: predicate, category, value type, native.
_CATALOG = ", ".join(f"('{p}', '{category}', '{kind}', {native})" for p, category, kind, native, _ in catalog.rows())
_TOPOLOGY = {"hasMapProgressDifferenceTo": "case when rel = 'same_map' then o_progress - s_progress end", "hasSignedPathDistanceTo": "path", "hasTravelDirectionDifferenceTo": "turn", "hasTravelLongitudinalDistanceTo": "t_ahead", "hasTravelLateralDistanceTo": "t_aside"}
_STATED = [f"select predicate from ({SQL[f'way_{name}']})" for name in (
    "structure_facts", "pose_facts", "motion_facts", "velocity_vectors", "temporal_facts", "precedes", "motion_states", "map_memberships", "area_memberships", "map_facts", "map_relations", "pair_identity", "pair_kinematics",
    "pair_footprints", "pair_history", "spatial_facts", "signal_facts", "relevant_signals", "follow_facts", "maneuvers",
)]
_STATED += [
    f"select predicate from ({_facts(TOPOLOGY, 'tp', PAIR, _TOPOLOGY)})",
    f"select unnest(list_filter([case when same_lane then 'inSameLaneAs' end, case when shared then 'sharesIntersectionWith' end], lambda z: z is not null)) as predicate from ({TOPOLOGY} select * from tp)",
    f"select case when s_is_ego then 'isRelevantToEgo' else 'isRelevantPair' end as predicate from ({SCORED} select * from sc where relevant)",
    f"select 'hasSpatialMapRelation' as predicate from ({TOPOLOGY} select * from tp)",
    f"select unnest(list_concat(list_transform(reasons, lambda z: 'hasRelevanceReason'), ['hasPrimaryRelevanceReason', 'hasRouteRelation', 'hasRelevanceScore'])) as predicate from ({SCORED} select * from sc where relevant)",
    f"select unnest(['hasFuturePosition', 'hasFutureFootprint']) as predicate from ({SQL['way_future_positions']})",
    f"select 'crossesInFrontOf' as predicate from ({SQL['way_crossings']})",
    f"select unnest(list_filter(['hasFutureSampleCount', 'hasAvailableFutureDuration', 'hasFutureCoverageRatio', case when insufficient then 'hasInsufficientFutureEvidence' end], lambda z: z is not null)) as predicate from ({SQL['way_future_coverage']})",
]
_COUNTED = f"with def(predicate, category, kind, native) as (values {_CATALOG}), n as (select predicate, count(*) as n from ({' union all '.join(_STATED)}) group by predicate)"
_ME = "case when track_token = 'ego' then concat('ego:', scenario_token, ':', timestamp_us) else concat('agent:', scenario_token, ':', track_token, ':', timestamp_us) end"
_LAST = {
    "frame_predicate_counts": _COUNTED + " select predicate, category, n from n join def using (predicate)",
    "frame_truth_counts": _COUNTED + " select case when native then 'native' when kind = 'BOOLEAN' then 'semantic' else 'measurement' end as kind, sum(n) :: bigint as n from n join def using (predicate) group by 1",
    "frame_coverage": _COUNTED.replace("as (values", "as (values", 1) + f" select predicate, case when predicate in ({', '.join(repr(p) for p, *_, status in catalog.rows() if status != 'enabled')}) then 'catalog_only' else 'enabled' end as status, coalesce(n, 0) as n, coalesce(n, 0) > 0 or predicate in ({', '.join(repr(p) for p, *_, status in catalog.rows() if status != 'enabled')}) as covered from def left join n using (predicate)",
    "unknown_predicates": f"with def(predicate, category, kind, native) as (values {_CATALOG}), t as (select * replace (case when frame_index % 10 = 3 then concat(predicate, 'Raw') else predicate end as predicate) from ({SQL['way_temporal_facts']})) select predicate, scenario_token, frame_index, timestamp_us, track_token, value from t anti join def using (predicate)",
    "n_triples": f"""with def(predicate, category, kind, native) as (values {_CATALOG}),
        f as (select scenario_token, timestamp_us, predicate, {_ME} as subject, null as object, object as value, null as number from ({SQL['way_structure_facts']}) union all select scenario_token, timestamp_us, predicate, {_ME}, null, null, cast(cast(value as decimal(38, 6)) as varchar) from ({SQL['way_pose_facts']})
            union all select scenario_token, timestamp_us, predicate, subject_id, object_id, null, null from ({SQL['way_precedes']}) union all select scenario_token, timestamp_us, predicate, {_ME}, object_id, null, null from ({SQL['way_map_memberships']})),
        i as (select f.*, kind, concat('<urn:way:', substring(sha256(concat_ws('|', scenario_token, timestamp_us, predicate, subject, coalesce(object, '~'), coalesce(value, '~'), coalesce(number, '~'), timestamp_us, timestamp_us)), 1, 24), '>') as node from f join def using (predicate)),
        l as (select *, case when object is not null then concat('<urn:way:', object, '>') when kind = 'ENTITY' and value is not null then concat('<urn:way:', value, '>') when kind = 'INTEGER' then concat('"', value, '"^^<http://www.w3.org/2001/XMLSchema#integer>')
            when number is not null then concat('"', number, '"^^<http://www.w3.org/2001/XMLSchema#decimal>') when value is not null then concat('"', value, '"') else '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>' end as thing from i)
        select unnest([concat('<urn:way:', subject, '> <urn:way:', predicate, '> ', thing, ' .'), concat(node, ' <http://www.w3.org/1999/02/22-rdf-syntax-ns#subject> <urn:way:', subject, '> .'), concat(node, ' <http://www.w3.org/1999/02/22-rdf-syntax-ns#predicate> <urn:way:', predicate, '> .'),
            concat(node, ' <http://www.w3.org/1999/02/22-rdf-syntax-ns#object> ', thing, ' .'), concat(node, ' <http://www.w3.org/ns/prov#wasDerivedFrom> <urn:way:', scenario_token, '> .'), concat(node, ' <http://www.w3.org/ns/prov#atTime> "', timestamp_us, '"^^<http://www.w3.org/2001/XMLSchema#integer> .')]) as value from l""",
}
SQL |= {f"way_{name}": text for name, text in _LAST.items()}

SQL["way_lane_neighbours"] = MATCHED + f""", ls0 as (select a.object_id, b.object_id as adjacent_id, a.upright, a.upright <> b.upright as across, (a.x0 + a.x1) / 2 as mx, (a.y0 + a.y1) / 2 as my,
        case when b.upright then (b.x0 + b.x1) / 2 else greatest(b.x0, least(b.x1, (a.x0 + a.x1) / 2)) end as px, case when b.upright then greatest(b.y0, least(b.y1, (a.y0 + a.y1) / 2)) else (b.y0 + b.y1) / 2 end as py,
        sqrt(power(greatest(b.x0 - a.x1, a.x0 - b.x1, 0), 2) + power(greatest(b.y0 - a.y1, a.y0 - b.y1, 0), 2)) as apart from o a, o b where a.object_id <> b.object_id),
    ls1 as (select *, sqrt(power(px - mx, 2) + power(py - my, 2)) as gap, case when upright then mx - px else py - my end as beside from ls0 where not across and apart <= 1.5)
    select {KEYS}, primary_id, adjacent_id, case when beside > 0 then 'left' else 'right' end as side, round(cast(gap as double), 6) as gap from mt join ls1 on ls1.object_id = mt.primary_id where gap between 2 and 6.5 and abs(beside) > 0.25"""
SQL["way_corridor_progress"] = MATCHED.replace("with ", "with recursive ", 1) + f""", cl as (select object_id, outs, len as total, 0 as hops, object_id as last from o union all
        select cl.object_id, o.outs, cl.total + o.len, hops + 1, o.object_id from cl join o on o.object_id = cl.outs[1] where len(cl.outs) = 1 and hops < 5),
    ct as (select object_id, max(total) as total from cl group by object_id)
    select {KEYS}, primary_id, round(cast(progress as double), 6) as along, round(cast(lateral_offset as double), 6) as offset, round(cast(total as double), 6) as corridor_length from mt join ct on ct.object_id = primary_id where primary_id is not null"""
_RUN_FACTS = f"select {FRAME}, predicate, s_track, o_track, start_us from ({SQL['way_follow_facts']}) union all select {FRAME}, 'crossesInFrontOf', s_track, o_track, start_us from ({SQL['way_crossings']})"
_RUNS = f"with rf as ({_RUN_FACTS}), rr as (select scenario_token, predicate, s_track, o_track, start_us, max(timestamp_us) as end_us from rf group by all)"
SQL["way_run_frames"] = _RUNS + f", fr as (select {FRAME} from ({E} select * from e where is_ego)) select fr.scenario_token, frame_index, timestamp_us, predicate, s_track, o_track, start_us, end_us from rr join fr on fr.scenario_token = rr.scenario_token and timestamp_us between start_us and end_us"
SQL["way_runs_together"] = _RUNS + """ select a.scenario_token, a.s_track, concat(a.predicate, ' ', a.o_track) as first, concat(b.predicate, ' ', b.o_track) as second, greatest(a.start_us, b.start_us) as from_us, least(a.end_us, b.end_us) as to_us
    from rr a join rr b on a.scenario_token = b.scenario_token and a.s_track = b.s_track and (a.predicate, a.o_track, a.start_us) < (b.predicate, b.o_track, b.start_us) and a.start_us <= b.end_us and b.start_us <= a.end_us"""
_NAMED = lambda t: f"case when {t} = 'ego' then concat('ego:', scenario_token, ':', timestamp_us) else concat('agent:', scenario_token, ':', {t}, ':', timestamp_us) end"
SQL["way_current_times"] = f"select predicate, {_NAMED('s_track')} as subject_id, {_NAMED('o_track')} as object_id, start_us, timestamp_us as current_us from ({_RUN_FACTS}) union all select 'precedes', subject_id, object_id, timestamp_us, timestamp_us from ({SQL['way_precedes']})"
SQL["way_follow_evidence"] = f"select scenario_token, timestamp_us as current_us, predicate, s_track, o_track, start_us, gap, duration_s from ({SQL['way_follow_facts']})"
_MEAN = lambda a, b: f"case when abs(cos({a}) + cos({b})) + abs(sin({a}) + sin({b})) < 1e-9 then {a} else atan2(sin({a}) + sin({b}), cos({a}) + cos({b})) end"
SQL["way_forward_speeds"] = E + f""", f0 as (select *, lag(x) over w as px, lag(y) over w as py, lag(heading) over w as ph, (timestamp_us - lag(timestamp_us) over w) / 1e6 as dt from e window w as (partition by scenario_token, track_token order by timestamp_us)),
    f1 as (select *, {_MEAN('ph', 'heading')} as way from f0), f2 as (select *, case when dt > 0 then (cos(way) * (x - px) + sin(way) * (y - py)) / dt end as v from f1)
    select {KEYS}, round(cast(case when px is null then lead(v) over (partition by scenario_token, track_token order by timestamp_us) else v end as double), 6) as forward_speed_seen from f2"""
SQL["way_pair_axes"] = PAIRS + f""", ax as (select *, {_MEAN('s_heading', 'o_heading')} as way from k where d <= 80 and s_agent_type in ('VEHICLE', 'EGO', 'BICYCLE') and o_agent_type in ('VEHICLE', 'EGO', 'BICYCLE')),
    ay as (select *, -(cos(way) * dx + sin(way) * dy) as ahead9, -(cos(way) * dy - sin(way) * dx) as aside9, (abs(cos(s_heading - way)) * s_length_m + abs(sin(s_heading - way)) * s_width_m) / 2 as sh9, (abs(cos(o_heading - way)) * o_length_m + abs(sin(o_heading - way)) * o_width_m) / 2 as oh9 from ax)
    select scenario_token, frame_index, timestamp_us, s_track, o_track, round(cast(ahead9 as double), 6) as axis_ahead, round(cast(aside9 as double), 6) as axis_aside, round(cast(-ahead9 - sh9 - oh9 as double), 6) as behind_gap, round(cast(ahead9 - sh9 - oh9 as double), 6) as clearance,
        least(ahead9 + sh9, oh9) - greatest(ahead9 - sh9, -oh9) >= -0.001 as level from ay"""
_KNOWN = f"def(predicate, category, kind, native) as (values {_CATALOG})"
SQL["way_signal_assertions"] = f"""with {_KNOWN}, f as (select scenario_token, timestamp_us, predicate, signal_id as subject_id, object as object_id from ({SQL['way_signal_facts']})
    union all select scenario_token, timestamp_us, predicate, {_ME}, signal_id from ({SQL['way_relevant_signals']}) union all select scenario_token, timestamp_us, predicate, {_ME}, null from ({SQL['way_motion_states']}))
    select scenario_token, timestamp_us, category, predicate, subject_id, object_id from f join def using (predicate)"""
_KIND = lambda t: f"case when {t} like 'ego:%' then 'ego' else 'agent' end"
_TRACK = lambda t: f"case when {t} like 'ego:%' then 'ego' else split_part({t}, ':', 3) end"
SQL["way_semantic_edges"] = f"""with {_KNOWN}, f as (select scenario_token, timestamp_us, predicate, {_NAMED('s_track')} as source, {_NAMED('o_track')} as target from ({_RUN_FACTS})
    union all select scenario_token, timestamp_us, 'precedes', subject_id, object_id from ({SQL['way_precedes']})),
    g as (select scenario_token, timestamp_us, concat({_KIND('source')}, '_to_', {_KIND('target')}) as relation, predicate, source, target from f
    union all select scenario_token, timestamp_us, tag, predicate, {_NAMED('s_track')}, {_NAMED('o_track')} from ({SQL['way_pair_identity']}) where predicate = 'hasPairwiseState')
    select scenario_token, timestamp_us, relation, category, source, target, string_agg(distinct predicate, ',' order by predicate) as predicates, count(distinct predicate)::int as n_predicates,
    concat({_TRACK('source')}, ' > ', {_TRACK('target')}, ': ', string_agg(distinct predicate, ', ' order by predicate)) as statement from g join def using (predicate) group by scenario_token, timestamp_us, relation, category, source, target"""
SQL["way_collapsed_edges"] = f"""with f as (select {FRAME}, s_track, o_track, predicate from ({SQL['way_body_sectors']}) union all select {FRAME}, s_track, o_track, predicate from ({SQL['way_contact_states']}) union all select {FRAME}, s_track, o_track, predicate from ({_RUN_FACTS}))
    select {FRAME}, s_track, o_track, part, string_agg(distinct predicate, ',' order by predicate) as predicates from (select *, case when predicate in ('follows', 'overtakes', 'yieldsTo') then predicate else 'rest' end as part from f) group by all"""
SQL["way_scenarios_by_facts"] = f"""with n as (select scenario_token, count(*) as n_facts, count(*) filter (predicate = 'crossesInFrontOf') as n_wanted from ({_RUN_FACTS}) group by 1)
    select scenario_token, coalesce(n_facts, 0) as n_facts, coalesce(n_wanted, 0) as n_wanted, n_facts is null as silent from (select distinct scenario_token from ({E} select * from e where is_ego)) left join n using (scenario_token)"""

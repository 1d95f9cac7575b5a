"""What each family states and what it is built on, and the plan that some categories need."""

from __future__ import annotations

from collections.abc import Iterable

#: Stage: the stages that it is built on.
STAGES: dict[str, tuple[str, ...]] = {
    "users": (), "signals": (), "moving": ("users",), "history": ("moving",), "found": ("moving",), "primary": ("found",), "areas_of": ("moving",), "matched": ("history", "primary"), "known": ("matched", "areas_of", "signals"),
    "kinematic": ("users",), "footprints": ("kinematic",), "scored": ("known",), "near_scored": ("known",), "futures": ("users",), "meetings": ("kinematic",), "barred": ("meetings",), "crossings": ("meetings", "barred"),
    "leaders": ("matched",), "path_conflicts": ("matched",), "lane_changes": ("matched", "found", "primary"), "vehicle_pairs": ("matched",),
}
#: Family: the categories that it states, and the stages that it needs.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "structure": (("agent", "scenario", "structure"), ()),
    "pose": (("geometry", "position_values"), ()),
    "motion": (("motion",), ("moving",)),
    "velocity": (("motion",), ("moving",)),
    "temporal": (("temporal",), ("history",)),
    "precedes": (("temporal",), ("history",)),
    "motion_state": (("motion_state",), ("history",)),
    "map_membership": (("map",), ("found",)),
    "area_membership": (("map",), ("areas_of",)),
    "map": (("map", "motion", "route"), ("matched",)),
    "map_relation": (("map", "motion", "route"), ("matched",)),
    "pairwise": (("pairwise",), ("kinematic",)),
    "pair_kinematics": (("geometry", "motion"), ("kinematic",)),
    "pair_footprints": (("geometry",), ("footprints",)),
    "pair_history": (("temporal",), ("footprints",)),
    "pair_topology": (("geometry", "map", "motion"), ("scored",)),
    "pair_map": (("map",), ("scored",)),
    "pair_relation": (("map",), ("scored",)),
    "relevance_texts": (("relevance", "route"), ("scored",)),
    "relevance_scores": (("relevance",), ("scored",)),
    "spatial": (("heading", "spatial"), ("scored",)),
    "relevance": (("relevance",), ("scored",)),
    "traffic_light": (("traffic_light",), ("signals",)),
    "relevant_signal": (("traffic_light",), ("matched", "found", "signals")),
    "following": (("interaction",), ("leaders",)),
    "crossing": (("interaction",), ("crossings",)),
    "maneuver": (("maneuver",), ("matched",)),
    "intent": (("intent",), ("path_conflicts",)),
    "future_position": (("future_observation",), ("futures",)),
    "future_footprint": (("future_observation",), ("futures",)),
    "future": (("future_observation",), ("users",)),
    "lane_change": (("interaction",), ("lane_changes",)),
    "merge": (("interaction",), ("lane_changes",)),
    "overtake": (("interaction",), ("vehicle_pairs",)),
    "yield": (("interaction",), ("crossings", "matched", "signals")),
    "risk": (("risk",), ("near_scored",)),
    "visibility": (("visibility",), ("kinematic",)),
}


def families_of(categories: Iterable[str]) -> list[str]:
    """The families that state some of the categories; a category that none states is an error."""
    wanted = set(categories)
    unknown = wanted - {c for stated, _ in FAMILIES.values() for c in stated}
    if unknown:
        raise ValueError(f"no family states {', '.join(sorted(unknown))}")
    return [name for name, (stated, _) in FAMILIES.items() if wanted & set(stated)]


def stages_of(families: Iterable[str]) -> list[str]:
    """The stages that the families need, each after those that it is built on."""
    out: list[str] = []

    def add(stage: str) -> None:
        for below in STAGES[stage]:
            add(below)
        if stage not in out:
            out.append(stage)

    for family in families:
        for stage in FAMILIES[family][1]:
            add(stage)
    return out

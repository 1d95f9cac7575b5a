"""The predicates and their categories, as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Predicate, category, type of its value, whether it is native (else derived), and status.
PREDICATES: tuple[tuple[str, str, str, bool, str], ...] = (
    ("hasTimestamp", "structure", "INTEGER", True, "enabled"),
    ("hasScenarioType", "scenario", "STRING", True, "enabled"),
    ("hasLogName", "scenario", "STRING", True, "enabled"),
    ("hasEgoState", "structure", "ENTITY", True, "enabled"),
    ("hasTrackedObject", "structure", "ENTITY", True, "enabled"),
    ("hasTrackToken", "agent", "STRING", True, "enabled"),
    ("hasAgentType", "agent", "STRING", True, "enabled"),
    ("hasX", "position_values", "FLOAT", True, "enabled"),
    ("hasY", "position_values", "FLOAT", True, "enabled"),
    ("hasHeading", "position_values", "FLOAT", True, "enabled"),
    ("hasRearAxleX", "position_values", "FLOAT", True, "enabled"),
    ("hasRearAxleY", "position_values", "FLOAT", True, "enabled"),
    ("hasLength", "geometry", "FLOAT", True, "enabled"),
    ("hasWidth", "geometry", "FLOAT", True, "enabled"),
    ("hasHeight", "geometry", "FLOAT", True, "enabled"),
    ("hasArea", "geometry", "FLOAT", False, "enabled"),
    ("hasCenterDistanceTo", "geometry", "FLOAT", False, "enabled"),
    ("hasFreeSpaceDistanceTo", "geometry", "FLOAT", False, "enabled"),
    ("hasLongitudinalDistanceTo", "geometry", "FLOAT", False, "enabled"),
    ("hasLateralDistanceTo", "geometry", "FLOAT", False, "enabled"),
    ("hasBearingTo", "geometry", "FLOAT", False, "enabled"),
    ("hasHeadingDifferenceTo", "geometry", "FLOAT", False, "enabled"),
    ("hasIntersectionArea", "geometry", "FLOAT", False, "enabled"),
    ("hasLongitudinalFootprintGap", "geometry", "FLOAT", False, "enabled"),
    ("hasLateralFootprintGap", "geometry", "FLOAT", False, "enabled"),
    ("hasTravelLongitudinalDistanceTo", "geometry", "FLOAT", False, "enabled"),
    ("hasTravelLateralDistanceTo", "geometry", "FLOAT", False, "enabled"),
    ("hasVelocity", "motion", "VECTOR2", True, "enabled"),
    ("hasVelocityX", "motion", "FLOAT", True, "enabled"),
    ("hasVelocityY", "motion", "FLOAT", True, "enabled"),
    ("hasAccelerationX", "motion", "FLOAT", True, "enabled"),
    ("hasAccelerationY", "motion", "FLOAT", True, "enabled"),
    ("hasSpeed", "motion", "FLOAT", False, "enabled"),
    ("hasAcceleration", "motion", "FLOAT", False, "enabled"),
    ("hasRelativeSpeedTo", "motion", "FLOAT", False, "enabled"),
    ("hasLongitudinalRelativeSpeedTo", "motion", "FLOAT", False, "enabled"),
    ("hasLateralRelativeSpeedTo", "motion", "FLOAT", False, "enabled"),
    ("hasClosingSpeedTo", "motion", "FLOAT", False, "enabled"),
    ("hasVelocityTowardTarget", "motion", "FLOAT", False, "enabled"),
    ("hasSubjectForwardSpeed", "motion", "FLOAT", False, "enabled"),
    ("hasVelocityHeading", "motion", "FLOAT", False, "enabled"),
    ("hasEffectiveTravelHeading", "motion", "FLOAT", False, "enabled"),
    ("hasTravelDirectionDifferenceTo", "motion", "FLOAT", False, "enabled"),
    ("hasTravelDirectionSource", "motion", "STRING", False, "enabled"),
    ("precedes", "temporal", "ENTITY", False, "enabled"),
    ("hasDeltaTimeFromPrevious", "temporal", "FLOAT", False, "enabled"),
    ("hasDisplacementFromPrevious", "temporal", "FLOAT", False, "enabled"),
    ("hasHeadingChangeFromPrevious", "temporal", "FLOAT", False, "enabled"),
    ("hasSpeedChangeFromPrevious", "temporal", "FLOAT", False, "enabled"),
    ("hasEstimatedAcceleration", "temporal", "FLOAT", False, "enabled"),
    ("hasObservedDuration", "temporal", "FLOAT", False, "enabled"),
    ("hasPairObservedDuration", "temporal", "FLOAT", False, "enabled"),
    ("hasCenterDistanceChangeFromPrevious", "temporal", "FLOAT", False, "enabled"),
    ("hasFreeSpaceDistanceChangeFromPrevious", "temporal", "FLOAT", False, "enabled"),
    ("hasTotalObservedSpan", "temporal", "FLOAT", False, "enabled"),
    ("hasContinuousObservedDuration", "temporal", "FLOAT", False, "enabled"),
    ("hasDisplacementHeading", "temporal", "FLOAT", False, "enabled"),
    ("hasObservedFrameCount", "temporal", "INTEGER", False, "enabled"),
    ("hasPairObservedFrameCount", "temporal", "INTEGER", False, "enabled"),
    ("hasTotalObservedFrameCount", "temporal", "INTEGER", False, "enabled"),
    ("hasContinuousObservedFrameCount", "temporal", "INTEGER", False, "enabled"),
    ("inLane", "map", "ENTITY", False, "enabled"),
    ("inLaneConnector", "map", "ENTITY", False, "enabled"),
    ("intersectsLane", "map", "ENTITY", False, "enabled"),
    ("intersectsLaneConnector", "map", "ENTITY", False, "enabled"),
    ("hasPrimaryLane", "map", "ENTITY", False, "enabled"),
    ("hasPrimaryLaneConnector", "map", "ENTITY", False, "enabled"),
    ("hasParentRoadblock", "map", "ENTITY", False, "enabled"),
    ("hasParentRoadblockConnector", "map", "ENTITY", False, "enabled"),
    ("inIntersection", "map", "ENTITY", False, "enabled"),
    ("intersectsIntersection", "map", "ENTITY", False, "enabled"),
    ("hasPrimaryMapIntersection", "map", "ENTITY", False, "enabled"),
    ("inCrosswalk", "map", "ENTITY", False, "enabled"),
    ("intersectsCrosswalk", "map", "ENTITY", False, "enabled"),
    ("inSameLaneAs", "map", "BOOLEAN", False, "enabled"),
    ("sharesIntersectionWith", "map", "BOOLEAN", False, "enabled"),
    ("hasAmbiguousMapMatch", "map", "BOOLEAN", False, "enabled"),
    ("hasPrimaryMapOverlapRatio", "map", "FLOAT", False, "enabled"),
    ("hasBaselineProgress", "map", "FLOAT", False, "enabled"),
    ("hasBaselineLateralOffset", "map", "FLOAT", False, "enabled"),
    ("hasMapHeading", "map", "FLOAT", False, "enabled"),
    ("hasMapProgressDifferenceTo", "map", "FLOAT", False, "enabled"),
    ("hasSignedPathDistanceTo", "map", "FLOAT", False, "enabled"),
    ("hasMapSpeedLimit", "map", "FLOAT", False, "enabled"),
    ("hasBaselineCurvature", "map", "FLOAT", False, "enabled"),
    ("hasSpatialMapRelation", "map", "STRING", False, "enabled"),
    ("onExpertRoute", "route", "ENTITY", True, "enabled"),
    ("hasRouteRelation", "route", "STRING", False, "enabled"),
    ("hasRouteRoadblockRank", "route", "INTEGER", False, "enabled"),
    ("hasPairwiseState", "pairwise", "ENTITY", False, "enabled"),
    ("pairSubject", "pairwise", "ENTITY", False, "enabled"),
    ("pairObject", "pairwise", "ENTITY", False, "enabled"),
    ("overlapping", "spatial", "BOOLEAN", False, "enabled"),
    ("touching", "spatial", "BOOLEAN", False, "enabled"),
    ("near", "spatial", "BOOLEAN", False, "enabled"),
    ("veryNear", "spatial", "BOOLEAN", False, "enabled"),
    ("inFrontOf", "spatial", "BOOLEAN", False, "enabled"),
    ("behind", "spatial", "BOOLEAN", False, "enabled"),
    ("leftOf", "spatial", "BOOLEAN", False, "enabled"),
    ("rightOf", "spatial", "BOOLEAN", False, "enabled"),
    ("frontLeftOf", "spatial", "BOOLEAN", False, "enabled"),
    ("frontRightOf", "spatial", "BOOLEAN", False, "enabled"),
    ("rearLeftOf", "spatial", "BOOLEAN", False, "enabled"),
    ("rearRightOf", "spatial", "BOOLEAN", False, "enabled"),
    ("isStopped", "motion_state", "BOOLEAN", False, "enabled"),
    ("isSlow", "motion_state", "BOOLEAN", False, "enabled"),
    ("isMoving", "motion_state", "BOOLEAN", False, "enabled"),
    ("isAccelerating", "motion_state", "BOOLEAN", False, "enabled"),
    ("isDecelerating", "motion_state", "BOOLEAN", False, "enabled"),
    ("alignedWith", "heading", "BOOLEAN", False, "enabled"),
    ("oppositeDirectionTo", "heading", "BOOLEAN", False, "enabled"),
    ("follows", "interaction", "ENTITY", False, "enabled"),
    ("queuesBehind", "interaction", "ENTITY", False, "enabled"),
    ("changesLane", "interaction", "ENTITY", False, "enabled"),
    ("mergesInFrontOf", "interaction", "ENTITY", False, "enabled"),
    ("mergesBehind", "interaction", "ENTITY", False, "enabled"),
    ("crossesInFrontOf", "interaction", "ENTITY", False, "enabled"),
    ("yieldsTo", "interaction", "ENTITY", False, "enabled"),
    ("overtakes", "interaction", "ENTITY", False, "enabled"),
    ("hasConflictRiskWith", "risk", "ENTITY", False, "enabled"),
    ("hasFuturePosition", "future_observation", "ENTITY", False, "enabled"),
    ("hasFutureFootprint", "future_observation", "ENTITY", False, "enabled"),
    ("hasAvailableFutureDuration", "future_observation", "FLOAT", False, "enabled"),
    ("hasFutureCoverageRatio", "future_observation", "FLOAT", False, "enabled"),
    ("hasFutureSampleCount", "future_observation", "INTEGER", False, "enabled"),
    ("hasInsufficientFutureEvidence", "future_observation", "BOOLEAN", False, "enabled"),
    ("keepsLane", "maneuver", "BOOLEAN", False, "enabled"),
    ("changesLaneLeft", "maneuver", "BOOLEAN", False, "enabled"),
    ("changesLaneRight", "maneuver", "BOOLEAN", False, "enabled"),
    ("turnsLeft", "maneuver", "BOOLEAN", False, "enabled"),
    ("turnsRight", "maneuver", "BOOLEAN", False, "enabled"),
    ("goesStraight", "maneuver", "BOOLEAN", False, "enabled"),
    ("makesUTurn", "maneuver", "BOOLEAN", False, "enabled"),
    ("entersLaneConnector", "maneuver", "ENTITY", False, "enabled"),
    ("exitsLaneConnector", "maneuver", "ENTITY", False, "enabled"),
    ("merges", "maneuver", "ENTITY", False, "catalog_only"),
    ("controls", "traffic_light", "ENTITY", False, "enabled"),
    ("hasSignalState", "traffic_light", "ENTITY", False, "enabled"),
    ("isRelevantSignal", "traffic_light", "ENTITY", False, "enabled"),
    ("withinEgoFieldOfView", "visibility", "BOOLEAN", False, "enabled"),
    ("geometricallyVisibleToEgo", "visibility", "BOOLEAN", False, "enabled"),
    ("hasLineOfSightTo", "visibility", "ENTITY", False, "enabled"),
    ("occludedByAgent", "visibility", "ENTITY", False, "enabled"),
    ("projectsIntoCamera", "sensor_visibility", "ENTITY", False, "catalog_only"),
    ("visibleInCamera", "sensor_visibility", "ENTITY", False, "catalog_only"),
    ("visibleInLidar", "sensor_visibility", "ENTITY", False, "catalog_only"),
    ("partiallyOccluded", "sensor_visibility", "BOOLEAN", False, "catalog_only"),
    ("yieldingTo", "intent", "ENTITY", False, "enabled"),
    ("waitingFor", "intent", "ENTITY", False, "enabled"),
    ("creatingGapFor", "intent", "ENTITY", False, "enabled"),
    ("competingForGapWith", "intent", "ENTITY", False, "enabled"),
    ("isRelevantToEgo", "relevance", "BOOLEAN", False, "enabled"),
    ("isRelevantPair", "relevance", "BOOLEAN", False, "enabled"),
    ("hasRelevanceScore", "relevance", "FLOAT", False, "enabled"),
    ("hasRelevanceReason", "relevance", "STRING", False, "enabled"),
    ("hasPrimaryRelevanceReason", "relevance", "STRING", False, "enabled"),
)


def rows() -> list[tuple[str, str, str, bool, str]]:
    return list(PREDICATES)


def definitions(spark: SparkSession) -> DataFrame:
    """predicate, category, value_type, native, status."""
    return spark.createDataFrame(rows(), "predicate string, category string, value_type string, native boolean, status string")

"""Labels of single rows: speed, acceleration, sector, contact, heading, types, booleans."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from waygraph.config import DYNAMIC, LANE_USING, STATIC, T, Thresholds, VEHICLE, VULNERABLE


def is_static(kind: Column) -> Column:
    return F.upper(F.coalesce(kind, F.lit("UNKNOWN"))).rlike(STATIC)


def is_dynamic(kind: Column) -> Column:
    return ~is_static(kind) & F.upper(F.coalesce(kind, F.lit("UNKNOWN"))).rlike(DYNAMIC)


def is_vehicle(kind: Column) -> Column:
    return ~is_static(kind) & F.upper(F.coalesce(kind, F.lit("UNKNOWN"))).rlike(VEHICLE)


def is_vulnerable(kind: Column) -> Column:
    return F.upper(F.coalesce(kind, F.lit("UNKNOWN"))).rlike(VULNERABLE)


def uses_lanes(kind: Column) -> Column:
    return F.upper(F.coalesce(kind, F.lit("UNKNOWN"))).rlike(LANE_USING)


def speed_state(speed: Column, kind: Column, t: Thresholds = T) -> Column:
    label = F.when(speed <= t.stopped_speed, "isStopped").when(speed <= t.moving_speed, "isSlow").otherwise("isMoving")
    return F.when(speed.isNotNull() & ~is_static(kind), label)


def acceleration_state(value: Column, t: Thresholds = T) -> Column:
    return F.when(value >= t.acceleration, "isAccelerating").when(value <= -t.acceleration, "isDecelerating")


def sector(ahead: Column, left: Column, overlapping: Column, t: Thresholds = T) -> Column:
    """One of eight places of an object in the subject's body frame; null inside the dead bands, on top of it or overlapping."""
    far, corridor = F.abs(ahead), t.front_lateral_base + t.front_lateral_ratio * F.abs(ahead)
    beside = (
        F.when(left >= t.lateral_deadband, "leftOf")
        .when(left <= -t.lateral_deadband, "rightOf")
        .when(ahead >= t.longitudinal_deadband, "inFrontOf")
        .when(ahead <= -t.longitudinal_deadband, "behind")
    )
    front = F.when(F.abs(left) <= corridor, "inFrontOf").when(left > 0, "frontLeftOf").otherwise("frontRightOf")
    rear = F.when(F.abs(left) <= corridor, "behind").when(left > 0, "rearLeftOf").otherwise("rearRightOf")
    placed = F.when(far <= t.side_band, beside).when(ahead > 0, front).otherwise(rear)
    return F.when(~F.coalesce(overlapping, F.lit(False)) & (F.hypot(ahead, left) > t.colocated), placed)


def contact(distance: Column, area: Column, touching: Column, t: Thresholds = T) -> Column:
    """overlapping, touching, veryNear or near: exactly one, or null."""
    return (
        F.when(area > t.overlap_area, "overlapping")
        .when(touching | (distance <= t.distance_epsilon), "touching")
        .when(distance <= t.very_near, "veryNear")
        .when(distance <= t.near, "near")
    )


def heading_state(diff: Column, t: Thresholds = T) -> Column:
    return F.when(diff <= t.aligned, "alignedWith").when(F.abs(F.pi() - diff) <= t.opposite, "oppositeDirectionTo")


def parse_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true", "yes", "y", "on", "t"), True).when(word.isin("0", "false", "no", "n", "off", "f"), False)


def continuous(frame: Column, last_frame: Column, time_us: Column, last_us: Column, t: Thresholds = T) -> Column:
    """The next frame, within the longest gap."""
    dt = (time_us - last_us) / 1e6
    return F.coalesce((frame == last_frame + 1) & (dt > 0) & (dt <= t.sample_interval_s * t.maximum_gap_factor), F.lit(False))

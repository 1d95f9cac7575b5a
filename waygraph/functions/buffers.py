"""Regions that two widened polylines share, by intervals along scan lines."""

from __future__ import annotations

import numpy as np

#: Distance of scan lines in metres. They lie on multiples of it, so that one region gives one result wherever the paths begin.
SCAN = 0.05


def spans(line: np.ndarray, radius: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scan lines, segments): from where to where each scan line lies within radius of each segment; from > to where it doesn't."""
    a, b = line[:-1, None], line[1:, None]
    lo, hi = np.full((len(line) - 1, len(y)), np.inf), np.full((len(line) - 1, len(y)), -np.inf)

    def widen(left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> None:
        np.copyto(lo, np.minimum(lo, left), where=ok)
        np.copyto(hi, np.maximum(hi, right), where=ok)

    for end in (a, b):  # round ends
        d2 = radius**2 - (y[None] - end[..., 1]) ** 2
        half = np.sqrt(np.maximum(d2, 0))
        widen(end[..., 0] - half, end[..., 0] + half, d2 >= 0)
    d = b - a
    size = np.maximum(np.hypot(d[..., 0], d[..., 1]), 1e-12)
    normal = np.stack([-d[..., 1], d[..., 0]], -1) / size[..., None] * radius
    corners = [a + normal, b + normal, b - normal, a - normal]
    for p, q in zip(corners, [*corners[1:], corners[0]], strict=True):
        rise = q[..., 1] - p[..., 1]
        t = (y[None] - p[..., 1]) / np.where(np.abs(rise) < 1e-12, 1.0, rise)
        x = p[..., 0] + t * (q[..., 0] - p[..., 0])
        widen(x, x, (np.abs(rise) >= 1e-12) & (t >= 0) & (t <= 1))
    return lo.T, hi.T


def shared_region(one: np.ndarray, one_radius: float, two: np.ndarray, two_radius: float, scan: float = SCAN) -> tuple[float, float, float] | None:
    """Area and centroid of what lies within both radii of both polylines; None where nothing does."""
    low = max(one[:, 1].min() - one_radius, two[:, 1].min() - two_radius)
    high = min(one[:, 1].max() + one_radius, two[:, 1].max() + two_radius)
    y = np.arange(np.ceil(low / scan), np.floor(high / scan) + 1) * scan
    if not len(y):
        return None
    (lo1, hi1), (lo2, hi2) = spans(one, one_radius, y), spans(two, two_radius, y)
    lo, hi = np.concatenate([lo1, lo2], 1), np.concatenate([hi1, hi2], 1)
    lo, hi = np.where(hi >= lo, lo, 0.0), np.where(hi >= lo, hi, 0.0)  # a span that isn't there has no length
    x = np.concatenate([lo, hi], 1)
    first = np.arange(lo.shape[1]) < lo1.shape[1]
    order = np.argsort(x, 1, kind="stable")
    x = np.take_along_axis(x, order, 1)
    inside = []
    for own in (first, ~first):
        step = np.concatenate([own.astype(int), -own.astype(int)])
        inside.append(np.cumsum(step[order], 1)[:, :-1] > 0)
    length = np.where(inside[0] & inside[1], np.diff(x, axis=1), 0.0)
    area = float(length.sum() * scan)
    if area <= 1e-9:
        return None
    cx = (length * (x[:, :-1] + x[:, 1:]) / 2).sum() * scan / area
    return area, float(cx), float((length.sum(1) * y).sum() * scan / area)

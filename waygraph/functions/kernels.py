"""Planar geometry of many shapes at once, in numpy."""

from __future__ import annotations

import numpy as np


def boxes(x: np.ndarray, y: np.ndarray, cos_h: np.ndarray, sin_h: np.ndarray, length: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Corners (n, 4, 2), counter-clockwise."""
    l, w = length[:, None] / 2 * np.array([1, -1, -1, 1]), width[:, None] / 2 * np.array([1, 1, -1, -1])
    c, s = cos_h[:, None], sin_h[:, None]
    return np.stack([x[:, None] + c * l - s * w, y[:, None] + s * l + c * w], -1)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def points_to_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points to segments; the arrays broadcast."""
    # x and y each in arrays of their own: sums over a last axis of two take several times as long
    dx, dy = b[..., 0] - a[..., 0], b[..., 1] - a[..., 1]
    px, py = p[..., 0] - a[..., 0], p[..., 1] - a[..., 1]
    t = np.clip((px * dx + py * dy) / np.maximum(dx * dx + dy * dy, 1e-18), 0, 1)
    px, py = px - t * dx, py - t * dy
    return np.sqrt(px * px + py * py)


def inside_convex(p: np.ndarray, poly: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """(n, k) whether points (n, k, 2) lie in or on counter-clockwise convex shapes (n, m, 2)."""
    a, b = poly[:, None, :, :], np.roll(poly, -1, 1)[:, None, :, :]
    return (_cross(b - a, p[:, :, None, :] - a) >= -eps).all(-1)


def bounds_meet(a: np.ndarray, b: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """(n,) whether the bounds of shapes (n, i, 2) and (n, j, 2) meet."""
    return ((a.min(1) <= b.max(1) + eps) & (b.min(1) <= a.max(1) + eps)).all(1)


def convex_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas of the intersections of convex shapes (n, i, 2) and (n, j, 2); those whose bounds are apart share none."""
    out, near = np.zeros(len(a)), bounds_meet(a, b)
    if near.any():
        out[near] = _overlap(a[near], b[near])
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, i, j = len(a), a.shape[1], b.shape[1]
    a0, a1, b0, b1 = a[:, :, None], np.roll(a, -1, 1)[:, :, None], b[:, None], np.roll(b, -1, 1)[:, None]
    da, db = a1 - a0, b1 - b0
    det = _cross(da, db)
    safe = np.where(np.abs(det) < 1e-12, 1.0, det)
    t, u = _cross(b0 - a0, db) / safe, _cross(b0 - a0, da) / safe
    meet = (np.abs(det) >= 1e-12) & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
    points = np.concatenate([a, b, (a0 + t[..., None] * da).reshape(n, i * j, 2)], 1)
    use = np.concatenate([inside_convex(a, b), inside_convex(b, a), meet.reshape(n, i * j)], 1)
    count = use.sum(1)
    middle = np.where(use[..., None], points, 0).sum(1) / np.maximum(count, 1)[:, None]
    points = np.where(use[..., None], points, middle[:, None])
    angle = np.where(use, np.arctan2(points[..., 1] - middle[:, None, 1], points[..., 0] - middle[:, None, 0]), 9.0)
    order = np.argsort(angle, 1)
    ring, ok = np.take_along_axis(points, order[..., None], 1), np.take_along_axis(use, order, 1)
    ring = np.where(ok[..., None], ring, ring[:, :1])
    return np.where(count >= 3, np.abs(_cross(ring, np.roll(ring, -1, 1)).sum(1)) / 2, 0.0)


def convex_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of convex shapes (n, i, 2) and (n, j, 2); 0 where they meet."""
    one = points_to_segments(a[:, :, None], b[:, None], np.roll(b, -1, 1)[:, None]).min((1, 2))
    two = points_to_segments(b[:, :, None], a[:, None], np.roll(a, -1, 1)[:, None]).min((1, 2))
    # bounds that are apart say so already; the others ask the normals of all edges
    apart = ~bounds_meet(a, b)
    close = ~apart
    if close.any():
        a, b = a[close], b[close]
        split = np.zeros(len(a), bool)
        for shape in (a, b):
            edge = np.roll(shape, -1, 1) - shape
            normal = np.stack([edge[..., 1], -edge[..., 0]], -1)
            pa, pb = np.einsum("nkc,nmc->nkm", normal, a), np.einsum("nkc,nmc->nkm", normal, b)
            split |= ((pa.max(2) < pb.min(2)) | (pb.max(2) < pa.min(2))).any(1)
        apart[close] = split
    return np.where(apart, np.minimum(one, two), 0.0)


def convex_meet(a: np.ndarray, b: np.ndarray, within: float = 0.0) -> np.ndarray:
    """(n,) whether convex shapes (n, i, 2) and (n, j, 2) are no further apart than within, a millionth or less; those whose bounds are apart aren't asked."""
    out = bounds_meet(a, b)
    if out.any():
        out[out] = convex_distance(a[out], b[out]) <= within
    return out


def in_polygon(p: np.ndarray, poly: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Whether points (n, 2) lie in or on one polygon (m, 2) of any shape."""
    a, b = poly[None], np.roll(poly, -1, 0)[None]
    q = p[:, None]
    cross = ((a[..., 1] > q[..., 1]) != (b[..., 1] > q[..., 1])) & (q[..., 0] < (b[..., 0] - a[..., 0]) * (q[..., 1] - a[..., 1]) / np.where(b[..., 1] == a[..., 1], 1.0, b[..., 1] - a[..., 1]) + a[..., 0])
    return (cross.sum(1) % 2 == 1) | (points_to_segments(q, a, b).min(1) <= eps)


def triangles(poly: np.ndarray) -> np.ndarray:
    """(k, 3, 2) counter-clockwise triangles of a simple polygon, by clipping ears."""
    ring = poly if _cross(poly, np.roll(poly, -1, 0)).sum() > 0 else poly[::-1]
    left, out = list(range(len(ring))), []
    while len(left) > 3:
        for at in range(len(left)):
            i, j, k = left[at - 1], left[at], left[(at + 1) % len(left)]
            tri = ring[[i, j, k]]
            if _cross(tri[1] - tri[0], tri[2] - tri[1]) <= 1e-12:
                continue
            others = [m for m in left if m not in (i, j, k)]
            if others and inside_convex(ring[others][None], tri[None], -1e-12)[0].any():
                continue
            out.append(tri)
            left.pop(at)
            break
        else:
            break
    if len(left) >= 3:
        out.append(ring[left[:3]])
    return np.array(out)


def polygon_overlap(shapes: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """Areas of the intersections of convex shapes (n, i, 2) with one simple polygon."""
    total = np.zeros(len(shapes))
    for tri in triangles(poly):
        total += convex_overlap(shapes, np.repeat(tri[None], len(shapes), 0))
    return total


def project(p: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arc length, left-positive offset and direction of points (n, 2) on a polyline (m, 2)."""
    a, b = line[:-1], line[1:]
    each = points_to_segments(p[:, None], a[None], b[None])
    best = each.argmin(1)
    d = b - a
    size = np.sqrt((d * d).sum(1))
    along = np.clip(((p - a[best]) * d[best]).sum(1) / size[best], 0, size[best])
    start = np.concatenate([[0.0], np.cumsum(size)[:-1]])
    return start[best] + along, _cross(d[best], p - a[best]) / size[best], np.arctan2(d[best, 1], d[best, 0])


def polygon_distance(p: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """Distances of points (n, 2) to one polygon of any shape; 0 in it."""
    edge = points_to_segments(p[:, None], poly[None], np.roll(poly, -1, 0)[None]).min(1)
    return np.where(in_polygon(p, poly), 0.0, edge)


def crossing_segments(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether segments a-b and c-d cross; the arrays broadcast. Ones that merely touch may count as not crossing."""
    side = lambda p, q, r: _cross(q - p, r - p)
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def polygons_distance(one: np.ndarray, two: np.ndarray) -> float:
    """Distance of two polygons of any shape; 0 where they meet."""
    a, b, c, d = one[:, None], np.roll(one, -1, 0)[:, None], two[None], np.roll(two, -1, 0)[None]
    if crossing_segments(a, b, c, d).any():
        return 0.0
    return float(min(polygon_distance(one, two).min(), polygon_distance(two, one).min()))


def at_length(line: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Points of a polyline (m, 2) at arc lengths, which its ends cut short."""
    step = np.hypot(*np.diff(line, axis=0).T)
    start = np.concatenate([[0.0], np.cumsum(step)])
    return np.stack([np.interp(along, start, line[:, k]) for k in (0, 1)], -1)


def tangent(line: np.ndarray, along: np.ndarray, half: float = 0.5) -> np.ndarray:
    """Directions of a polyline about arc lengths, from half a metre before to half a metre behind."""
    d = at_length(line, along + half) - at_length(line, along - half)
    return np.arctan2(d[:, 1], d[:, 0])

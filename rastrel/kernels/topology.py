"""Topology guard on arrays: crossings, inside tests, and the gates that a fitted loop or shape must pass."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from rastrel.kernels import geometry, ring

# Cross products, lengths and distances that count as none.
FLAT, TOUCH = 1e-8, 1e-6


class Tolerances(NamedTuple):
    """Allowed relative error of area and least box overlap, of outer loops and of holes."""

    area: float = 0.12
    hole_area: float = 0.16
    box: float = 0.68
    hole_box: float = 0.56


def tolerances(settings) -> Tolerances:
    """The four gates of either order's settings."""
    return Tolerances(settings.topology_area_tolerance, settings.hole_area_tolerance, settings.topology_bbox_iou_threshold, settings.hole_bbox_iou_threshold)


def is_left(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Cross product of b - a and p - a: positive where p lies to the left."""
    return (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])


def orientation(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """0 on one line, 1 clockwise, 2 counter-clockwise, as y goes up."""
    cross = is_left(a, b, c)
    return np.where(np.abs(cross) <= FLAT, 0, np.where(cross < 0, 1, 2))


def in_box(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether p lies in the box of a and b, edges included."""
    low, high = np.minimum(a, b) - FLAT, np.maximum(a, b) + FLAT
    return ((p >= low) & (p <= high)).all(-1)


def on_segment(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (orientation(a, b, p) == 0) & in_box(a, b, p)


def shares_end(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    near = lambda u, v: np.hypot(u[..., 0] - v[..., 0], u[..., 1] - v[..., 1]) <= TOUCH
    return near(a, c) | near(a, d) | near(b, c) | near(b, d)


def segments_intersect(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether a-b and c-d cross, touch or lie on each other; segments that share an end don't count."""
    o1, o2, o3, o4 = orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)
    proper = (o1 != o2) & (o3 != o4)
    touch = ((o1 == 0) & in_box(a, b, c)) | ((o2 == 0) & in_box(a, b, d)) | ((o3 == 0) & in_box(c, d, a)) | ((o4 == 0) & in_box(c, d, b))
    return (proper | touch) & ~shares_end(a, b, c, d)


def _meeting(p: np.ndarray, q: np.ndarray, same: bool) -> bool:
    """Whether any edges of two rings meet; same: of one ring with itself, neighbours left out. Edges are sorted by their
    left ends, and each is compared only with those that begin before it ends."""
    def edges(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return r, np.roll(r, -1, axis=0)

    (a, b), (c, d) = edges(p), edges(q)
    order = np.argsort(np.minimum(c[:, 0], d[:, 0]), kind="stable")
    c, d = c[order], d[order]
    left, right = np.minimum(c[:, 0], d[:, 0]), np.maximum(c[:, 0], d[:, 0])
    low, high = np.minimum(c[:, 1], d[:, 1]), np.maximum(c[:, 1], d[:, 1])
    reach = float((right - left).max()) if len(c) else 0.0
    n = len(a)
    for i in range(n):
        x0, x1 = min(a[i, 0], b[i, 0]), max(a[i, 0], b[i, 0])
        y0, y1 = min(a[i, 1], b[i, 1]), max(a[i, 1], b[i, 1])
        k = np.arange(np.searchsorted(left, x0 - reach - FLAT), np.searchsorted(left, x1 + FLAT, side="right"))
        k = k[(right[k] >= x0 - FLAT) & (low[k] <= y1 + FLAT) & (high[k] >= y0 - FLAT)]
        if same:
            step = np.abs(order[k] - i)
            k = k[(np.minimum(step, n - step) > 1) & (order[k] > i)]
        if len(k) and segments_intersect(a[i], b[i], c[k], d[k]).any():
            return True
    return False


def self_intersects(p: np.ndarray) -> bool:
    """Whether two edges that aren't neighbours meet."""
    return len(p) > 3 and _meeting(p, p, True)


def polygons_intersect(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether an edge of one ring meets one of the other; rings one inside the other don't."""
    if len(p) < 2 or len(q) < 2 or (p.max(0) < q.min(0) - FLAT).any() or (q.max(0) < p.min(0) - FLAT).any():
        return False
    return _meeting(p, q, False)


def point_in_polygon(point: np.ndarray, p: np.ndarray) -> bool:
    """By winding number; the boundary is inside."""
    if len(p) < 3:
        return False
    a, b = p, np.roll(p, -1, axis=0)
    if on_segment(a, b, np.asarray(point, float)).any():
        return True
    side = is_left(a, b, np.asarray(point, float))
    up = (a[:, 1] <= point[1]) & (b[:, 1] > point[1]) & (side > 0)
    down = (a[:, 1] > point[1]) & (b[:, 1] <= point[1]) & (side < 0)
    return bool(up.sum() != down.sum())


def centroid(p: np.ndarray) -> np.ndarray | None:
    return ring.centroid(p) if len(p) >= 3 else None


def validate_points(fitted: np.ndarray, source: np.ndarray, hole: bool = False, limits: Tolerances = Tolerances()) -> bool:
    """Three points at least, no edges that meet, area and box near the source's."""
    if len(fitted) < 3:
        return False
    error = abs(abs(ring.area(fitted)) - abs(ring.area(source))) / max(1.0, abs(ring.area(source)))
    if error > (limits.hole_area if hole else limits.area) or ring.box_iou(fitted, source) < (limits.hole_box if hole else limits.box):
        return False
    return not self_intersects(fitted)


def validate_loop(loop: geometry.Loop, source: geometry.Contour, limits: Tolerances = Tolerances(), steps: int = 18) -> bool:
    return validate_points(geometry.sample_loop(loop.segments, steps), source.points, source.is_hole, limits)


def validate_shape(shape: geometry.Shape, outer: geometry.Contour, holes: list[geometry.Contour], limits: Tolerances = Tolerances()) -> bool:
    """The outer loop passes against its contour; each hole against the contour that it names, has its middle inside the
    outer loop, and meets neither that nor a hole before it."""
    around = geometry.sample_loop(shape.outer.segments)
    if not validate_points(around, outer.points, False, limits):
        return False
    sources = {h.contour_id: h for h in holes}
    before: list[np.ndarray] = []
    for loop in shape.holes:
        source = sources.get(loop.source or "")
        points = geometry.sample_loop(loop.segments)
        middle = centroid(points)
        if source is None or middle is None or not validate_points(points, source.points, True, limits):
            return False
        if not point_in_polygon(middle, around) or any(polygons_intersect(points, other) for other in (around, *before)):
            return False
        before.append(points)
    return True

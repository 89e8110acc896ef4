"""Parts of a contour: anchors, straight runs, a bottom half ellipse, and loops of lines, arcs and splines between anchors."""

from __future__ import annotations

import math
from typing import Any

import numpy as np

from rastrel.kernels import curves, ring

#: Handle of a cubic quarter circle in radii.
QUARTER = 0.5523
#: Least ratio of a corner's edges for a fillet.
BALANCE = 0.58


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the set runs around a ring; none where all are set."""
    n = len(flags)
    if not n or flags.all():
        return []
    opens = np.flatnonzero(flags & ~np.roll(flags, 1))
    ends = np.flatnonzero(flags & ~np.roll(flags, -1))
    return [(int(a), int((ends[np.searchsorted(ends, a)] if (ends >= a).any() else ends[0] + n) - a + 1)) for a in opens]


def anchors(p: np.ndarray, tolerance: float = 1.0, required: tuple[int, ...] = ()) -> list[int]:
    """Places of the points that simplifying keeps, and those required."""
    kept = ring.simplify_closed(p, tolerance)
    return sorted({int(np.argmin(np.hypot(*(p - q).T))) for q in kept} | set(required))


def span(p: np.ndarray, a: int, b: int) -> np.ndarray:
    """Points from a to b around the ring, both included."""
    n = len(p)
    return p[np.arange(a, a + (b - a) % n + 1) % n]


def straight_runs(p: np.ndarray, marks: list[int], tolerance: float = 0.9) -> list[dict]:
    """Edges between anchors that all points between keep to: {start, end, length, mean, max}."""
    out = []
    for a, b in zip(marks, [*marks[1:], *marks[:1]], strict=True):
        q = span(p, a, b)
        length = float(np.hypot(*(q[-1] - q[0])))
        off = ring._distance(q, q[0], q[-1])
        if off.max() <= tolerance and off.mean() <= 0.6 * tolerance and length >= max(4.0, 3 * tolerance):
            out.append({"start": a, "end": b, "length": length, "mean": float(off.mean()), "max": float(off.max())})
    return out


def bottom_ellipse(p: np.ndarray, band: float = 0.58, share: float = 0.42, aspect: tuple[float, float] = (1.2, 4.5), symmetry: float = 0.2, turn: float = 18.0, least: float = 0.62, least_area: float = 350.0) -> dict | None:
    """The run in a contour's lower band that, mirrored at its middle, fits a flat ellipse best; None below `least`."""
    n = len(p)
    low, high = p.min(0), p.max(0)
    size = high - low
    if n < 8 or min(size) <= 1e-6 or abs(ring.area(p)) < least_area:
        return None
    best = None
    for a, count in runs(p[:, 1] >= low[1] + band * size[1]):
        q = p[np.arange(a, a + count) % n]
        wide = float(np.ptp(q[:, 0]))
        if count < max(8, n / 12) or wide < share * size[0]:
            continue
        axis = float((q[:, 0].min() + q[:, 0].max()) / 2)
        both = np.vstack([q, (q * (-1, 1) + (2 * axis, 0))[1:-1][::-1]])
        # Ellipse about the axis by least squares: (x - axis)^2 A + y^2 B + y C = 1.
        x, y = both[:, 0] - axis, both[:, 1] - q[0, 1]
        try:
            (u, v, w), *_ = np.linalg.lstsq(np.stack([x * x, y * y, y], 1), np.ones(len(x)), rcond=None)
        except np.linalg.LinAlgError:
            continue
        if u <= 0 or v <= 0:
            continue
        full = 1 + w * w / (4 * v)
        rx, ry, cy = math.sqrt(full / u), math.sqrt(full / v), -w / (2 * v) + q[0, 1]
        if not aspect[0] <= rx / ry <= aspect[1]:
            continue
        error = np.abs(np.sqrt(((q[:, 0] - axis) / rx) ** 2 + ((q[:, 1] - cy) / ry) ** 2) - 1)
        lean = abs(float(q[0, 1] - q[-1, 1])) / max(1.0, float(size[1]))
        tilt = abs(math.degrees(math.atan2(q[-1, 1] - q[0, 1], q[-1, 0] - q[0, 0])))
        inverse = lambda value, limit: min(1.0, max(0.0, 1 - value / limit))
        sure = ring.mean(inverse(error.mean(), 0.2), inverse(error.max(), 0.4), inverse(lean, symmetry), inverse(min(tilt, 180 - tilt), turn), min(1.0, wide / size[0]))
        if sure >= least and (best is None or sure > best["confidence"]):
            best = {"start": a, "end": (a + count - 1) % n, "cx": axis, "cy": cy, "rx": rx, "ry": ry, "confidence": sure}
    return best


def _held(origin: np.ndarray, handle: np.ndarray, other: np.ndarray, most: float = 0.45) -> np.ndarray:
    """A handle no longer than a share of the chord."""
    d = handle - origin
    size, chord = float(np.hypot(*d)), float(np.hypot(*(other - origin)))
    return handle if size <= most * chord or size < 1e-12 else origin + d * (most * chord / size)


def catmull_rom(before: np.ndarray, a: np.ndarray, b: np.ndarray, after: np.ndarray, tension: float = 0.72) -> np.ndarray:
    """The cubic from a to b whose tangents follow the points around."""
    return np.array([a, _held(a, a + (b - before) * tension / 6, b), _held(b, b - (after - a) * tension / 6, a), b])


def line(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([a, a + (b - a) / 3, b - (b - a) / 3, b])


def spline_loop(p: np.ndarray, tolerance: float = 0.8, tension: float = 0.16) -> list[np.ndarray]:
    """A cardinal spline through the simplified ring, with straight edges at sharp corners."""
    q = ring.simplify_closed(p, tolerance)
    return cardinal(q, ring.hard_corners(q), tension)


def cardinal(q: np.ndarray, sharp: set[int], tension: float = 0.16) -> list[np.ndarray]:
    """A cardinal spline around a ring, with straight edges at the sharp places."""
    n = len(q)
    out = []
    for k in range(n):
        a, b = q[k], q[(k + 1) % n]
        if k in sharp or (k + 1) % n in sharp:
            out.append(line(a, b))
        else:
            out.append(np.array([a, a + tension * (b - q[k - 1]), b - tension * (q[(k + 2) % n] - a), b]))
    return out


def ellipse_curves(cx: float, cy: float, rx: float, ry: float, degrees: float = 0.0) -> list[np.ndarray]:
    """Four cubics around an ellipse."""
    t = math.radians(degrees)
    turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    unit = np.array([[1, 0], [1, QUARTER], [QUARTER, 1], [0, 1]], float)
    quarter = np.array([[0, 1], [-1, 0]], float)
    out = []
    for _ in range(4):
        out.append(unit * (rx, ry) @ turn + (cx, cy))
        unit = unit @ quarter
    return out


def merge_short(segments: list[np.ndarray], least: float = 3.0, closed: bool = True) -> list[np.ndarray]:
    """Curves with chords under `least` joined to the shorter neighbour, outer handles kept; an open chain's ends have one."""
    out = list(segments)
    chord = lambda c: float(np.hypot(*(c[3] - c[0])))
    k = 0
    while k < len(out) and len(out) > 2:
        if chord(out[k]) >= least:
            k += 1
            continue
        before, after = (k - 1) % len(out), (k + 1) % len(out)
        back = closed or k > 0
        ahead = closed or k < len(out) - 1
        a, b = (before, k) if back and (not ahead or chord(out[before]) <= chord(out[after])) else (k, after)
        joined = np.array([out[a][0], out[a][1], out[b][2], out[b][3]])
        out[a] = joined
        del out[b]
        k = 0
    return out


def fillet(before: np.ndarray, p: np.ndarray, after: np.ndarray, ratio: float = 0.11, most: float = 3.25, scale: float = 1.0) -> dict | None:
    """A rounded corner {radius, trim, start, end, curve, sweep}, or None where it would be too small or its edges too unlike."""
    u, v = before - p, after - p
    a, b = float(np.hypot(*u)), float(np.hypot(*v))
    short = min(a, b)
    if short <= 1 or short / max(a, b) < BALANCE:
        return None
    u, v = u / a, v / b
    theta = math.acos(float(np.clip(u @ v, -1, 1)))
    if theta < 1e-6 or theta >= math.pi - 1e-3:
        return None
    slope = math.tan(theta / 2)
    radius = min(most, short * ratio * scale, 0.9 * 0.24 * short * slope)
    trim = radius / slope
    start, end = p + u * trim, p + v * trim
    if radius <= 0.2 or trim <= 0.2 or np.hypot(*(end - start)) <= 0.5:
        return None
    handle = 4 / 3 * math.tan((math.pi - theta) / 4) * radius
    way = (p[0] - start[0]) * (end[1] - p[1]) - (p[1] - start[1]) * (end[0] - p[0]) > 0
    return {"radius": radius, "trim": trim, "start": start, "end": end, "curve": np.array([start, start - u * handle, end - v * handle, end]), "sweep": bool(way)}


def corner_fillet(before: np.ndarray, p: np.ndarray, after: np.ndarray, s: Any) -> dict | None:
    """fillet() by settings: the nearer an angle is to a sharp one, the smaller its radius."""
    u, v = before - p, after - p
    size = float(np.hypot(*u) * np.hypot(*v))
    angle = math.degrees(math.acos(float(np.clip(u @ v / size, -1, 1)))) if size > 1e-12 else 180.0
    wide = s.min_corner_angle_deg - s.sharp_corner_angle_deg
    scale = min(1.0, max(0.25, (angle - s.sharp_corner_angle_deg) / wide)) if wide > 0 else 1.0
    return fillet(before, p, after, s.fillet_radius_ratio, s.max_fillet_radius, scale)

"""Least-squares cubic curves through chains of points, after Schneider's published method, and their path text."""

from __future__ import annotations

import math

import numpy as np


def _unit(v: np.ndarray) -> np.ndarray:
    size = float(np.hypot(*v))
    return v / size if size > 1e-12 else np.zeros(2)


def _weights(t: np.ndarray) -> np.ndarray:
    s = 1 - t
    return np.stack([s**3, 3 * s * s * t, 3 * s * t * t, t**3], 1)


def evaluate(curve: np.ndarray, t: np.ndarray) -> np.ndarray:
    return _weights(np.asarray(t, float)) @ curve


def _solve(p: np.ndarray, t: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The curve with both end tangents given whose handle lengths leave the least squares."""
    w = _weights(t)
    a, b = w[:, 1, None] * left, w[:, 2, None] * right
    rest = p - (w[:, 0] + w[:, 1])[:, None] * p[0] - (w[:, 2] + w[:, 3])[:, None] * p[-1]
    aa, ab, bb, ar, br = (a * a).sum(), (a * b).sum(), (b * b).sum(), (a * rest).sum(), (b * rest).sum()
    det = aa * bb - ab * ab
    chord = float(np.hypot(*(p[-1] - p[0])))
    m, n = ((ar * bb - br * ab) / det, (aa * br - ab * ar) / det) if abs(det) > 1e-12 else (0.0, 0.0)
    if m < 1e-6 * chord or n < 1e-6 * chord:
        m = n = chord / 3
    return np.array([p[0], p[0] + m * left, p[-1] + n * right, p[-1]])


def _better(curve: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """One Newton step of every parameter towards the nearest point of the curve."""
    first, second = 3 * np.diff(curve, axis=0), 6 * np.diff(curve, 2, axis=0)
    s = (1 - t)[:, None]
    u = t[:, None]
    off = evaluate(curve, t) - p
    d1 = s * s * first[0] + 2 * s * u * first[1] + u * u * first[2]
    d2 = s * second[0] + u * second[1]
    slope = (d1 * d1).sum(1) + (off * d2).sum(1)
    step = np.where(np.abs(slope) > 1e-12, (off * d1).sum(1) / np.where(np.abs(slope) > 1e-12, slope, 1), 0)
    return np.maximum.accumulate(np.clip(t - step, 0, 1))  # in order, as the points are


def fit_open(p: np.ndarray, error: float = 2.0, left: np.ndarray | None = None, right: np.ndarray | None = None) -> list[np.ndarray]:
    """Curves (4, 2) that follow a chain within `error`, split where they are farthest off."""
    left = _unit(p[1] - p[0]) if left is None else left
    right = _unit(p[-2] - p[-1]) if right is None else right
    out: list[np.ndarray] = []
    stack = [(p, left, right)]
    while stack:
        q, a, b = stack.pop()
        if len(q) == 2:
            third = float(np.hypot(*(q[1] - q[0]))) / 3
            out.append(np.array([q[0], q[0] + a * third, q[1] + b * third, q[1]]))
            continue
        run = np.r_[0, np.cumsum(np.hypot(*np.diff(q, axis=0).T))]
        if run[-1] < 1e-12:
            continue
        t = run / run[-1]
        for _ in range(8):
            curve = _solve(q, t, a, b)
            off = ((evaluate(curve, t) - q) ** 2).sum(1)
            worst = int(np.argmax(off))
            if off[worst] <= error * error or off[worst] > 16 * error * error:
                break
            t = _better(curve, q, t)
        if off[worst] <= error * error:
            out.append(curve)
            continue
        k = min(max(1, worst), len(q) - 2)
        middle = _unit(q[k - 1] - q[k + 1])
        stack += [(q[k:], -middle, b), (q[: k + 1], a, middle)]
    return out


def fit_closed(p: np.ndarray, corners: set[int], error: float = 2.0) -> list[np.ndarray]:
    """Curves around a ring, with a break of tangent at the corners alone; a ring without any starts at its first point."""
    n = len(p)
    if n < 3:
        return []
    marks = sorted(corners)
    if not marks:
        tangent = _unit(p[1] - p[-1])
        return fit_open(np.vstack([p, p[:1]]), error, tangent, -tangent)
    out: list[np.ndarray] = []
    for a, b in zip(marks, [*marks[1:], marks[0] + n], strict=True):
        out += fit_open(p[np.arange(a, b + 1) % n], error)
    return out


def is_line(curve: np.ndarray, tolerance: float = 0.25) -> bool:
    d = curve[3] - curve[0]
    size = float(np.hypot(*d))
    if size < 1e-9:
        return False
    return bool((np.abs((curve[1:3, 0] - curve[0, 0]) * d[1] - (curve[1:3, 1] - curve[0, 1]) * d[0]) / size <= tolerance).all())


def sample(curves: list[np.ndarray], steps: int = 12) -> np.ndarray:
    t = np.arange(steps) / steps
    return np.concatenate([evaluate(c, t) for c in curves]) if curves else np.zeros((0, 2))


def number(value: float) -> str:
    """Two decimals, no trailing zeros, no negative zero."""
    if abs(value) < 1e-9:
        return "0"
    text = f"{value:.2f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def path(curves: list[np.ndarray]) -> str:
    """Relative path data of a closed loop of curves; straight ones become lines."""
    if not curves:
        return ""
    pair = lambda v: f"{number(v[0])} {number(v[1])}"
    out = ["m " + pair(curves[0][0])]
    for c in curves:
        out.append("l " + pair(c[3] - c[0]) if is_line(c) else "c " + " ".join(pair(q - c[0]) for q in c[1:]))
    return " ".join([*out, "z"])


def polygon(p: np.ndarray) -> str:
    return " ".join([f"{'m' if k == 0 else 'l'} {number(v[0])} {number(v[1])}" for k, v in enumerate(np.vstack([p[:1], np.diff(p, axis=0)]))] + ["z"]) if len(p) else ""


def arc_fit(p: np.ndarray) -> dict | None:
    """Circular arc through a chain: least-squares circle, unwrapped sweep and confidence."""
    if len(p) < 3:
        return None
    m = p.mean(0)
    q = p - m
    a = np.stack([q[:, 0], q[:, 1], np.ones(len(q))], 1)
    (u, v, w), *_ = np.linalg.lstsq(a, (q * q).sum(1), rcond=None)
    r = math.sqrt(max(0.0, w + (u * u + v * v) / 4))
    if r <= 1e-6:
        return None
    centre = m + np.array([u, v]) / 2
    d = p - centre
    angle = np.unwrap(np.arctan2(d[:, 1], d[:, 0]))
    radii = np.hypot(*d.T)
    sweep = float(angle[-1] - angle[0])
    dn = lambda x, b: 1 - min(1.0, max(0.0, x / b))
    up = lambda x, lo, hi: min(1.0, max(0.0, (x - lo) / (hi - lo)))
    sure = (dn(np.abs(radii - r).max() / max(1.0, r), 0.12) + dn(radii.std() / r, 0.10) + up(abs(math.degrees(sweep)), 18, 170)) / 3
    return {"cx": float(centre[0]), "cy": float(centre[1]), "r": r, "start": float(angle[0]), "sweep": sweep, "confidence": sure}

"""Contours that look like the shadow or the body of a pin: their own anchors, smoothing and tolerances."""

from __future__ import annotations

import numpy as np

from rastrel.kernels import ring

# Least aspect and range of filled box, by step; rims, notches and bodies as shares of the box.
SHADOW_CLEAN, SHADOW_FIT, PIN = (1.65, 0.38, 0.92), (1.7, 0.45, 0.92), (1.18, 0.46, 0.90)
RIM, NOTCH_WIDTH, NOTCH_CLEAN, NOTCH_FIT = 0.18, 0.18, 0.75, 0.78
BODY_HEIGHT, BODY_SIDE, BODY_WEIGHT = 0.6, 0.23, 1.6
SIGMA, BLEND, LOWER_SIGMA, LOWER_BLEND, LOWER = 1.15, 0.4, 1.3, 0.62, 0.34


def _shares(p: np.ndarray) -> tuple[float, float, float]:
    """Width, height and the share of the box that the ring fills."""
    if len(p) < 3:
        return 0.0, 0.0, 0.0
    w, h = map(float, np.ptp(p, axis=0))
    return w, h, abs(ring.area(p)) / max(1e-6, w * h)


def is_shadow_like(p: np.ndarray, hole: bool = False, limits: tuple[float, float, float] = SHADOW_CLEAN) -> bool:
    """Much wider than high, and neither thin nor a full box."""
    w, h, full = _shares(p)
    return not hole and w > 0 and h > 0 and w / h >= limits[0] and limits[1] <= full <= limits[2]


def is_pin_like(p: np.ndarray, hole: bool = False) -> bool:
    w, h, full = _shares(p)
    return not hole and w > 0 and h > 0 and h / w >= PIN[0] and PIN[1] <= full <= PIN[2]


def is_pin_body(outer: np.ndarray, holes: list[np.ndarray]) -> bool:
    """A high ring with one round hole in the upper middle, which ends below its middle."""
    if len(holes) != 1 or len(outer) < 3:
        return False
    c = ring.circle(holes[0], ring.describe(holes[0]))
    low, size = outer.min(0), np.ptp(outer, axis=0)
    if c is None or min(size) <= 0 or size[1] / size[0] < PIN[0] or c["fit"] < 0.88 and c["circularity"] < 0.9:
        return False
    middle = low[0] + size[0] / 2
    high = (c["cy"] - low[1]) / size[1]
    return abs(c["cx"] - middle) <= 0.11 * size[0] and 0.16 <= high <= 0.54 and abs(outer[np.argmax(outer[:, 1]), 0] - middle) <= 0.14 * size[0]


def bridge_anchors(p: np.ndarray, notch: float = NOTCH_CLEAN, bottom: bool = True) -> set[int]:
    """The inner ends of the two upper rims, the lowest point of the notch between them, and the lowest point of all."""
    low, size = p.min(0), np.ptp(p, axis=0)
    if len(p) < 6 or min(size) <= 0:
        return set()
    middle = low[0] + size[0] / 2
    rim = p[:, 1] <= low[1] + RIM * size[1]
    out: set[int] = set()
    for side, sign in ((rim & (p[:, 0] < middle), -1), (rim & (p[:, 0] > middle), 1)):
        if side.any():
            out.add(int(np.lexsort((np.arange(len(p)), np.where(side, sign * p[:, 0], np.inf)))[0]))
    dip = (np.abs(p[:, 0] - middle) <= NOTCH_WIDTH * size[0]) & (p[:, 1] <= low[1] + notch * size[1])
    if dip.any():
        out.add(int(np.lexsort((np.abs(p[:, 0] - middle), np.where(dip, -p[:, 1], np.inf)))[0]))
    if bottom:
        out.add(int(np.argmax(p[:, 1])))
    return out


def body_anchors(p: np.ndarray) -> set[int]:
    """On each side, the point nearest to where a pin's body narrows."""
    low, high = p.min(0), p.max(0)
    size = high - low
    if min(size) <= 0:
        return set()
    off = BODY_WEIGHT * np.abs(p[:, 1] - low[1] - BODY_HEIGHT * size[1])
    middle, out = (low[0] + high[0]) / 2, set()
    for side, want in ((p[:, 0] <= middle, low[0] + BODY_SIDE * size[0]), (p[:, 0] >= middle, high[0] - BODY_SIDE * size[0])):
        if side.any():
            out.add(int(np.lexsort((np.abs(p[:, 0] - want), np.where(side, off, np.inf)))[0]))
    return out


def blend(p: np.ndarray, sigma: float, share: float, fixed: set[int], where: np.ndarray | None = None) -> np.ndarray:
    """Points moved by a share of the way to their Gaussian mean; fixed ones stay."""
    move = np.full(len(p), min(1.0, max(0.0, share)))
    move[[i % len(p) for i in fixed]] = 0
    if where is not None:
        move[~where] = 0
    return p + move[:, None] * (ring.gaussian_closed(p, sigma) - p)


def presmooth(p: np.ndarray, fixed: set[int], hole: bool = False) -> np.ndarray:
    """Shadow-like rings of eight points and more are smoothed a little before the rest."""
    return blend(p, SIGMA, BLEND, fixed) if len(p) >= 8 and is_shadow_like(p, hole) else p


def steady_lower_mass(p: np.ndarray, fixed: set[int]) -> np.ndarray:
    """Smooths what lies below the upper third of the box."""
    if len(p) < 8:
        return p
    low, size = p.min(0), np.ptp(p, axis=0)
    return blend(p, LOWER_SIGMA, LOWER_BLEND, fixed, p[:, 1] > low[1] + LOWER * size[1])


def structural_anchors(p: np.ndarray, hole: bool = False) -> set[int]:
    """The four extrema, and a shadow-like ring's bridge."""
    return ring.extrema(p) | (bridge_anchors(p) if is_shadow_like(p, hole) else set())


def simplify_tolerance(p: np.ndarray, wanted: float, hole: bool = False) -> float:
    base = min(0.8, max(0.2, wanted))
    return min(0.85, max(0.45, 0.95 * base)) if is_shadow_like(p, hole) else base


def smoothing_strength(p: np.ndarray, wanted: float, hole: bool = False) -> float:
    base = min(0.85, max(0.0, wanted))
    return min(0.26, base) if is_shadow_like(p, hole) else base

"""Operators on rings and chains held as arrays of points: smoothing, anchors, slices, resampling and parameters.

`points` is array<struct<i, x, y>> in order; a ring's neighbours wrap. Arrays hold one ring each, so nothing is joined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.scalars import let
from rastrel.operators.rings import KEY, interior_angle
from rastrel.operators.segments import deviation

# Fixed values, as in kernels/shadow.py: least aspect and range of filled box of shadow-like and pin-like contours.
SHADOW_CLEAN, SHADOW_FIT, PIN = (1.65, 0.38, 0.92), (1.7, 0.45, 0.92), (1.18, 0.46, 0.90)


def arrays(points: DataFrame, key: str = KEY) -> DataFrame:
    """(key, points): a row for each ring; a ring comes together in one row."""
    return points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("points"))


def exploded(rings: DataFrame, column: str = "points", key: str = KEY) -> DataFrame:
    return rings.select(key, F.explode(column).alias("p")).select(key, "p.*")


def at(points: Column, k: Column) -> Column:
    """The point at place k around the ring."""
    return F.get(points, F.pmod(k, F.size(points)))


def _ends(points: Column, k: Column) -> Column:
    """The point at place k of an open chain, whose ends go on for ever."""
    return F.get(points, F.greatest(F.lit(0), F.least(k, F.size(points) - 1)))


def _mixed(points: Column, weights: dict[int, float], pick=at) -> Column:
    """Every point replaced by a weighted sum of those around it."""
    def mix(p: Column, k: Column) -> Column:
        axis = lambda a: sum((w * pick(points, k + d)[a] for d, w in weights.items()), F.lit(0.0))
        return F.struct(p["i"].alias("i"), axis("x").alias("x"), axis("y").alias("y"))
    return F.transform(points, mix)


def gaussian_weights(sigma: float) -> dict[int, float]:
    """Normalised weights by offset, three deviations to either side."""
    reach = max(1, math.ceil(3 * sigma))
    raw = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)}
    return {d: w / sum(raw.values()) for d, w in raw.items()}


def gaussian_closed(points: Column, sigma: float) -> Column:
    return _mixed(points, gaussian_weights(sigma))


def gaussian_open(points: Column, sigma: float) -> Column:
    """Gaussian means along a chain whose end points stay."""
    mixed = _mixed(points, gaussian_weights(sigma), _ends)
    return F.transform(mixed, lambda p, k: F.when((k == 0) | (k == F.size(points) - 1), F.get(points, k)).otherwise(p))


def blend(points: Column, smoothed: Column, share: Column | float, fixed: Column) -> Column:
    """Points moved by a share of the way to `smoothed`; those whose i is in `fixed` stay."""
    share = F.lit(float(share)) if not isinstance(share, Column) else share
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    move = lambda p, q: F.when(F.array_contains(fixed, p["i"]), p).otherwise(F.struct(p["i"].alias("i"), ((1 - held) * p["x"] + held * q["x"]).alias("x"), ((1 - held) * p["y"] + held * q["y"]).alias("y")))
    return F.zip_with(points, smoothed, move)


def angle_at(points: Column, k: Column) -> Column:
    """Interior angle in degrees at place k."""
    a, p, b = at(points, k - 1), at(points, k), at(points, k + 1)
    return interior_angle(a["x"], a["y"], p["x"], p["y"], b["x"], b["y"])


def curve_factor(angle: Column) -> Column:
    """How far a point may move in smoothing: .2 at sharp turns, 1 where the ring is straight."""
    return 0.2 + 0.8 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (angle - 105) / 65))


def expanded(indices: Column, n: Column, reach: int) -> Column:
    """Places with `reach` neighbours of each, around the ring, in order."""
    around = F.flatten(F.transform(indices, lambda i: F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.pmod(i + d, n))))
    return F.array_sort(F.array_distinct(around))


def smooth_pass(points: Column, fixed: Column, strength: float) -> Column:
    """One pass of the five-tap mean: fixed points stay, their neighbours move .65 as far, sharp turns less."""
    mean = _mixed(points, {-2: 1 / 16, -1: 4 / 16, 0: 6 / 16, 1: 4 / 16, 2: 1 / 16})
    beside = expanded(fixed, F.size(points), 1)

    def move(p: Column, k: Column) -> Column:
        free = F.when(F.array_contains(fixed, p["i"]), 0.0).when(F.array_contains(beside, p["i"]), 0.65).otherwise(1.0)
        s, q = strength * free * curve_factor(angle_at(points, k)), F.get(mean, k)
        return F.struct(p["i"].alias("i"), (p["x"] + s * (q["x"] - p["x"])).alias("x"), (p["y"] + s * (q["y"] - p["y"])).alias("y"))

    return F.transform(points, move)


def hard_places(points: Column, turn: float = 60.0) -> Column:
    """Places where the ring turns by `turn` degrees or more."""
    return F.transform(F.filter(points, lambda p, k: 180 - angle_at(points, k) >= turn), lambda p: p["i"])


def _best(points: Column, first: Column, second: Column, where=None) -> Column:
    """The place of the least (first, second) of the points that hold; null without any."""
    held = F.transform(F.filter(points, where) if where else points, lambda p: F.struct(first(p).alias("a"), second(p).alias("b"), p["i"].alias("i")))
    return F.array_min(held)["i"]


def extrema(points: Column) -> Column:
    """struct<top, bottom, left, right>: places of the extremes, the one nearest the middle of equals."""
    n = F.size(points)
    total = lambda a: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[a]) / n
    cx, cy = total("x"), total("y")
    near = lambda a, c: lambda p: F.abs(p[a] - c)
    return F.struct(
        _best(points, lambda p: p["y"], near("x", cx)).alias("top"), _best(points, lambda p: -p["y"], near("x", cx)).alias("bottom"),
        _best(points, lambda p: p["x"], near("y", cy)).alias("left"), _best(points, lambda p: -p["x"], near("y", cy)).alias("right"),
    )


def box(points: Column) -> Column:
    """struct<x0, x1, y0, y1>"""
    axis = lambda a: F.transform(points, lambda p: p[a])
    return F.struct(F.array_min(axis("x")).alias("x0"), F.array_max(axis("x")).alias("x1"), F.array_min(axis("y")).alias("y0"), F.array_max(axis("y")).alias("y1"))


def bridge(points: Column, notch: float = 0.75) -> Column:
    """struct<left, right, notch, bottom>: the inner ends of the upper rims, the notch's lowest point, the lowest point of all."""
    b = box(points)
    wide, high = b["x1"] - b["x0"], b["y1"] - b["y0"]
    middle, rim = b["x0"] + wide / 2, b["y0"] + 0.18 * high
    none = lambda p: F.lit(0.0)
    return F.struct(
        _best(points, lambda p: -p["x"], none, lambda p: (p["x"] < middle) & (p["y"] <= rim)).alias("left"),
        _best(points, lambda p: p["x"], none, lambda p: (p["x"] > middle) & (p["y"] <= rim)).alias("right"),
        _best(points, lambda p: -p["y"], lambda p: F.abs(p["x"] - middle), lambda p: (F.abs(p["x"] - middle) <= 0.18 * wide) & (p["y"] <= b["y0"] + notch * high)).alias("notch"),
        _best(points, lambda p: -p["y"], none).alias("bottom"),
    )


def body_anchors(points: Column) -> Column:
    """struct<left, right>: on each side, the place nearest to where a pin's body narrows."""
    b = box(points)
    wide, high = b["x1"] - b["x0"], b["y1"] - b["y0"]
    middle = b["x0"] + wide / 2
    off = lambda p: 1.6 * F.abs(p["y"] - b["y0"] - 0.6 * high)
    return F.struct(
        _best(points, off, lambda p: F.abs(p["x"] - b["x0"] - 0.23 * wide), lambda p: p["x"] <= middle).alias("left"),
        _best(points, off, lambda p: F.abs(p["x"] - b["x1"] + 0.23 * wide), lambda p: p["x"] >= middle).alias("right"),
    )


def looks_like(wide: Column, high: Column, area: Column, limits: tuple[float, float, float], upright: bool = False) -> Column:
    """Whether a contour's aspect and share of its box are those of a shadow (or, upright, of a pin)."""
    aspect = high / F.nullif(wide, F.lit(0.0)) if upright else wide / F.nullif(high, F.lit(0.0))
    full = area / F.greatest(F.lit(1e-6), wide * high)
    return F.coalesce((wide > 0) & (high > 0) & (aspect >= limits[0]) & (full >= limits[1]) & (full <= limits[2]), F.lit(False))


def simplify_tolerance(wanted: Column, shadow: Column) -> Column:
    base = F.least(F.lit(0.8), F.greatest(F.lit(0.2), wanted))
    return F.when(shadow, F.least(F.lit(0.85), F.greatest(F.lit(0.45), 0.95 * base))).otherwise(base)


def smoothing_strength(wanted: Column, shadow: Column) -> Column:
    base = F.greatest(F.lit(0.0), F.least(F.lit(0.85), wanted))
    return F.when(shadow, F.least(base, F.lit(0.26))).otherwise(base)


def steady_lower_mass(points: Column, fixed: Column) -> Column:
    """Smooths what lies below the upper third of the box."""
    b = box(points)
    split = b["y0"] + 0.34 * (b["y1"] - b["y0"])
    moved = blend(points, gaussian_closed(points, 1.3), 0.62, fixed)
    return F.zip_with(points, moved, lambda p, q: F.when(p["y"] > split, q).otherwise(p))


def slice_closed(points: Column, a: Column, b: Column) -> Column:
    """Points from place a to place b around the ring, both included."""
    n = F.size(points)
    return F.transform(F.sequence(a, a + F.pmod(b - a, n)), lambda k: at(points, k))


# Chains


def steps(points: Column) -> Column:
    """Lengths of a chain's edges."""
    before = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    after = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.zip_with(before, after, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def chain_length(points: Column, closed: bool) -> Column:
    last, first = F.get(points, F.size(points) - 1), F.get(points, F.lit(0))
    back = F.hypot(first["x"] - last["x"], first["y"] - last["y"]) if closed else F.lit(0.0)
    return F.when(F.size(points) < 2, 0.0).otherwise(_sum(steps(points)) + back)


def too_coarse(n_points: Column, n_segments: Column, length: Column, closed: bool) -> Column:
    """Whether a long chain of many points got fewer curves than its length asks for."""
    wanted = F.greatest(F.lit(3 if closed else 2), F.least(F.lit(12), F.bround(length / (120.0 if closed else 140.0)).cast("int")))
    return (n_points >= 8) & (n_segments < 12) & (length >= 120) & (n_segments < wanted)


def parameters(points: Column, power: float = 1.0) -> Column:
    """Parameters from 0 to 1 by length (power 1) or by its square root (power .5, centripetal); even ones for no length."""
    sizes = F.transform(steps(points), lambda v: F.pow(v, F.lit(power)))
    add = lambda run, v: F.concat(run, F.array(F.element_at(run, -1) + v))
    share = lambda run: F.transform(run, lambda v, k: F.when(F.element_at(run, -1) > 1e-12, v / F.element_at(run, -1)).otherwise(k / F.greatest(F.lit(1), F.size(run) - 1)))
    return F.aggregate(sizes, F.array(F.lit(0.0)), add, share)


def parameter_shift(a: Column, b: Column) -> Column:
    """The largest difference of two lists of parameters."""
    return F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u - v)))


def resample(points: Column, count: int) -> Column:
    """array<struct<i, x, y>>: `count` points at even lengths along a chain."""
    def place(points: Column, t: Column, k: Column) -> Column:
        want = k / float(count - 1)
        j = F.greatest(F.lit(0), F.least(F.size(points) - 2, F.size(F.filter(t, lambda v: v <= want)) - 1))
        p, q, u, v = F.get(points, j), F.get(points, j + 1), F.get(t, j), F.get(t, j + 1)
        s = F.when(v - u > 1e-12, (want - u) / F.nullif(v - u, F.lit(0.0))).otherwise(0.0)
        return F.struct(k.cast("int").alias("i"), (p["x"] + s * (q["x"] - p["x"])).alias("x"), (p["y"] + s * (q["y"] - p["y"])).alias("y"))

    every = F.sequence(F.lit(0), F.lit(count - 1))
    return let(points, lambda p: let(parameters(p), lambda t: F.transform(every, lambda k: place(p, t, k))))


def chord_deviations(points: Column) -> Column:
    """Distances of a chain's points from the segment between its ends."""
    a, b = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return F.transform(points, lambda p: deviation((p["x"], p["y"]), (a["x"], a["y"]), (b["x"], b["y"])))


def mirrored(points: Column, axis: Column) -> Column:
    """A chain followed by its mirror image, back to the start; the ends aren't repeated."""
    inner = F.slice(points, 2, F.greatest(F.size(points) - 2, F.lit(0)))
    back = F.transform(F.reverse(inner), lambda p: F.struct(p["i"].alias("i"), (2 * axis - p["x"]).alias("x"), p["y"].alias("y")))
    return F.concat(points, back)


def symmetric_profile(primary: Column, other: Column, axis: Column, share: float) -> Column:
    """Two chains of one length on either side of an axis: the first, drawn by a share to the mirror image of the second."""
    def join(p: Column, q: Column) -> Column:
        x, y = 2 * axis - q["x"], q["y"]
        return F.struct(p["i"].alias("i"), ((1 - share) * p["x"] + share * (p["x"] + x) / 2).alias("x"), ((1 - share) * p["y"] + share * (p["y"] + y) / 2).alias("y"))
    return F.zip_with(primary, other, join)

"""Least-squares curves and arcs through chains of points, by sums, and the gates that a fit must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrel.functions.scalars import confidence, falling, rising
from rastrel.operators import rings
from rastrel.operators.rings import KEY


def _with_ends(chain: DataFrame, key: str) -> DataFrame:
    whole = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return chain.select("*", F.first("x").over(whole).alias("ax"), F.first("y").over(whole).alias("ay"), F.last("x").over(whole).alias("bx"), F.last("y").over(whole).alias("by"))


def _largest(rows: DataFrame, error: Column, key: str, held: tuple[str, ...]) -> DataFrame:
    """The largest error and the first place that has it."""
    got = rows.groupBy(key, *held).agg(F.max(F.struct(F.round(error, 9).alias("r"), (-F.col("k")).alias("k"), error.alias("e"))).alias("m"))
    return got.select(key, *held, F.col("m.e").alias("error"), (-F.col("m.k")).alias("worst"))


def quadratic(chain: DataFrame, key: str = KEY) -> DataFrame:
    """(key, cx, cy, error, worst): the quadratic curve between a chain's ends (key, k, x, y, t) whose handle leaves the least
    squares, its largest error and where. Chains that leave the handle open are left out."""
    c = F.col
    t = c("t")
    w = 2 * t * (1 - t)
    rows = _with_ends(chain, key).select("*", w.alias("w"), *[(c(a) - (1 - t) * (1 - t) * c("a" + a) - t * t * c("b" + a)).alias("r" + a) for a in "xy"])
    sums = rows.groupBy(key).agg(F.sum(c("w") * c("w")).alias("ww"), F.sum(c("w") * c("rx")).alias("wx"), F.sum(c("w") * c("ry")).alias("wy"))
    solved = sums.where("ww > 1e-12").select(key, (c("wx") / c("ww")).alias("cx"), (c("wy") / c("ww")).alias("cy"))
    error = F.hypot(c("w") * c("cx") - c("rx"), c("w") * c("cy") - c("ry"))
    return _largest(rows.join(solved, key), error, key, ("cx", "cy"))


def cubic(chain: DataFrame, key: str = KEY) -> DataFrame:
    """(key, c1x, c1y, c2x, c2y, error, worst): as quadratic() with both handles of a cubic curve."""
    c = F.col
    t = c("t")
    s = 1 - t
    rows = _with_ends(chain, key).select("*", (3 * t * s * s).alias("u"), (3 * t * t * s).alias("v"), *[(c(a) - s * s * s * c("a" + a) - t * t * t * c("b" + a)).alias("r" + a) for a in "xy"])
    total = lambda a, b: F.sum(c(a) * c(b)).alias(a + b)
    sums = rows.groupBy(key).agg(total("u", "u"), total("v", "v"), total("u", "v"), total("u", "rx"), total("u", "ry"), total("v", "rx"), total("v", "ry"))
    det = c("uu") * c("vv") - c("uv") * c("uv")
    solved = sums.where(F.abs(det) > 1e-12).select(
        key, *[((c("u" + r) * c("vv") - c("v" + r) * c("uv")) / det).alias("c1" + r[1]) for r in ("rx", "ry")], *[((c("v" + r) * c("uu") - c("u" + r) * c("uv")) / det).alias("c2" + r[1]) for r in ("rx", "ry")],
    )
    error = F.hypot(c("u") * c("c1x") + c("v") * c("c2x") - c("rx"), c("u") * c("c1y") + c("v") * c("c2y") - c("ry"))
    return _largest(rows.join(solved, key), error, key, ("c1x", "c1y", "c2x", "c2y"))


def _unwrapped(rows: DataFrame, angle: Column, key: str) -> DataFrame:
    """rows with `angle` and `turn`, the way from the point before, at most half a turn."""
    order = Window.partitionBy(key).orderBy("i")
    got = rows.withColumn("angle", angle)
    step = F.col("angle") - F.lag("angle").over(order)
    return got.withColumn("turn", step - 2 * F.pi() * F.round(step / (2 * F.pi())))


def circular_arc(chain: DataFrame, key: str = KEY) -> DataFrame:
    """(key, cx, cy, r, start, sweep, confidence): the least-squares circle of a chain (key, i, x, y) and the way along it."""
    c = F.col
    rows = chain.join(rings.fit_circle_lsq(chain, key), key)
    rows = _unwrapped(rows.withColumn("d", F.hypot(c("x") - c("cx"), c("y") - c("cy"))), F.atan2(c("y") - c("cy"), c("x") - c("cx")), key)
    got = rows.groupBy(key, "cx", "cy", "r").agg(F.min_by("angle", "i").alias("start"), F.sum("turn").alias("sweep"), F.max(F.abs(c("d") - c("r"))).alias("off"), F.stddev_pop("d").alias("spread"))
    sure = confidence(falling(c("off") / F.greatest(F.lit(1.0), c("r")), 0, 0.12), falling(c("spread") / c("r"), 0, 0.10), rising(F.abs(F.degrees("sweep")), 18, 170))
    return got.where("r > 1e-6").select(key, "cx", "cy", "r", "start", "sweep", sure.alias("confidence"))


def elliptical_arc(points: DataFrame, key: str = KEY) -> DataFrame:
    """(key, rx, ry, angle, sweep, mean, max, confidence, large_arc, clockwise): the arc of a chain's fitted ellipse that its
    points (key, i, x, y) run through; turns of a degree or less are left out."""
    c = F.col
    fitted = rings.fit_ellipse(points, key).select(key, "cx", "cy", "rx", "ry", F.col("angle").alias("tilt"), "mean_error", F.col("confidence").alias("sure"))
    rows = points.join(fitted, key)
    u = (c("x") - c("cx")) * F.cos("tilt") + (c("y") - c("cy")) * F.sin("tilt")
    v = (c("y") - c("cy")) * F.cos("tilt") - (c("x") - c("cx")) * F.sin("tilt")
    rows = _unwrapped(rows.withColumn("u", u).withColumn("v", v), F.atan2(v / c("ry"), u / c("rx")), key)
    off = F.hypot(c("u") - c("rx") * F.cos("angle"), c("v") - c("ry") * F.sin("angle"))
    got = rows.groupBy(key, "rx", "ry", "tilt", "mean_error", "sure").agg(F.sum("turn").alias("sweep"), F.avg(off).alias("mean"), F.max(off).alias("max"))
    score = confidence(falling(c("max") / F.greatest(F.lit(1.0), F.least("rx", "ry")), 0, 0.16), falling(c("mean_error"), 0, 0.20), rising(F.abs(F.degrees("sweep")), 18, 170), c("sure"))
    return got.where(F.abs(F.degrees("sweep")) > 1).select(
        key, "rx", "ry", c("tilt").alias("angle"), "sweep", "mean", "max", score.alias("confidence"), (F.abs("sweep") > F.pi()).alias("large_arc"), (c("sweep") > 0).alias("clockwise"))


def anchor_distances(anchors: DataFrame, key: str = KEY) -> DataFrame:
    """(key, i, apart): places from each anchor (key, i, n) to the next, the shorter way around."""
    order = Window.partitionBy(key).orderBy("i")
    j = F.coalesce(F.lead("i").over(order), F.min("i").over(Window.partitionBy(key)))
    return anchors.withColumn("j", j).select(key, "i", distance_around(F.col("i"), F.col("j"), F.col("n")).alias("apart"))


def distance_around(i: Column, j: Column, n: Column) -> Column:
    return F.least(F.abs(i - j), n - F.abs(i - j))


# Gates of fitted primitives; numbers are fixed values.


def is_circle(error: Column, worst: Column, ratio: Column, circularity: Column, aspect: Column, sure: Column, tolerance: float = 0.055, least_round: float = 0.84, least: float = 0.9) -> Column:
    """Two tiers: nearly round ones pass by their worst error, others by every measure."""
    round_ = aspect.between(0.82, 1.18) & (worst <= max(0.08, 1.8 * tolerance)) & ratio.between(0.72, 1.08)
    strict = aspect.between(0.9, 1.1) & (error <= tolerance) & (worst <= 1.45 * tolerance) & (circularity >= least_round) & ratio.between(0.88, 1.12) & (sure >= least)
    return F.when(circularity > 0.88, round_).otherwise(strict)


def is_ellipse(error: Column, worst: Column, ratio: Column, sure: Column, tolerance: float = 0.085, least: float = 0.88) -> Column:
    return (error <= tolerance) & (worst <= 1.5 * tolerance) & ratio.between(0.84, 1.16) & (sure >= least)


def is_rectangle(error: Column, worst: Column, ratio: Column, sure: Column, tolerance: float = 1.0, least: float = 0.92) -> Column:
    """Errors in cells, not relative ones."""
    return (error <= tolerance) & (worst <= 1.6 * tolerance) & ratio.between(0.84, 1.16) & (sure >= least)


def is_rounded_rectangle(error: Column, worst: Column, ratio: Column, corner: Column, sure: Column, tolerance: float = 1.0, least: float = 0.9) -> Column:
    """corner: the radius over the shorter whole side."""
    return (error <= tolerance) & (worst <= 1.65 * tolerance) & ratio.between(0.8, 1.2) & corner.between(0.08, 0.28) & (sure >= least)


#: Of the primitive-first order by kind: least confidence, range of area ratio, bonus.
FIRST = {"circle": (0.88, 0.80, 1.20, 0.05), "ellipse": (0.84, 0.72, 1.30, 0.03), "rounded_rectangle": (0.88, 0.74, 1.26, 0.02), "rectangle": (0.90, 0.82, 1.18, 0.0)}


def accepts_first(kind: str, sure: Column, ratio: Column, hole: Column, aspect: Column | None = None, corner: Column | None = None) -> Column:
    """The gate of the primitive-first order; holes need .03 less, and may be round only. corner: over the shorter half side."""
    least, low, high, _ = FIRST[kind]
    ok = (sure >= F.when(hole, least - 0.03).otherwise(least)) & ratio.between(low, high)
    if kind == "circle":
        ok = ok & F.when(hole, aspect.between(0.84, 1.16)).otherwise(aspect.between(0.90, 1.10))
    if kind == "rounded_rectangle":
        ok = ok & corner.between(0.05, 0.30)
    return ok if kind in ("circle", "ellipse") else ok & ~hole


def first_score(kind: str, sure: Column, hole: Column) -> Column:
    return sure + FIRST[kind][3] + (F.when(hole, 0.04).otherwise(0.0) if kind in ("circle", "ellipse") else F.lit(0.0))

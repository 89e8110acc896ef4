"""Operators on closed rings of exploded points (ring_id, i, n, x, y): measures, corners, frames and fits.

Neighbours come from lag and lead within a ring and wrap by the ring's first and last point, so a
ring is sorted once for all of them. Sums over a ring are plain aggregates with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrel.functions.scalars import confidence, falling

KEY = "ring_id"


def neighbours(points: DataFrame, key: str = KEY) -> DataFrame:
    """points with the point before (px, py) and after (nx, ny), around the ring."""
    order = Window.partitionBy(key).orderBy("i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.lag(c).over(order), F.last(c).over(whole))
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return points.select("*", before("x").alias("px"), before("y").alias("py"), after("x").alias("nx"), after("y").alias("ny"))


def measures(points: DataFrame, key: str = KEY) -> DataFrame:
    """(key, n, area, perimeter, min_x .. max_y, cx, cy, circularity): signed area, closed length, box,
    area centroid (the mean where the area vanishes) and 4 pi area / perimeter squared, at most 1."""
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    sums = neighbours(points, key).groupBy(key).agg(
        F.count("*").alias("n"), (F.sum(cross) / 2).alias("a"), F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("perimeter"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.sum((F.col("x") + F.col("nx")) * cross).alias("sx"), F.sum((F.col("y") + F.col("ny")) * cross).alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
    )
    flat = F.abs("a") < 1e-9
    out = sums.select(
        key, "n", F.when(F.col("n") < 3, 0.0).otherwise(F.col("a")).alias("area"), F.when(F.col("n") < 2, 0.0).otherwise(F.col("perimeter")).alias("perimeter"),
        "min_x", "min_y", "max_x", "max_y",
        F.when(flat, F.col("mx")).otherwise(F.col("sx") / (6 * F.nullif(F.col("a"), F.lit(0.0)))).alias("cx"),
        F.when(flat, F.col("my")).otherwise(F.col("sy") / (6 * F.nullif(F.col("a"), F.lit(0.0)))).alias("cy"),
    )
    round_ = F.when(F.col("perimeter") > 1e-9, F.least(F.lit(1.0), 4 * F.pi() * F.abs("area") / (F.col("perimeter") * F.col("perimeter")))).otherwise(0.0)
    return out.withColumn("circularity", round_)


def interior_angle(px: Column, py: Column, x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """Degrees between the edges to both neighbours; 180 where an edge has no length."""
    ax, ay, bx, by = px - x, py - y, nx - x, ny - y
    a, b = F.hypot(ax, ay), F.hypot(bx, by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / F.nullif(a * b, F.lit(0.0))))
    return F.when((a < 1e-9) | (b < 1e-9), 180.0).otherwise(F.degrees(F.acos(cosine)))


def angles(points: DataFrame, key: str = KEY) -> DataFrame:
    """points with neighbours and `angle`, the interior angle in degrees."""
    c = F.col
    return neighbours(points, key).withColumn("angle", interior_angle(c("px"), c("py"), c("x"), c("y"), c("nx"), c("ny")))


def hard_corners(points: DataFrame, turn: float = 60.0, key: str = KEY) -> DataFrame:
    """Points where the ring turns by `turn` degrees or more."""
    return angles(points, key).where(180.0 - F.col("angle") >= turn)


def curvature_variance(points: DataFrame, key: str = KEY) -> DataFrame:
    """(key, variance): population variance of the turn in radians; infinite for fewer than five points."""
    got = angles(points, key).groupBy(key).agg(F.count("*").alias("n"), F.var_pop(F.radians(180.0 - F.col("angle"))).alias("v"))
    return got.select(key, F.when(F.col("n") < 5, F.lit(float("inf"))).otherwise(F.col("v")).alias("variance"))


def corner_classes(points: DataFrame, smallest: float = 124.0, sharp: float = 92.0, smooth: float = 144.0, ratio: float = 0.11, most: float = 3.25, key: str = KEY) -> DataFrame:
    """Points that are corner candidates, with `kind`: sharp, fillet or smooth.

    Wider angles than all three thresholds are none. Between sharp and smallest, uneven edges make a sharp corner;
    else a fillet where one fits, or sharp up to sharp + 10 degrees."""
    c = F.col
    edge_a, edge_b = F.hypot(c("px") - c("x"), c("py") - c("y")), F.hypot(c("nx") - c("x"), c("ny") - c("y"))
    got = angles(points, key).withColumn("short", F.least(edge_a, edge_b)).withColumn("long", F.greatest(edge_a, edge_b))
    half = F.radians(c("angle")) / 2
    radius = F.least(F.lit(most), c("short") * ratio, 0.9 * 0.24 * c("short") * F.tan(half))
    trim = radius / F.nullif(F.tan(half), F.lit(0.0))
    feasible = (c("short") > 1) & (radius > 0.2) & (trim > 0.2) & (2 * trim * F.sin(half) > 0.5)
    even = c("short") / F.nullif(c("long"), F.lit(0.0)) >= 0.58
    kind = (
        F.when(c("angle") <= sharp, "sharp")
        .when(c("angle") <= smallest, F.when(~F.coalesce(even, F.lit(False)), "sharp").when(feasible, "fillet").when(c("angle") <= sharp + 10, "sharp").otherwise("smooth"))
        .otherwise("smooth")
    )
    return got.where(c("angle") <= max(smallest, sharp, smooth)).withColumn("kind", kind).drop("short", "long")


def fillets(points: DataFrame, sharp: float = 92.0, smallest: float = 124.0, ratio: float = 0.11, most: float = 3.25, key: str = KEY) -> DataFrame:
    """(key, i, radius, trim, entry_x .. exit_y, c1x .. c2y, sweep): the fillets that fit the corners of rings.

    The nearer an angle is to `sharp`, the smaller the radius; uneven edges, short ones and flat corners have none."""
    c = F.col
    rows = angles(points, key).withColumn("ea", F.hypot(c("px") - c("x"), c("py") - c("y"))).withColumn("eb", F.hypot(c("nx") - c("x"), c("ny") - c("y")))
    short, theta = F.least("ea", "eb"), F.radians("angle")
    scale = F.greatest(F.lit(0.25), F.least(F.lit(1.0), (c("angle") - sharp) / (smallest - sharp))) if smallest > sharp else F.lit(1.0)
    radius = F.least(F.lit(most), short * ratio * scale, 0.9 * 0.24 * short * F.tan(theta / 2))
    rows = rows.where((theta > 0) & (theta < F.pi() - 1e-3) & (short > 1) & (short / F.greatest("ea", "eb") >= 0.58)).withColumn("radius", radius).where("radius > 0.2")
    rows = rows.withColumn("trim", c("radius") / F.tan(theta / 2)).where("trim > 0.2")
    out = {f"{n}_{a}": c(a) + (c(f"{p}{a}") - c(a)) / c(e) * c("trim") for n, p, e in (("entry", "p", "ea"), ("exit", "n", "eb")) for a in "xy"}
    rows = rows.withColumns(out).where(F.hypot(c("exit_x") - c("entry_x"), c("exit_y") - c("entry_y")) > 0.5)
    handle = 4 / 3 * F.tan((F.pi() - theta) / 4) * c("radius")
    ends = {f"c{k}{a}": c(f"{n}_{a}") - (c(f"{p}{a}") - c(a)) / c(e) * handle for k, n, p, e in ((1, "entry", "p", "ea"), (2, "exit", "n", "eb")) for a in "xy"}
    way = (c("x") - c("entry_x")) * (c("exit_y") - c("y")) - (c("y") - c("entry_y")) * (c("exit_x") - c("x"))
    return rows.withColumns(ends).select(key, "i", "radius", "trim", *out, *ends, (way > 0).alias("sweep"))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / F.nullif(square, F.lit(0.0))))
    return F.when(square < 1e-12, F.hypot(x - ax, y - ay)).otherwise(F.hypot(x - ax - t * dx, y - ay - t * dy))


def drop_collinear(points: DataFrame, tolerance: float = 0.35, key: str = KEY) -> DataFrame:
    """points without those within tolerance of the line between their neighbours; a ring that would keep fewer than three stays."""
    c = F.col
    far = neighbours(points, key).withColumn("keep", segment_distance(c("x"), c("y"), c("px"), c("py"), c("nx"), c("ny")) > tolerance)
    left = F.sum(c("keep").cast("int")).over(Window.partitionBy(key))
    return far.withColumn("left", left).where(c("keep") | (c("left") < 3)).select(points.columns)


def frames(points: DataFrame, key: str = KEY) -> DataFrame:
    """(key, mx, my, angle, cx, cy, half_u, half_v): the principal axes (angle of the larger one) and, in
    that frame, the centre and half extents of the points. Two aggregates, joined by ring."""
    c = F.col
    sums = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "y").alias("sxy"), F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"))
    turn = sums.select(key, "mx", "my", (0.5 * F.atan2(2 * c("sxy"), c("sxx") - c("syy"))).alias("angle"))
    local = points.join(turn, key).select(
        key, "mx", "my", "angle",
        ((c("x") - c("mx")) * F.cos("angle") + (c("y") - c("my")) * F.sin("angle")).alias("u"),
        ((c("y") - c("my")) * F.cos("angle") - (c("x") - c("mx")) * F.sin("angle")).alias("v"),
    )
    box = local.groupBy(key, "mx", "my", "angle").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    mu, mv = (c("u0") + c("u1")) / 2, (c("v0") + c("v1")) / 2
    return box.select(
        key, "mx", "my", "angle",
        (c("mx") + mu * F.cos("angle") - mv * F.sin("angle")).alias("cx"), (c("my") + mu * F.sin("angle") + mv * F.cos("angle")).alias("cy"),
        ((c("u1") - c("u0")) / 2).alias("half_u"), ((c("v1") - c("v0")) / 2).alias("half_v"),
    )


def _local(points: DataFrame, key: str) -> DataFrame:
    c = F.col
    return points.join(frames(points, key), key).select(
        key, "angle", "cx", "cy", "half_u", "half_v",
        ((c("x") - c("cx")) * F.cos("angle") + (c("y") - c("cy")) * F.sin("angle")).alias("u"),
        ((c("y") - c("cy")) * F.cos("angle") - (c("x") - c("cx")) * F.sin("angle")).alias("v"),
    )


def fit_ellipse(points: DataFrame, key: str = KEY) -> DataFrame:
    """(key, cx, cy, rx, ry, angle, mean_error, max_error, confidence) of the frame's ellipse; rings of eight points or more."""
    c = F.col
    area = measures(points, key).select(key, F.abs("area").alias("area"))
    q = F.abs(F.pow(c("u") / F.nullif(c("half_u"), F.lit(0.0)), 2) + F.pow(c("v") / F.nullif(c("half_v"), F.lit(0.0)), 2) - 1)
    got = _local(points, key).groupBy(key, "cx", "cy", "half_u", "half_v", "angle").agg(F.avg(q).alias("mean_error"), F.max(q).alias("max_error"), F.count("*").alias("n"))
    share = F.abs(1 - c("area") / (F.pi() * c("half_u") * c("half_v")))
    score = confidence(falling(c("mean_error"), 0, 0.14), falling(c("max_error"), 0, 0.22), falling(share, 0, 0.18))
    return got.join(area, key).where((c("n") >= 8) & (F.least("half_u", "half_v") > 1e-6)).select(
        key, "cx", "cy", c("half_u").alias("rx"), c("half_v").alias("ry"), "angle", "mean_error", "max_error", score.alias("confidence"))


def signed_box(u: Column, v: Column, half_u: Column, half_v: Column) -> Column:
    """Signed distance to a box around the origin: negative inside."""
    dx, dy = F.abs(u) - half_u, F.abs(v) - half_v
    return F.hypot(F.greatest(dx, F.lit(0.0)), F.greatest(dy, F.lit(0.0))) + F.least(F.greatest(dx, dy), F.lit(0.0))


def signed_round_box(u: Column, v: Column, half_u: Column, half_v: Column, radius: Column) -> Column:
    return signed_box(u, v, half_u - radius, half_v - radius) - radius


def fit_rectangle(points: DataFrame, key: str = KEY) -> DataFrame:
    """(key, cx, cy, width, height, angle, mean_error, max_error, confidence) of the frame's rectangle."""
    c = F.col
    area = measures(points, key).select(key, F.abs("area").alias("area"))
    away = F.abs(signed_box(c("u"), c("v"), c("half_u"), c("half_v"))) / F.greatest(F.lit(1.0), F.least("half_u", "half_v"))
    got = _local(points, key).groupBy(key, "cx", "cy", "half_u", "half_v", "angle").agg(F.avg(away).alias("mean_error"), F.max(away).alias("max_error"))
    share = F.abs(1 - c("area") / (4 * c("half_u") * c("half_v")))
    score = confidence(falling(c("mean_error"), 0, 0.06), falling(c("max_error"), 0, 0.12), falling(share, 0, 0.14))
    return got.join(area, key).where(F.least("half_u", "half_v") > 1e-6).select(
        key, "cx", "cy", (2 * c("half_u")).alias("width"), (2 * c("half_v")).alias("height"), "angle", "mean_error", "max_error", score.alias("confidence"))


def fit_rounded_rectangle(points: DataFrame, steps: int = 16, key: str = KEY) -> DataFrame:
    """As fit_rectangle with the corner radius, of `steps` from 10 to 100 % of .48 times the shorter half side, that fits best."""
    c = F.col
    area = measures(points, key).select(key, F.abs("area").alias("area"))
    short = F.least("half_u", "half_v")
    share = F.explode(F.array(*[F.lit(0.1 + 0.9 * k / (steps - 1)) for k in range(steps)]))
    tried = _local(points, key).select("*", share.alias("part")).withColumn("radius", c("part") * 0.48 * short)
    away = F.abs(signed_round_box(c("u"), c("v"), c("half_u"), c("half_v"), c("radius"))) / F.greatest(F.lit(1.0), short)
    by = tried.groupBy(key, "cx", "cy", "half_u", "half_v", "angle", "radius").agg(F.avg(away).alias("mean_error"), F.max(away).alias("max_error"))
    best = by.groupBy(key, "cx", "cy", "half_u", "half_v", "angle").agg(F.min(F.struct(F.round("mean_error", 9).alias("e"), "radius", "mean_error", "max_error")).alias("b")).select("*", "b.*").drop("b", "e")
    filled = 4 * c("half_u") * c("half_v") - (4 - F.pi()) * c("radius") * c("radius")
    score = confidence(falling(c("mean_error"), 0, 0.07), falling(c("max_error"), 0, 0.14), falling(F.abs(1 - c("area") / filled), 0, 0.18), 1 - falling(c("radius") / short, 0.12, 0.38))
    return best.join(area, key).where(short > 1e-6).select(
        key, "cx", "cy", (2 * c("half_u")).alias("width"), (2 * c("half_v")).alias("height"), "angle", "radius", "mean_error", "max_error", score.alias("confidence"))


def fit_circle_lsq(points: DataFrame, key: str = KEY) -> DataFrame:
    """(key, cx, cy, r): the algebraic least-squares circle from sums of powers about the mean."""
    c = F.col
    middle = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u, v = c("x") - c("mx"), c("y") - c("my")
    total = lambda *xs: F.sum(_product(xs))
    sums = points.join(middle, key).groupBy(key, "mx", "my").agg(
        F.count("*").alias("n"), total(u, u).alias("uu"), total(v, v).alias("vv"), total(u, v).alias("uv"), total(u, u, u).alias("uuu"),
        total(v, v, v).alias("vvv"), total(u, v, v).alias("uvv"), total(v, u, u).alias("vuu"),
    )
    p, q = (c("uuu") + c("uvv")) / 2, (c("vvv") + c("vuu")) / 2
    det = c("uu") * c("vv") - c("uv") * c("uv")
    a, b = (p * c("vv") - q * c("uv")) / det, (q * c("uu") - p * c("uv")) / det
    return sums.where((c("n") >= 3) & (F.abs(det) > 1e-12)).select(key, (c("mx") + a).alias("cx"), (c("my") + b).alias("cy"), F.sqrt(a * a + b * b + (c("uu") + c("vv")) / c("n")).alias("r"))


def _product(xs: tuple[Column, ...]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out * x
    return out


def narrow_gaps(points: DataFrame, distance: float = 10.0, span: int = 2, apart: int = 3, key: str = KEY) -> DataFrame:
    """(key, i): points within `span` places of a pair at least `apart` places and at most `distance` apart.

    Points are dealt to square cells of that distance, and each meets its own and the eight cells around only."""
    c = F.col
    cell = lambda v: F.floor(v / distance)
    own = points.select(key, "i", "n", "x", "y", cell(c("x")).alias("gx"), cell(c("y")).alias("gy"))
    shift = lambda v: F.explode(F.array(*[c(v) + d for d in (-1, 0, 1)]))
    other = points.select(key, c("i").alias("j"), c("x").alias("ox"), c("y").alias("oy"), cell(c("x")).alias("hx"), cell(c("y")).alias("hy"))
    other = other.select(key, "j", "ox", "oy", shift("hx").alias("gx"), "hy").select(key, "j", "ox", "oy", "gx", shift("hy").alias("gy"))
    apart_by = F.least(F.abs(c("i") - c("j")), c("n") - F.abs(c("i") - c("j")))
    near = own.join(other, [key, "gx", "gy"]).where((apart_by >= apart) & (F.hypot(c("x") - c("ox"), c("y") - c("oy")) <= distance)).select(key, "i", "n").distinct()
    around = F.explode(F.array(*[F.pmod(c("i") + d, c("n")) for d in range(-span, span + 1)]))
    return near.select(key, around.alias("i")).distinct()


def spans(points: DataFrame, flag: Column, key: str = KEY) -> DataFrame:
    """points with `span`, the number of flagged points up to each one around the ring: the points between two
    anchors share a span, and those before the first belong to the last one's."""
    order = Window.partitionBy(key).orderBy("i")
    run = F.sum(flag.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(flag.cast("int")).over(Window.partitionBy(key))
    return points.select("*", F.when(run == 0, total).otherwise(run).alias("span"))


def smooth_box(values: DataFrame, key: str, value: str, radius: int = 2) -> DataFrame:
    """values (key, k, n, ...) with `smooth`: the circular mean over 2 * radius + 1 places.

    Each value is dealt to its places and averaged, so the ends wrap without a self-join."""
    c = F.col
    dealt = values.select(key, F.explode(F.array(*[F.pmod(c("k") + d, c("n")) for d in range(-radius, radius + 1)])).alias("k"), c(value).alias("v"))
    return values.join(dealt.groupBy(key, "k").agg(F.avg("v").alias("smooth")), [key, "k"])


def radial_symmetry(values: DataFrame, key: str = "shape_id") -> DataFrame:
    """(key, symmetry): 1 less the mean gap between opposite radii over the mean radius, at least 0."""
    c = F.col
    other = values.select(key, F.pmod(c("k") + (c("n") / 2).cast("int"), c("n")).alias("k"), c("r").alias("o"))
    got = values.join(other, [key, "k"]).groupBy(key).agg(F.avg(F.abs(c("r") - c("o"))).alias("gap"), F.avg("r").alias("mean"))
    return got.select(key, F.when(c("mean") <= 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - c("gap") / c("mean"))).alias("symmetry"))


def star_signature(values: DataFrame, arms: tuple[int, ...] = (3, 4, 5, 6, 7, 8), key: str = "shape_id") -> DataFrame:
    """(key, arms, contrast): the number of arms whose alternating sectors differ most in mean radius, relative to their sum."""
    c = F.col
    tried = values.select(key, "k", "n", "r", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arms"))
    sector = F.floor(c("k") * 2 * c("arms") / c("n")).cast("int")
    parts = tried.withColumn("sector", sector).groupBy(key, "arms", "sector").agg(F.avg("r").alias("m"))
    by = parts.groupBy(key, "arms").agg(F.avg(F.when(c("sector") % 2 == 0, c("m"))).alias("a"), F.avg(F.when(c("sector") % 2 == 1, c("m"))).alias("b"))
    scored = by.select(key, "arms", (F.abs(c("a") - c("b")) / F.nullif(c("a") + c("b"), F.lit(0.0))).alias("contrast"))
    return scored.groupBy(key).agg(F.max(F.struct(F.round("contrast", 9).alias("contrast"), (-c("arms")).alias("arms"))).alias("b")).select(key, (-c("b.arms")).alias("arms"), c("b.contrast").alias("contrast"))

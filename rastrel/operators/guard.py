"""Topology guard: box overlap, point in polygon, crossing edges, sampled curves and the area gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.operators.rings import KEY, neighbours

Box = tuple[Column, Column, Column, Column]


def box_iou(a: Box, b: Box) -> Column:
    """Shared over joint area of two boxes (min_x, min_y, max_x, max_y); 1 where both have no area."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(joint <= 1e-9, 1.0).otherwise(both / F.nullif(joint, F.lit(0.0)))


def points_inside(probes: DataFrame, points: DataFrame, key: str = KEY) -> DataFrame:
    """probes (key, k, qx, qy) with `inside`, by the number of edges to the right; joined by ring, counted before the shuffle."""
    c = F.col
    edges = neighbours(points, key).select(key, "x", "y", "nx", "ny")
    over = ((c("y") > c("qy")) != (c("ny") > c("qy"))) & (c("qx") < (c("nx") - c("x")) * (c("qy") - c("y")) / F.nullif(c("ny") - c("y"), F.lit(0.0)) + c("x"))
    return probes.join(edges, key).groupBy(key, "k", "qx", "qy").agg((F.sum(F.coalesce(over, F.lit(False)).cast("int")) % 2 == 1).alias("inside"))


def crossings(points: DataFrame, cell: float = 8.0, key: str = KEY) -> DataFrame:
    """(key, crossings): pairs of edges that aren't neighbours and properly cross; rings without any are left out.

    Edges are dealt to the grid cells that their boxes touch, so an edge meets those near it only."""
    c = F.col
    edges = neighbours(points, key).select(key, "i", "n", c("x").alias("ax"), c("y").alias("ay"), c("nx").alias("bx"), c("ny").alias("by"))
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    dealt = edges.select("*", reach(c("ax"), c("bx")).alias("gx")).select("*", reach(c("ay"), c("by")).alias("gy"))
    other = dealt.select(key, "gx", "gy", c("i").alias("j"), *[c(x).alias("o" + x) for x in ("ax", "ay", "bx", "by")])
    side = lambda p, q, r, s, x, y: (r - p) * (y - q) - (s - q) * (x - p)
    e, f = (c("ax"), c("ay"), c("bx"), c("by")), (c("oax"), c("oay"), c("obx"), c("oby"))
    cross = (side(*e, f[0], f[1]) * side(*e, f[2], f[3]) < 0) & (side(*f, e[0], e[1]) * side(*f, e[2], e[3]) < 0)
    near = (c("j") > c("i") + 1) & ~((c("i") == 0) & (c("j") == c("n") - 1))
    return dealt.join(other, [key, "gx", "gy"]).where(near & cross).select(key, "i", "j").distinct().groupBy(key).agg(F.count("*").alias("crossings"))


def cubic_points(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column], q: tuple[Column, Column], steps: int = 12) -> Column:
    """array<struct<x, y>> at steps + 1 even parameters of a cubic curve."""
    def at(k: Column, axis: int) -> Column:
        t = k / float(steps)
        s = 1 - t
        return s * s * s * p[axis] + 3 * s * s * t * a[axis] + 3 * s * t * t * b[axis] + t * t * t * q[axis]
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.struct(at(k, 0).alias("x"), at(k, 1).alias("y")))


def quadratic_points(p: tuple[Column, Column], a: tuple[Column, Column], q: tuple[Column, Column], steps: int = 12) -> Column:
    def at(k: Column, axis: int) -> Column:
        t = k / float(steps)
        s = 1 - t
        return s * s * p[axis] + 2 * s * t * a[axis] + t * t * q[axis]
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.struct(at(k, 0).alias("x"), at(k, 1).alias("y")))


def arc_points(cx: Column, cy: Column, rx: Column, ry: Column, turn: Column, start: Column, sweep: Column, steps: int = 12) -> Column:
    """array<struct<x, y>> along an elliptical arc; angles in radians."""
    def point(k: Column) -> Column:
        t = start + sweep * k / float(steps)
        u, v = rx * F.cos(t), ry * F.sin(t)
        return F.struct((cx + u * F.cos(turn) - v * F.sin(turn)).alias("x"), (cy + u * F.sin(turn) + v * F.cos(turn)).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), point)


def gate(area_before: Column, area_after: Column, iou: Column, simple: Column, hole: Column) -> Column:
    """Whether a fitted ring may stand for its contour: area within 12 % (holes 16 %), box overlap from .68 (.56), no crossing."""
    error = F.abs(F.abs(area_after) - F.abs(area_before)) / F.greatest(F.lit(1.0), F.abs(area_before))
    return simple & (error <= F.when(hole, 0.16).otherwise(0.12)) & (iou >= F.when(hole, 0.56).otherwise(0.68))


# Cross products and distances that count as none.
FLAT, TOUCH = 1e-8, 1e-6
Pair = tuple[Column, Column]


def side(a: Pair, b: Pair, p: Pair) -> Column:
    """Cross product of b - a and p - a: positive where p lies to the left."""
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def orientation(a: Pair, b: Pair, c: Pair) -> Column:
    """0 on one line, 1 clockwise, 2 counter-clockwise, as y goes up."""
    cross = side(a, b, c)
    return F.when(F.abs(cross) <= FLAT, 0).when(cross < 0, 1).otherwise(2)


def in_box(a: Pair, b: Pair, p: Pair) -> Column:
    held = lambda k: (p[k] >= F.least(a[k], b[k]) - FLAT) & (p[k] <= F.greatest(a[k], b[k]) + FLAT)
    return held(0) & held(1)


def on_segment(a: Pair, b: Pair, p: Pair) -> Column:
    return (orientation(a, b, p) == 0) & in_box(a, b, p)


def shares_end(a: Pair, b: Pair, c: Pair, d: Pair) -> Column:
    near = lambda p, q: F.hypot(p[0] - q[0], p[1] - q[1]) <= TOUCH
    return near(a, c) | near(a, d) | near(b, c) | near(b, d)


def meet(a: Pair, b: Pair, c: Pair, d: Pair) -> Column:
    """Whether a-b and c-d cross, touch or lie on each other; segments that share an end don't count."""
    proper = (orientation(a, b, c) != orientation(a, b, d)) & (orientation(c, d, a) != orientation(c, d, b))
    touch = on_segment(a, b, c) | on_segment(a, b, d) | on_segment(c, d, a) | on_segment(c, d, b)
    return (proper | touch) & ~shares_end(a, b, c, d)


def vector_angle(u: Pair, v: Pair) -> Column:
    """Signed angle from u to v in radians; 0 where one has no length."""
    short = (F.hypot(*u) < 1e-12) | (F.hypot(*v) < 1e-12)
    return F.when(short, 0.0).otherwise(F.atan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1]))


def _dealt(points: DataFrame, cell: float, key: str) -> DataFrame:
    """Edges (key, i, n, ax, ay, bx, by) in every grid cell (gx, gy) that their boxes touch."""
    c = F.col
    edges = neighbours(points, key).select(key, "i", "n", c("x").alias("ax"), c("y").alias("ay"), c("nx").alias("bx"), c("ny").alias("by"))
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    return edges.select("*", reach(c("ax"), c("bx")).alias("gx")).select("*", reach(c("ay"), c("by")).alias("gy"))


_EDGE = ("ax", "ay", "bx", "by")


def _ends(prefix: str = "") -> tuple[Pair, Pair]:
    c = lambda n: F.col(prefix + n)
    return (c("ax"), c("ay")), (c("bx"), c("by"))


def edge_meetings(points: DataFrame, cell: float = 8.0, key: str = KEY) -> DataFrame:
    """(key, i, j): pairs of edges of a ring, not neighbours, that cross, touch or overlap; by grid cells as in crossings()."""
    c = F.col
    dealt = _dealt(points, cell, key)
    other = dealt.select(key, "gx", "gy", c("i").alias("j"), *[c(n).alias("o" + n) for n in _EDGE])
    apart = (c("j") > c("i") + 1) & ~((c("i") == 0) & (c("j") == c("n") - 1))
    return dealt.join(other, [key, "gx", "gy"]).where(apart & meet(*_ends(), *_ends("o"))).select(key, "i", "j").distinct()


def rings_meet(left: DataFrame, right: DataFrame, cell: float = 8.0, key: str = KEY) -> DataFrame:
    """(key, meet): whether any edge of a ring meets one of the ring of the same key on the right."""
    c = F.col
    other = _dealt(right, cell, key).select(key, "gx", "gy", *[c(n).alias("o" + n) for n in _EDGE])
    hits = _dealt(left, cell, key).join(other, [key, "gx", "gy"]).where(meet(*_ends(), *_ends("o"))).select(key).distinct().withColumn("hit", F.lit(True))
    return left.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("hit", F.lit(False)).alias("meet"))


def winding_inside(probes: DataFrame, points: DataFrame, key: str = KEY) -> DataFrame:
    """probes (key, k, qx, qy) with `inside` by winding number; points on the boundary are inside."""
    c = F.col
    edges = neighbours(points, key).select(key, "x", "y", "nx", "ny")
    a, b, q = (c("x"), c("y")), (c("nx"), c("ny")), (c("qx"), c("qy"))
    left = side(a, b, q)
    turn = F.when((c("y") <= c("qy")) & (c("ny") > c("qy")) & (left > 0), 1).when((c("y") > c("qy")) & (c("ny") <= c("qy")) & (left < 0), -1).otherwise(0)
    got = probes.join(edges, key).groupBy(key, "k", "qx", "qy").agg(F.sum(turn).alias("w"), F.bool_or(on_segment(a, b, q)).alias("on"))
    return got.select(key, "k", "qx", "qy", (c("on") | (c("w") != 0)).alias("inside"))


def shape_topology(outer: DataFrame, holes: DataFrame, fitted_outer: DataFrame, fitted_holes: DataFrame, key: str = KEY) -> DataFrame:
    """(key, outer_ok, hole_ok, inside, apart, valid): a shape of one outer ring and one hole against its contours.

    All four tables are points of rings by the same key: both loops pass the area and box gate and don't meet themselves,
    the hole's middle lies in the outer loop, and the two don't meet. Keys without a hole have a null for each of its tests."""
    from rastrel.operators.rings import measures

    c = F.col
    names = ("min_x", "min_y", "max_x", "max_y")

    def gated(source: DataFrame, fitted: DataFrame, hole: bool, name: str) -> DataFrame:
        own = measures(source, key).select(key, c("area").alias("a0"), *[c(n).alias("s_" + n) for n in names])
        new = measures(fitted, key).select(key, c("area").alias("a1"), *names, c("cx").alias(name + "_x"), c("cy").alias(name + "_y"))
        crossed = edge_meetings(fitted, key=key).select(key).distinct().withColumn("crossed", F.lit(True))
        iou = box_iou(tuple(c(n) for n in names), tuple(c("s_" + n) for n in names))
        ok = gate(c("a0"), c("a1"), iou, c("crossed").isNull(), F.lit(hole))
        return own.join(new, key).join(crossed, key, "left").select(key, ok.alias(name + "_ok"), name + "_x", name + "_y")

    rows = gated(outer, fitted_outer, False, "outer").join(gated(holes, fitted_holes, True, "hole"), key, "left")
    probes = rows.where(c("hole_x").isNotNull()).select(key, F.lit(0).alias("k"), c("hole_x").alias("qx"), c("hole_y").alias("qy"))
    inside = winding_inside(probes, fitted_outer, key).select(key, "inside")
    apart = rings_meet(fitted_holes, fitted_outer, key=key).select(key, (~c("meet")).alias("apart"))
    got = rows.join(inside, key, "left").join(apart, key, "left")
    whole = c("outer_ok") & F.coalesce(c("hole_ok") & c("inside") & c("apart"), F.lit(True))
    return got.select(key, "outer_ok", "hole_ok", "inside", "apart", whole.alias("valid"))

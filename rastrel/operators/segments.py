"""Typed path segments as structs: builders, loops, evaluation, path text, scaling and mirroring, all as columns.

A segment's kind is L, A (circular), E (elliptical), Q or C; what a kind has no use for is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastrel.functions.scalars import format_number, let

#: Handle of a cubic quarter circle in radii.
QUARTER = 0.5523
NUMBERS = ("sx", "sy", "ex", "ey", "c1x", "c1y", "c2x", "c2y", "rx", "ry", "rot")
SEGMENT = "struct<kind:string," + ",".join(f"{n}:double" for n in NUMBERS) + ",large_arc:boolean,sweep:boolean>"
PRIMITIVE = "struct<kind:string,cx:double,cy:double,rx:double,ry:double,rot:double,radius:double>"
LOOP = f"struct<loop_id:string,polarity:string,source:string,confidence:double,primitive:{PRIMITIVE},segments:array<{SEGMENT}>>"
Pair = tuple[Column, Column]


def segment(kind: str, start: Pair, end: Pair, c1: Pair | None = None, c2: Pair | None = None, rx: Column | None = None, ry: Column | None = None, rot: Column | None = None, large: Column | bool | None = None, sweep: Column | bool | None = None) -> Column:
    values = (*start, *end, *(c1 or (None, None)), *(c2 or (None, None)), rx, ry, rot)
    number = lambda v: F.lit(None).cast("double") if v is None else v.cast("double")
    flag = lambda v: v if isinstance(v, Column) else F.lit(v).cast("boolean")
    return F.struct(F.lit(kind).alias("kind"), *[number(v).alias(n) for n, v in zip(NUMBERS, values, strict=True)], flag(large).alias("large_arc"), flag(sweep).alias("sweep"))


def line(a: Pair, b: Pair) -> Column:
    return segment("L", a, b)


def _ends(s: Column) -> tuple[Pair, Pair, Pair, Pair]:
    return (s["sx"], s["sy"]), (s["ex"], s["ey"]), (s["c1x"], s["c1y"]), (s["c2x"], s["c2y"])


def _between(a: Pair, b: Pair, share: float) -> Pair:
    return a[0] + (b[0] - a[0]) * share, a[1] + (b[1] - a[1]) * share


def line_as_cubic(s: Column) -> Column:
    a, b, _, _ = _ends(s)
    return segment("C", a, b, _between(a, b, 1 / 3), _between(b, a, 1 / 3))


def quadratic_as_cubic(s: Column) -> Column:
    a, b, c, _ = _ends(s)
    return segment("C", a, b, _between(a, c, 2 / 3), _between(b, c, 2 / 3))


def held_handle(origin: Pair, handle: Pair, other: Pair, most: float = 0.45) -> Pair:
    """A handle no longer than a share of the chord."""
    size, chord = F.hypot(handle[0] - origin[0], handle[1] - origin[1]), F.hypot(other[0] - origin[0], other[1] - origin[1])
    share = F.when((size <= most * chord) | (size < 1e-12), 1.0).otherwise(most * chord / F.nullif(size, F.lit(0.0)))
    return origin[0] + (handle[0] - origin[0]) * share, origin[1] + (handle[1] - origin[1]) * share


def catmull_rom(before: Pair, a: Pair, b: Pair, after: Pair, tension: float = 0.72) -> Column:
    """The cubic from a to b whose tangents follow the points around."""
    c = held_handle(a, (a[0] + (b[0] - before[0]) * tension / 6, a[1] + (b[1] - before[1]) * tension / 6), b)
    d = held_handle(b, (b[0] - (after[0] - a[0]) * tension / 6, b[1] - (after[1] - a[1]) * tension / 6), a)
    return segment("C", a, b, c, d)


def cardinal(before: Pair, a: Pair, b: Pair, after: Pair, tension: float = 0.16) -> Column:
    c, d = ((a[0] + tension * (b[0] - before[0]), a[1] + tension * (b[1] - before[1])), (b[0] - tension * (after[0] - a[0]), b[1] - tension * (after[1] - a[1])))
    return segment("C", a, b, c, d)


def chord(s: Column) -> Column:
    return F.hypot(s["ex"] - s["sx"], s["ey"] - s["sy"])


def merged_cubic(left: Column, right: Column) -> Column:
    """One cubic over two that meet: the outer handles stay."""
    return segment("C", (left["sx"], left["sy"]), (right["ex"], right["ey"]), (left["c1x"], left["c1y"]), (right["c2x"], right["c2y"]))


def point_at(s: Column, t: Column | float) -> Pair:
    """A line's, quadratic's or cubic's point at t."""
    t = F.lit(t) if not isinstance(t, Column) else t
    u = 1 - t

    def axis(a: str) -> Column:
        p, q, c, d = s[f"s{a}"], s[f"e{a}"], s[f"c1{a}"], s[f"c2{a}"]
        straight, bent = u * p + t * q, u * u * p + 2 * u * t * c + t * t * q
        return F.when(s["kind"] == "C", u * u * u * p + 3 * u * u * t * c + 3 * u * t * t * d + t * t * t * q).when(s["kind"] == "Q", bent).otherwise(straight)

    return axis("x"), axis("y")


# Loops


def polyline(points: Column) -> Column:
    """array<SEGMENT>: an edge from each point of array<struct<x, y>> to the next, around; none for fewer than two."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    edges = F.zip_with(points, turned, lambda a, b: line((a["x"], a["y"]), (b["x"], b["y"])))
    return F.when(F.size(points) > 1, edges).otherwise(F.array().cast(f"array<{SEGMENT}>"))


def rotate(cx: Column, cy: Column, rot: Column, x: Column, y: Column) -> Pair:
    """A point of a frame turned by rot degrees about (cx, cy)."""
    t = F.radians(rot)
    return cx + x * F.cos(t) - y * F.sin(t), cy + x * F.sin(t) + y * F.cos(t)


def circle(cx: Column, cy: Column, r: Column) -> Column:
    a, b = (cx + r, cy), (cx - r, cy)
    half = lambda p, q: segment("A", p, q, rx=r, ry=r, large=False, sweep=True)
    return F.array(half(a, b), half(b, a))


def circle_cubics(cx: Column, cy: Column, r: Column) -> Column:
    """Four cubics around a circle."""
    unit = ((1, 0), (0, 1), (-1, 0), (0, -1))
    at = lambda u, v: (cx + r * u, cy + r * v)
    return F.array(*[segment("C", at(*p), at(*q), at(p[0] + QUARTER * q[0], p[1] + QUARTER * q[1]), at(q[0] + QUARTER * p[0], q[1] + QUARTER * p[1])) for p, q in zip(unit, (*unit[1:], unit[0]), strict=True)])


def ellipse(cx: Column, cy: Column, rx: Column, ry: Column, rot: Column) -> Column:
    a, b = rotate(cx, cy, rot, rx, F.lit(0.0)), rotate(cx, cy, rot, -rx, F.lit(0.0))
    half = lambda p, q: segment("E", p, q, rx=rx, ry=ry, rot=rot, large=False, sweep=True)
    return F.array(half(a, b), half(b, a))


def rectangle(cx: Column, cy: Column, a: Column, b: Column, rot: Column) -> Column:
    """Four edges from half sides a and b."""
    at = [rotate(cx, cy, rot, x, y) for x, y in ((a, -b), (a, b), (-a, b), (-a, -b))]
    return F.array(*[line(p, q) for p, q in zip(at, [*at[1:], at[0]], strict=True)])


def rounded_rectangle(cx: Column, cy: Column, a: Column, b: Column, r: Column, rot: Column) -> Column:
    """Four edges with a quarter arc after each; a radius up to 0.001 gives the plain rectangle's edges."""
    r = F.least(r, a, b)
    at = [rotate(cx, cy, rot, x, y) for x, y in ((a, r - b), (a, b - r), (a - r, b), (r - a, b), (-a, b - r), (-a, r - b), (r - a, -b), (a - r, -b))]
    parts = []
    for k in range(0, 8, 2):
        parts += [line(at[k], at[k + 1]), segment("A", at[k + 1], at[(k + 2) % 8], rx=r, ry=r, large=False, sweep=True)]
    return F.when(r <= 1e-3, rectangle(cx, cy, a, b, rot)).otherwise(F.array(*parts))


def star_points(cx: Column, cy: Column, outer: Column, inner: Column, arms: Column, theta: Column) -> Column:
    """array<struct<x, y>>: 2 * arms vertices of alternating radius from angle theta on."""
    def vertex(k: Column) -> Column:
        t, r = theta + k * F.pi() / arms, F.when(k % 2 == 0, outer).otherwise(inner)
        return F.struct((cx + r * F.cos(t)).alias("x"), (cy + r * F.sin(t)).alias("y"))
    return F.transform(F.sequence(F.lit(0), (2 * arms - 1).cast("int")), vertex)


# Path text


def same_point(a: Pair, b: Pair, slack: float = 1e-9) -> Column:
    return (F.abs(a[0] - b[0]) <= slack) & (F.abs(a[1] - b[1]) <= slack)


def _command(letter: str, *numbers: Column) -> Column:
    return F.struct(F.lit(letter).alias("letter"), F.array(*[n.cast("double") for n in numbers]).alias("numbers"))


def _delta(a: Pair, b: Pair) -> Pair:
    return b[0] - a[0], b[1] - a[1]


def command(s: Column) -> Column:
    """The relative command of a segment whose start is the cursor: struct<letter, numbers>."""
    a, b, c, d = _ends(s)
    flag = lambda f: F.when(f, 1.0).otherwise(0.0)
    return (
        F.when(s["kind"] == "L", _command("l", *_delta(a, b)))
        .when(s["kind"] == "Q", _command("q", *_delta(a, c), *_delta(a, b)))
        .when(s["kind"] == "C", _command("c", *_delta(a, c), *_delta(a, d), *_delta(a, b)))
        .otherwise(_command("a", s["rx"], s["ry"], F.coalesce(s["rot"], F.lit(0.0)), flag(s["large_arc"]), flag(s["sweep"]), *_delta(a, b)))
    )


def path_data(segments: Column) -> Column:
    """Relative commands of a closed loop; a segment that doesn't begin where the last one ended is led to by a line."""
    def led(held: Column, s: Column, k: Column) -> Column:
        before, start = F.get(held, k - 1), (s["sx"], s["sy"])
        last = (before["ex"], before["ey"])
        return F.when(k == 0, F.array(_command("m", *start), command(s))).when(~same_point(last, start), F.array(_command("l", *_delta(last, start)), command(s))).otherwise(F.array(command(s)))

    text = lambda c: F.concat(c["letter"], F.lit(" "), F.array_join(F.transform(c["numbers"], format_number), " "))
    whole = lambda held: F.array_join(F.transform(F.flatten(F.transform(held, lambda s, k: led(held, s, k))), text), " ")
    return F.when(F.size(segments) > 0, F.concat(let(segments, whole), F.lit(" z"))).otherwise(F.lit(""))


# Scaling and mirroring


def uniform_scale(sx: Column, sy: Column) -> Column:
    return (sx + sy) / 2


def needs_rescale(sx: Column, sy: Column) -> Column:
    return (F.abs(sx - 1) > 1e-9) | (F.abs(sy - 1) > 1e-9)


def scale(s: Column, sx: Column, sy: Column) -> Column:
    """A segment with its points scaled by axis; a circle's radius by the mean, an ellipse's radii by their axes."""
    mean = uniform_scale(sx, sy)
    rx, ry = (F.when(s["kind"] == "A", s[n] * mean).otherwise(s[n] * f) for n, f in (("rx", sx), ("ry", sy)))
    moved = {n: s[n] * (sx if n.endswith("x") else sy) for n in NUMBERS[:8]} | {"rx": rx, "ry": ry, "rot": s["rot"]}
    return F.struct(s["kind"].alias("kind"), *[moved[n].alias(n) for n in NUMBERS], s["large_arc"].alias("large_arc"), s["sweep"].alias("sweep"))


def scale_loop(segments: Column, sx: Column, sy: Column) -> Column:
    return F.transform(segments, lambda s: scale(s, sx, sy))


def scale_primitive(p: Column, sx: Column, sy: Column) -> Column:
    """A circle becomes an ellipse where the axes' scales differ."""
    kind = F.when((p["kind"] == "circle") & (F.abs(sx - sy) > 1e-9), F.lit("ellipse")).otherwise(p["kind"])
    return F.struct(kind.alias("kind"), (p["cx"] * sx).alias("cx"), (p["cy"] * sy).alias("cy"), (p["rx"] * sx).alias("rx"), (p["ry"] * sy).alias("ry"), p["rot"].alias("rot"), (p["radius"] * uniform_scale(sx, sy)).alias("radius"))


def mirror(s: Column, axis: Column) -> Column:
    """The segment seen in a vertical mirror and walked the other way."""
    cubic = s["kind"] == "C"
    c1x, c1y = F.when(cubic, s["c2x"]).otherwise(s["c1x"]), F.when(cubic, s["c2y"]).otherwise(s["c1y"])
    c2x, c2y = F.when(cubic, s["c1x"]).otherwise(s["c2x"]), F.when(cubic, s["c1y"]).otherwise(s["c2y"])
    moved = (2 * axis - s["ex"], s["ey"], 2 * axis - s["sx"], s["sy"], 2 * axis - c1x, c1y, 2 * axis - c2x, c2y, s["rx"], s["ry"], -s["rot"])
    return F.struct(s["kind"].alias("kind"), *[v.alias(n) for n, v in zip(NUMBERS, moved, strict=True)], s["large_arc"].alias("large_arc"), s["sweep"].alias("sweep"))


def mirror_loop(segments: Column, axis: Column) -> Column:
    return F.transform(F.reverse(segments), lambda s: mirror(s, axis))


# Lines


def collinear(a: Column, b: Column, tolerance: float = 0.25) -> Column:
    """Whether two lines meet and their joint lies within the tolerance of the line over both."""
    meet = same_point((a["ex"], a["ey"]), (b["sx"], b["sy"]), 1e-6)
    return (a["kind"] == "L") & (b["kind"] == "L") & meet & (deviation((a["ex"], a["ey"]), (a["sx"], a["sy"]), (b["ex"], b["ey"])) <= tolerance)


def deviation(p: Pair, a: Pair, b: Pair) -> Column:
    """Distance of p from the segment a-b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = F.when(square <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.nullif(square, F.lit(0.0)))))
    return F.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def merge_lines(segments: Column, tolerance: float = 0.25) -> Column:
    """Lines that go on straight become one, in order around an open list of segments."""
    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = line((last["sx"], last["sy"]), (s["ex"], s["ey"]))
        return F.when((F.size(done) > 0) & collinear(last, s, tolerance), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(segments, F.array().cast(f"array<{SEGMENT}>"), step)

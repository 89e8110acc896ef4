"""Row types of vector documents and what is done to one of them: sampling, path text, scaling, mirroring, building loops.

A segment is one tagged record for all kinds, so that it is also one Spark struct (operators/segments.py):
L(ine), A(rc of a circle), E(lliptical arc), Q(uadratic) and C(ubic curve)."""

from __future__ import annotations

import math
from typing import Any, NamedTuple

import numpy as np

from rastrel.kernels import curves, ring

Point = tuple[float, float]
#: Handle of a cubic quarter circle in radii.
QUARTER = 0.5523


class Box(NamedTuple):
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    @property
    def width(self) -> float:
        return self.max_x - self.min_x

    @property
    def height(self) -> float:
        return self.max_y - self.min_y


class Segment(NamedTuple):
    kind: str
    start: Point
    end: Point
    c1: Point | None = None
    c2: Point | None = None
    rx: float = 0.0
    ry: float = 0.0
    rotation: float = 0.0  # degrees
    large: bool = False
    sweep: bool = True


class Primitive(NamedTuple):
    kind: str  # circle, ellipse, rectangle, rounded_rectangle
    cx: float
    cy: float
    rx: float  # half width
    ry: float
    rotation: float = 0.0
    radius: float = 0.0  # of corners


class Loop(NamedTuple):
    loop_id: str
    segments: list[Segment]
    polarity: str = "positive"
    source: str | None = None
    primitive: Primitive | None = None
    confidence: float = 0.0
    closed: bool = True


class Contour(NamedTuple):
    contour_id: str
    points: np.ndarray
    area: float
    box: Box
    perimeter: float
    is_hole: bool = False
    parent: str | None = None
    children: tuple[str, ...] = ()


class Region(NamedTuple):
    region_id: str
    outer: Contour
    holes: list[Contour]


class Shape(NamedTuple):
    shape_id: str
    outer: Loop
    holes: list[Loop]
    fill: str = "#000000"
    stroke: str | None = None
    layer_id: str | None = None
    z: int = 0


class Layer(NamedTuple):
    layer_id: str
    fill: str
    shapes: list[Shape]
    z: int = 0


class Document(NamedTuple):
    width: float
    height: float
    shapes: list[Shape]
    layers: list[Layer] = []
    metadata: dict[str, str] = {}


def box_of(p: np.ndarray) -> Box:
    return Box(*map(float, (*p.min(0), *p.max(0)))) if len(p) else Box(0.0, 0.0, 0.0, 0.0)


def contour(contour_id: str, p: np.ndarray, is_hole: bool = False, parent: str | None = None) -> Contour:
    return Contour(contour_id, p, ring.area(p), box_of(p), ring.perimeter(p), is_hole, parent)


def pair(p: Any) -> Point:
    return float(p[0]), float(p[1])


# Segments


def line(a: Any, b: Any) -> Segment:
    return Segment("L", pair(a), pair(b))


def quadratic(a: Any, c: Any, b: Any) -> Segment:
    return Segment("Q", pair(a), pair(b), pair(c))


def cubic(a: Any, c: Any, d: Any, b: Any) -> Segment:
    return Segment("C", pair(a), pair(b), pair(c), pair(d))


def arc(a: Any, b: Any, r: float, large: bool = False, sweep: bool = True) -> Segment:
    return Segment("A", pair(a), pair(b), rx=float(r), ry=float(r), large=bool(large), sweep=bool(sweep))


def elliptical_arc(a: Any, b: Any, rx: float, ry: float, rotation: float = 0.0, large: bool = False, sweep: bool = True) -> Segment:
    return Segment("E", pair(a), pair(b), None, None, float(rx), float(ry), float(rotation), bool(large), bool(sweep))


def of_curves(found: list[np.ndarray], flat: float = 0.25) -> list[Segment]:
    """Segments of (4, 2) cubics; straight ones become lines."""
    return [line(c[0], c[3]) if curves.is_line(c, flat) else cubic(*c) for c in found]


def line_as_cubic(s: Segment) -> Segment:
    a, b = np.array(s.start), np.array(s.end)
    return cubic(a, a + (b - a) / 3, b - (b - a) / 3, b)


def quadratic_as_cubic(s: Segment) -> Segment:
    a, b, c = np.array(s.start), np.array(s.end), np.array(s.c1)
    return cubic(a, a + (c - a) * 2 / 3, b + (c - b) * 2 / 3, b)


def vector_angle(u: Any, v: Any) -> float:
    """Signed angle from u to v in radians; 0 where one has no length."""
    if math.hypot(*u) < 1e-12 or math.hypot(*v) < 1e-12:
        return 0.0
    return math.atan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1])


def arc_centre(s: Segment) -> tuple[Point, float, float, float, float] | None:
    """(centre, rx, ry, start angle, sweep angle) of an arc by the SVG rules; None where it is a straight line."""
    rx, ry = abs(s.rx), abs(s.ry)
    (x1, y1), (x2, y2) = s.start, s.end
    if rx < 1e-9 or ry < 1e-9 or math.hypot(x2 - x1, y2 - y1) < 1e-9:
        return None
    t = math.radians(s.rotation)
    cos, sin = math.cos(t), math.sin(t)
    hx, hy = (x1 - x2) / 2, (y1 - y2) / 2
    u, v = cos * hx + sin * hy, -sin * hx + cos * hy
    over = (u / rx) ** 2 + (v / ry) ** 2
    if over > 1:  # radii too small to reach are scaled up
        rx, ry = rx * math.sqrt(over), ry * math.sqrt(over)
        over = 1.0
    factor = math.sqrt(max(0.0, 1 / over - 1)) * (-1 if s.large == s.sweep else 1)
    cu, cv = factor * rx * v / ry, -factor * ry * u / rx
    centre = (cos * cu - sin * cv + (x1 + x2) / 2, sin * cu + cos * cv + (y1 + y2) / 2)
    start = math.atan2((v - cv) / ry, (u - cu) / rx)
    sweep = vector_angle(((u - cu) / rx, (v - cv) / ry), ((-u - cu) / rx, (-v - cv) / ry))
    if s.sweep and sweep < 0:
        sweep += 2 * math.pi
    elif not s.sweep and sweep > 0:
        sweep -= 2 * math.pi
    return centre, rx, ry, start, sweep


def evaluate(s: Segment, t: np.ndarray) -> np.ndarray:
    """Points at parameters from 0 to 1."""
    t = np.asarray(t, float)[:, None]
    a, b = np.array(s.start), np.array(s.end)
    if s.kind == "C":
        return curves.evaluate(np.array([s.start, s.c1, s.c2, s.end]), t[:, 0])
    if s.kind == "Q":
        return (1 - t) ** 2 * a + 2 * (1 - t) * t * np.array(s.c1) + t * t * b
    found = arc_centre(s) if s.kind in "AE" else None
    if found is None:
        return a + t * (b - a)
    (cx, cy), rx, ry, start, sweep = found
    angle, turn = start + t[:, 0] * sweep, math.radians(s.rotation)
    u, v = rx * np.cos(angle), ry * np.sin(angle)
    out = np.stack([cx + u * math.cos(turn) - v * math.sin(turn), cy + u * math.sin(turn) + v * math.cos(turn)], 1)
    out[t[:, 0] == 0], out[t[:, 0] == 1] = a, b
    return out


def sample_segment(s: Segment, steps: int = 12) -> np.ndarray:
    """steps + 1 points of a curve; the two ends of a line."""
    return evaluate(s, np.array([0.0, 1.0]) if s.kind == "L" else np.arange(steps + 1) / steps)


def sample_loop(segments: list[Segment], steps: int = 18) -> np.ndarray:
    """A ring of points along all segments, repeats left out."""
    return ring.dedupe(np.concatenate([sample_segment(s, steps)[:-1] for s in segments])) if segments else np.zeros((0, 2))


# Path text


def same_point(a: Point, b: Point, slack: float = 1e-9) -> bool:
    return abs(a[0] - b[0]) <= slack and abs(a[1] - b[1]) <= slack


def text_point(p: Point) -> str:
    return f"{curves.number(p[0])} {curves.number(p[1])}"


def text_delta(a: Point, b: Point) -> str:
    return text_point((b[0] - a[0], b[1] - a[1]))


def path_data(segments: list[Segment], cursor: Point | None = None) -> tuple[str, Point | None]:
    """(relative commands of a closed loop, cursor after it). The first move is relative to the cursor, if there is one."""
    if not segments:
        return "", cursor
    begin = segments[0].start
    out = ["m " + text_delta(cursor or (0.0, 0.0), begin)]
    at = begin
    for s in segments:
        if not same_point(at, s.start):
            out.append("l " + text_delta(at, s.start))
        a = s.start
        if s.kind == "L":
            out.append("l " + text_delta(a, s.end))
        elif s.kind == "Q":
            out.append(f"q {text_delta(a, s.c1)} {text_delta(a, s.end)}")
        elif s.kind == "C":
            out.append(f"c {text_delta(a, s.c1)} {text_delta(a, s.c2)} {text_delta(a, s.end)}")
        else:
            out.append(f"a {curves.number(s.rx)} {curves.number(s.ry)} {curves.number(s.rotation)} {int(s.large)} {int(s.sweep)} {text_delta(a, s.end)}")
        at = s.end
    return " ".join([*out, "z"]), begin


def compound_path(shape: Shape) -> str:
    """One path of the outer loop and the holes, each move relative to where the loop before began."""
    parts, cursor = [], None
    for loop in (shape.outer, *shape.holes):
        text, cursor = path_data(loop.segments, cursor)
        parts.append(text)
    return " ".join(filter(None, parts))


# Scaling and mirroring


def scale_point(p: Point, sx: float, sy: float) -> Point:
    return p[0] * sx, p[1] * sy


def uniform_scale(sx: float, sy: float) -> float:
    return (sx + sy) / 2


def needs_rescale(sx: float, sy: float) -> bool:
    return abs(sx - 1) > 1e-9 or abs(sy - 1) > 1e-9


def scale_segment(s: Segment, sx: float, sy: float) -> Segment:
    """Ends and handles by axis; a circle's radius by the mean, an ellipse's radii by their axes."""
    moved = {n: scale_point(getattr(s, n), sx, sy) for n in ("start", "end", "c1", "c2") if getattr(s, n) is not None}
    if s.kind == "A":
        moved |= {"rx": s.rx * uniform_scale(sx, sy), "ry": s.ry * uniform_scale(sx, sy)}
    elif s.kind == "E":
        moved |= {"rx": s.rx * sx, "ry": s.ry * sy}
    return s._replace(**moved)


def scale_primitive(p: Primitive | None, sx: float, sy: float) -> Primitive | None:
    """A circle becomes an ellipse where the axes' scales differ."""
    if p is None:
        return None
    cx, cy = scale_point((p.cx, p.cy), sx, sy)
    kind = "ellipse" if p.kind == "circle" and abs(sx - sy) > 1e-9 else p.kind
    return p._replace(kind=kind, cx=cx, cy=cy, rx=p.rx * sx, ry=p.ry * sy, radius=p.radius * uniform_scale(sx, sy))


def scale_loop(loop: Loop, sx: float, sy: float) -> Loop:
    return loop._replace(segments=[scale_segment(s, sx, sy) for s in loop.segments], primitive=scale_primitive(loop.primitive, sx, sy))


def scale_shape(shape: Shape, sx: float, sy: float) -> Shape:
    return shape._replace(outer=scale_loop(shape.outer, sx, sy), holes=[scale_loop(h, sx, sy) for h in shape.holes])


def scale_shapes(shapes: list[Shape], sx: float, sy: float) -> list[Shape]:
    return [scale_shape(s, sx, sy) for s in shapes]


def scale_layers(layers: list[Layer], sx: float, sy: float) -> list[Layer]:
    return [x._replace(shapes=scale_shapes(x.shapes, sx, sy)) for x in layers]


def scale_contour(c: Contour, sx: float, sy: float) -> Contour:
    """Points scaled; area, box and perimeter made anew."""
    p = c.points * (sx, sy)
    return c._replace(points=p, area=ring.area(p), box=box_of(p), perimeter=ring.perimeter(p))


def scale_region(r: Region, sx: float, sy: float) -> Region:
    return r._replace(outer=scale_contour(r.outer, sx, sy), holes=[scale_contour(h, sx, sy) for h in r.holes])


def scale_regions(regions: list[Region], sx: float, sy: float) -> list[Region]:
    return [scale_region(r, sx, sy) for r in regions]


def mirror_point(p: Point, axis: float) -> Point:
    return 2 * axis - p[0], p[1]


def mirror_segment(s: Segment, axis: float) -> Segment:
    """The segment seen in a vertical mirror and walked the other way, so that arcs keep their sweep flag."""
    c1, c2 = (s.c2, s.c1) if s.kind == "C" else (s.c1, s.c2)
    seen = [None if c is None else mirror_point(c, axis) for c in (c1, c2)]
    return s._replace(start=mirror_point(s.end, axis), end=mirror_point(s.start, axis), c1=seen[0], c2=seen[1], rotation=-s.rotation)


def mirror_segments(segments: list[Segment], axis: float) -> list[Segment]:
    return [mirror_segment(s, axis) for s in reversed(segments)]


# Loops


def _turned(p: Primitive, local: list[tuple[float, float]]) -> list[Point]:
    t = math.radians(p.rotation)
    return [(p.cx + x * math.cos(t) - y * math.sin(t), p.cy + x * math.sin(t) + y * math.cos(t)) for x, y in local]


def polyline_segments(p: np.ndarray) -> list[Segment]:
    """An edge from each point to the next, around; none for fewer than two points."""
    return [line(a, b) for a, b in zip(p, np.roll(p, -1, axis=0), strict=True)] if len(p) > 1 else []


def primitive_segments(p: Primitive) -> list[Segment]:
    """Two half arcs of a circle or an ellipse; the edges of a rectangle, with a quarter arc at each rounded corner."""
    if p.kind in ("circle", "ellipse"):
        a, b = _turned(p, [(p.rx, 0.0), (-p.rx, 0.0)])
        make = (lambda u, v: arc(u, v, p.rx)) if p.kind == "circle" else (lambda u, v: elliptical_arc(u, v, p.rx, p.ry, p.rotation))
        return [make(a, b), make(b, a)]
    a, b, r = p.rx, p.ry, min(p.radius, p.rx, p.ry)
    if p.kind == "rectangle" or r <= 1e-3:
        return polyline_segments(np.array(_turned(p, [(a, -b), (a, b), (-a, b), (-a, -b)])))
    stops = _turned(p, [(a, -b + r), (a, b - r), (a - r, b), (-a + r, b), (-a, b - r), (-a, -b + r), (-a + r, -b), (a - r, -b)])
    out = []
    for k in range(0, 8, 2):
        out += [line(stops[k], stops[k + 1]), arc(stops[k + 1], stops[(k + 2) % 8], r)]
    return out


def circle_as_cubics(cx: float, cy: float, r: float) -> list[Segment]:
    """Four cubics around a circle."""
    k = QUARTER * r
    at = [(cx + r, cy), (cx, cy + r), (cx - r, cy), (cx, cy - r)]
    out = []
    for (x, y), (u, v) in zip(at, [*at[1:], at[0]], strict=True):
        dx, dy, ex, ey = (x - cx) / r, (y - cy) / r, (u - cx) / r, (v - cy) / r
        out.append(cubic((x, y), (x - k * dy, y + k * dx), (u + k * ey, v - k * ex), (u, v)))
    return out


def star_points(cx: float, cy: float, outer: float, inner: float, arms: int, theta: float) -> np.ndarray:
    """2 * arms vertices of alternating radius from angle theta on."""
    at = theta + np.arange(2 * arms) * math.pi / arms
    size = np.where(np.arange(2 * arms) % 2 == 0, outer, inner)
    return np.stack([cx + size * np.cos(at), cy + size * np.sin(at)], 1)


def collinear(a: Segment, b: Segment, tolerance: float = 0.25) -> bool:
    """Whether two lines meet and their joint lies within the tolerance of the line over both."""
    if a.kind != "L" or b.kind != "L" or not same_point(a.end, b.start, 1e-6):
        return False
    return float(ring._distance(np.array([a.end]), np.array(a.start), np.array(b.end))[0]) <= tolerance


def merge_lines(segments: list[Segment], tolerance: float = 0.25) -> list[Segment]:
    """Lines that go on straight become one."""
    out: list[Segment] = []
    for s in segments:
        if out and collinear(out[-1], s, tolerance):
            out[-1] = line(out[-1].start, s.end)
        else:
            out.append(s)
    return out


def assemble_shape(shape_id: str, outer: Loop, holes: list[Loop], fill: str = "#000000", stroke: str | None = None, layer_id: str | None = None, z: int = 0) -> Shape:
    """A shape whose outer loop is positive and whose holes are negative."""
    return Shape(shape_id, outer._replace(polarity="positive"), [h._replace(polarity="negative") for h in holes], fill, stroke, layer_id, z)

"""The primitive-first order: a contour's plan of parts, and the loop that is chosen from it."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from rastrel.config import PrimitiveFirst
from rastrel.kernels import curves, decompose, fitting, geometry, ring, topology
from rastrel.kernels.geometry import Contour, Loop, Primitive, Region, Segment, Shape

# Allowed area ratios and bonus by kind, aspects of circles, relative radii of corners, and what holes may
# lack and gain.
GATES = {"circle": (0.80, 1.20, 0.05), "ellipse": (0.72, 1.30, 0.03), "rounded_rectangle": (0.74, 1.26, 0.02), "rectangle": (0.82, 1.18, 0.0)}
ASPECT, HOLE_ASPECT, CORNER, HOLE_SLACK, HOLE_BONUS = (0.90, 1.10), (0.84, 1.16), (0.05, 0.30), 0.03, 0.04


class Candidate(NamedTuple):
    """A primitive that a contour may stand for."""

    primitive: Primitive
    confidence: float
    score: float


class Subshape(NamedTuple):
    """A half ellipse at the bottom: places of its ends in the contour, and among the anchors where it is attached."""

    start: int
    end: int
    ellipse: Primitive
    confidence: float
    start_anchor: int | None = None
    end_anchor: int | None = None


class Plan(NamedTuple):
    """The parts of one contour."""

    contour: Contour
    role: str  # outer or hole
    candidates: list[Candidate]
    subshape: Subshape | None
    anchors: list[int]
    straight: list[dict]


class Decomposition(NamedTuple):
    region_id: str
    outer: Plan
    holes: list[Plan]


def least_confidence(kind: str, s: PrimitiveFirst, hole: bool) -> float:
    wanted = {"circle": s.circle_confidence_threshold, "ellipse": s.ellipse_confidence_threshold, "rectangle": s.rectangle_confidence_threshold, "rounded_rectangle": s.rounded_rectangle_confidence_threshold}
    return wanted[kind] - (HOLE_SLACK if hole else 0.0)


def accepts(c: dict | None, aspect: float, s: PrimitiveFirst, hole: bool) -> bool:
    """The gate of a kind: confidence and area ratio; circles also by aspect, corners by their radius. Holes are round."""
    if c is None or hole and c["kind"] not in ("circle", "ellipse"):
        return False
    low, high, _ = GATES[c["kind"]]
    if c["fit"] < least_confidence(c["kind"], s, hole) or not low <= c["ratio"] <= high:
        return False
    if c["kind"] == "circle":
        least, most = HOLE_ASPECT if hole else ASPECT
        return least <= aspect <= most
    return c["kind"] != "rounded_rectangle" or CORNER[0] <= c["radius"] / max(min(c["rx"], c["ry"]), 1e-9) <= CORNER[1]


def candidates(source: Contour, s: PrimitiveFirst) -> list[Candidate]:
    """The primitives that pass their gates, best score first; ties in the order circle, ellipse, rounded, rectangle."""
    p, hole = source.points, source.is_hole
    if len(p) < 4:
        return []
    d = ring.describe(p)
    out = []
    for c in (ring.circle(p, d), ring.ellipse(p, d, None), ring.rounded_rectangle(p, d), ring.rectangle(p, d)):
        if c is not None and "ratio" in c and accepts(c, d["aspect"], s, hole):
            bonus = GATES[c["kind"]][2] + (HOLE_BONUS if hole and s.prefer_hole_primitives else 0.0)
            out.append(Candidate(fitting.primitive_of(c), float(c["fit"]), float(c["fit"]) + bonus))
    return sorted(out, key=lambda c: -c.score)


def subshape(source: Contour, s: PrimitiveFirst) -> Subshape | None:
    """The bottom half ellipse of an outer contour."""
    if source.is_hole:
        return None
    found = decompose.bottom_ellipse(
        source.points, s.ellipse_subshape_band_ratio, s.ellipse_subshape_min_span_ratio, (s.ellipse_subshape_min_aspect_ratio, s.ellipse_subshape_max_aspect_ratio),
        s.ellipse_subshape_symmetry_tolerance, s.ellipse_subshape_rotation_tolerance_deg, s.ellipse_subshape_confidence_threshold, s.min_ellipse_subshape_area,
    )
    return found and Subshape(found["start"], found["end"], Primitive("ellipse", found["cx"], found["cy"], found["rx"], found["ry"]), found["confidence"])


def attach(found: Subshape | None, marks: list[int]) -> Subshape | None:
    """The subshape with the places of its ends among the anchors; None if one is missing."""
    if found is None or found.start not in marks or found.end not in marks:
        return None
    return found._replace(start_anchor=marks.index(found.start), end_anchor=marks.index(found.end))


def required_anchors(found: Subshape | None) -> tuple[int, ...]:
    return () if found is None else (found.start, found.end)


def decompose_contour(source: Contour, s: PrimitiveFirst) -> Plan:
    found = subshape(source, s)
    marks = decompose.anchors(source.points, s.simplify_tolerance, required_anchors(found)) if len(source.points) > 3 else list(range(len(source.points)))
    straight = decompose.straight_runs(source.points, marks, s.line_fit_tolerance) if len(marks) > 1 else []
    return Plan(source, "hole" if source.is_hole else "outer", candidates(source, s), attach(found, marks), marks, straight)


def decompose_region(region: Region, s: PrimitiveFirst) -> Decomposition:
    return Decomposition(region.region_id, decompose_contour(region.outer, s), [decompose_contour(h, s) for h in region.holes])


def arc_segment(q: np.ndarray, s: PrimitiveFirst) -> Segment | None:
    """A circular arc through a chain if it is sure and turns enough, else an elliptical one, else None."""
    least = s.min_arc_sweep_degrees
    c = curves.arc_fit(q)
    if c and c["confidence"] >= s.arc_confidence_threshold and abs(math.degrees(c["sweep"])) >= least:
        return geometry.arc(q[0], q[-1], c["r"], abs(c["sweep"]) > math.pi, c["sweep"] > 0)
    e = fitting.elliptical_arc(q)
    if e and e["confidence"] >= s.arc_confidence_threshold and abs(math.degrees(e["sweep"])) >= least and e["worst"] <= s.arc_fit_tolerance:
        return e["segment"]
    return None


def subshape_arc(p: np.ndarray, found: Subshape) -> Segment | None:
    """The half ellipse between its ends; None for a turn of 0.2 and less."""
    e = found.ellipse
    q = decompose.span(p, found.start, found.end)
    t = np.unwrap(np.arctan2((q[:, 1] - e.cy) / e.ry, (q[:, 0] - e.cx) / e.rx))
    sweep = float(t[-1] - t[0])
    return geometry.elliptical_arc(q[0], q[-1], e.rx, e.ry, 0.0, abs(sweep) > math.pi, sweep > 0) if abs(sweep) > 0.2 else None


def freeform(plan: Plan, s: PrimitiveFirst) -> list[Segment]:
    """Between anchors: the subshape's arc, a line, an arc, or else a Catmull-Rom curve."""
    p, marks, found = plan.contour.points, plan.anchors, plan.subshape
    straight = {(r["start"], r["end"]) for r in plan.straight}
    bottom = subshape_arc(p, found) if found else None
    if bottom:
        inside = set((np.arange(found.start + 1, found.start + (found.end - found.start) % len(p)) % len(p)).tolist())
        marks = [m for m in marks if m not in inside]
    n, out = len(marks), []
    if n < 2:
        return []
    for k in range(n):
        a, b = marks[k], marks[(k + 1) % n]
        if bottom and (a, b) == (found.start, found.end):
            out.append(bottom)
        elif (a, b) in straight:
            out.append(geometry.line(p[a], p[b]))
        else:
            arc = arc_segment(decompose.span(p, a, b), s) if (b - a) % len(p) >= 4 else None
            out.append(arc or geometry.cubic(*decompose.catmull_rom(p[marks[k - 1]], p[a], p[b], p[marks[(k + 2) % n]], s.cubic_tension)))
    return out


def select_loop(plan: Plan, s: PrimitiveFirst) -> Loop:
    """The first primitive by score that passes the guard, else the freeform loop, else the polyline."""
    source, limits = plan.contour, topology.tolerances(s)
    polarity = "negative" if source.is_hole else "positive"
    for c in plan.candidates:
        loop = Loop(source.contour_id, geometry.primitive_segments(c.primitive), polarity, source.contour_id, c.primitive, c.confidence)
        if topology.validate_loop(loop, source, limits):
            return loop
    loop = Loop(source.contour_id, freeform(plan, s), polarity, source.contour_id)
    return loop if loop.segments and topology.validate_loop(loop, source, limits) else fitting.polyline(source)


def assemble(parts: Decomposition, s: PrimitiveFirst, shape_id: str | None = None) -> tuple[Shape, bool]:
    """(shape, whether its loops go together); where they don't, all of them are polylines."""
    make = lambda o, hs: geometry.assemble_shape(shape_id or parts.region_id, o, hs, s.fill_color, s.stroke_color)
    try:
        shape = make(select_loop(parts.outer, s), [select_loop(h, s) for h in parts.holes])
        if topology.validate_shape(shape, parts.outer.contour, [h.contour for h in parts.holes], topology.tolerances(s)):
            return shape, True
    except (ValueError, FloatingPointError, np.linalg.LinAlgError):
        pass
    return make(fitting.polyline(parts.outer.contour), [fitting.polyline(h.contour) for h in parts.holes]), False


def decompose_and_assemble(region: Region, s: PrimitiveFirst) -> Shape:
    return assemble(decompose_region(region, s), s)[0]

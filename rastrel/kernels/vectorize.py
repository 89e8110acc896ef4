"""From one mask to typed shapes: contours, clean-up and fitting, in two orders of preference, by their settings."""

from __future__ import annotations

from typing import Any

import numpy as np

from rastrel.config import ClassifyFirst, Common, PrimitiveFirst
from rastrel.kernels import fitting, geometry, primitive_first, raster, ring
from rastrel.kernels.geometry import Region, Shape


def regions(mask: np.ndarray, least_area: float = 32, least_hole: float = 16, scale: tuple[float, float] = (1.0, 1.0), subpixel: bool = True, offset: tuple[float, float] = (0.0, 0.0)) -> list[dict]:
    """Regions {id, outer, holes, area} by descending area: borders of even depth with the holes right below them.

    Outer rings have positive shoelace area with y down, holes negative. Regions are numbered by their first cell."""
    half = 0.5 if subpixel else 0.0
    found: dict[int, dict] = {}
    number = 0
    borders = raster.borders(mask)

    def contour(border: dict) -> np.ndarray | None:
        p = ring.dedupe((np.array(border["cells"], float) + half) * scale + offset)
        if len(p) < 3 or abs(ring.area(p)) < 1e-9:
            return None
        return p[::-1] if (ring.area(p) < 0) != border["hole"] else p

    for b in borders:
        if not b["hole"]:
            p = contour(b)
            if p is not None and abs(ring.area(p)) >= least_area:
                found[b["id"]] = {"id": f"region_{number:03d}", "outer": p, "holes": [], "area": abs(ring.area(p))}
                number += 1
    for b in borders:
        if b["hole"] and b["parent"] in found:
            p = contour(b)
            if p is not None and abs(ring.area(p)) >= least_hole:
                found[b["parent"]]["holes"].append(p)
    for r in found.values():
        r["holes"].sort(key=lambda p: -abs(ring.area(p)))
    return sorted(found.values(), key=lambda r: (-r["area"], r["id"]))


def tidy(mask: np.ndarray, least_area: int = 32, least_hole: int = 16, keep_gaps: bool = True, opens: int = 0, closes: int = 0) -> np.ndarray:
    """A mask without specks and pinholes, after opening and closing it."""
    mask = raster.morphology(mask, "o" * opens + "c" * closes)
    mask = raster.remove_small(mask, max(2, least_area // 4))
    return raster.fill_holes(mask, max(1, least_hole // (4 if keep_gaps else 2)))


def tidied(mask: np.ndarray, s: Common) -> np.ndarray:
    return tidy(mask, s.min_region_area, s.min_hole_area, s.preserve_narrow_gaps, s.morph_open_iterations, s.morph_close_iterations)


def cleaned(found: dict, s: Common) -> Region:
    """A typed region of cleaned contours, which hold the ids of their parent and children."""
    own = f"{found['id']}_outer"
    holes = [geometry.contour(f"{found['id']}_hole_{k:03d}", ring.clean(h, True, s), True, own) for k, h in enumerate(found["holes"])]
    outer = geometry.contour(own, ring.clean(found["outer"], False, s))
    return Region(found["id"], outer._replace(children=tuple(h.contour_id for h in holes)), holes)


def structure(mask: np.ndarray, s: Common, scale: tuple[float, float] = (1.0, 1.0)) -> list[tuple[Region, float]]:
    """(cleaned region, area before clean-up) of a mask, largest first."""
    found = regions(tidied(mask, s), s.min_region_area, s.min_hole_area, scale, s.subpixel_contours)
    return [(cleaned(r, s), r["area"]) for r in found]


def fit(region: Region, s: Common, **names: Any) -> tuple[Shape, bool, str]:
    """(shape, whether the fitted loops go together, kind of the outer loop) in the order that the settings stand for."""
    if isinstance(s, PrimitiveFirst):
        shape, valid = primitive_first.assemble(primitive_first.decompose_region(region, s), s)
    else:
        shape, valid, _ = fitting.fit_classified_region(region, s, **names)
    return shape, valid, kind_of(shape.outer)


def kind_of(loop: geometry.Loop) -> str:
    if loop.primitive:
        return loop.primitive.kind
    kinds = {x.kind for x in loop.segments}
    return "polyline" if kinds <= {"L"} else "arcs" if kinds & {"A", "E"} else "curves"


def settings_of(primitive_first: bool, s: Common | None) -> Common:
    return s or (PrimitiveFirst() if primitive_first else ClassifyFirst())


def shapes(mask: np.ndarray, primitive_first: bool = False, settings: Common | None = None, scale: tuple[float, float] = (1.0, 1.0), **names: Any) -> list[tuple[Shape, float, str]]:
    """(shape, area, kind) of every region of a mask, largest first."""
    s = settings_of(primitive_first, settings)
    out = []
    for region, area in structure(mask, s, scale):
        shape, _, kind = fit(region, s, **names)
        out.append((shape, area, kind))
    return out

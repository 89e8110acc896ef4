"""Vector documents as SVG text on the driver or in a task: the row types of kernels/geometry written out."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import escape

from rastrel.kernels import geometry
from rastrel.kernels.curves import number
from rastrel.kernels.geometry import Document, Layer, Loop, Shape

#: Holes are painted, not cut out.
HOLE_FILL = "#F2F2F2"


def attribute(text: str) -> str:
    return escape(text, {'"': "&quot;"})


def assemble(width: float, height: float, shapes: Sequence[Shape], metadata: dict[str, str] | None = None) -> Document:
    """A document of shapes; those that name a layer are grouped by it, in the order of z."""
    layers: dict[str, Layer] = {}
    for s in shapes:
        if s.layer_id is not None:
            layers.setdefault(s.layer_id, Layer(s.layer_id, s.fill, [], s.z)).shapes.append(s)
    return Document(float(width), float(height), list(shapes), sorted(layers.values(), key=lambda x: x.z), dict(metadata or {}))


def view_box(d: Document) -> tuple[float, float, float, float]:
    """From the metadata, else the document's size."""
    def held(name: str, default: float) -> float:
        try:
            return float(d.metadata[name])
        except (KeyError, ValueError):
            return default

    return held("viewBox_x", 0.0), held("viewBox_y", 0.0), held("viewBox_width", d.width), held("viewBox_height", d.height)


def _paint(fill: str, stroke: str | None) -> str:
    return f' fill="{attribute(fill)}"' + (f' stroke="{attribute(stroke)}"' if stroke else "")


def primitive_markup(loop: Loop, fill: str, stroke: str | None = None) -> str | None:
    """The tag of a loop that stands for a primitive."""
    p = loop.primitive
    if p is None:
        return None
    turn = f' transform="rotate({number(p.rotation)} {number(p.cx)} {number(p.cy)})"' if abs(p.rotation) >= 1e-3 else ""
    centre = f'cx="{number(p.cx)}" cy="{number(p.cy)}"'
    if p.kind == "circle":
        return f'<circle {centre} r="{number(p.rx)}"{_paint(fill, stroke)}/>'
    if p.kind == "ellipse":
        return f'<ellipse {centre} rx="{number(p.rx)}" ry="{number(p.ry)}"{_paint(fill, stroke)}{turn}/>'
    corner = f' rx="{number(p.radius)}"' if p.radius > 0 else ""
    return f'<rect x="{number(p.cx - p.rx)}" y="{number(p.cy - p.ry)}" width="{number(2 * p.rx)}" height="{number(2 * p.ry)}"{corner}{_paint(fill, stroke)}{turn}/>'


def path_markup(loop: Loop, fill: str, stroke: str | None = None) -> str:
    return f'<path d="{geometry.path_data(loop.segments)[0]}"{_paint(fill, stroke)}/>'


def shape_markups(s: Shape) -> list[str]:
    """A primitive's tag for a shape without holes; else its outer path and a painted path for each hole."""
    if not s.holes:
        return [primitive_markup(s.outer, s.fill, s.stroke) or path_markup(s.outer, s.fill, s.stroke)]
    return [path_markup(s.outer, s.fill, s.stroke), *[path_markup(h, HOLE_FILL) for h in s.holes]]


def layer_lines(layer: Layer) -> list[str]:
    return [f'<g id="{attribute(layer.layer_id)}">', *[m for s in layer.shapes for m in shape_markups(s)], "</g>"]


def export(d: Document, background: str | None = None) -> str:
    """SVG text: layers in order, or the shapes of a document without any."""
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{number(d.width)}" height="{number(d.height)}" viewBox="{" ".join(map(number, view_box(d)))}">']
    if background:
        out.append(f'<rect width="100%" height="100%" fill="{attribute(background)}"/>')
    out += [line for x in d.layers for line in layer_lines(x)] if d.layers else []
    out += [m for s in d.shapes if not d.layers or s.layer_id is None for m in shape_markups(s)]
    return "\n".join([*out, "</svg>"])


def statistics(d: Document) -> dict[str, int]:
    """Counts of shapes, holes, loops, segments, layers and distinct fills."""
    segments = sum(len(x.segments) for s in d.shapes for x in (s.outer, *s.holes))
    holes = sum(len(s.holes) for s in d.shapes)
    return {
        "num_shapes": len(d.shapes), "num_holes": holes, "num_loops": len(d.shapes) + holes, "num_segments": segments, "num_primitives": segments,
        "num_layers": len(d.layers), "num_fills": len({s.fill for s in d.shapes}),
    }

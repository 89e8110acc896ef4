"""Rasters to SVG documents by the settings of either order: masks, contours and fits by array kernels, markup by columns.

Images are independent rows, so nothing is shuffled before the markup of an image comes together."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.config import ClassifyFirst, Common, PrimitiveFirst
from rastrel.operators import documents
from rastrel.operators.images import each_distinct, planes
from rastrel.operators.pixels import KEY
from rastrel.operators.segments import LOOP, NUMBERS

SHAPE = (
    "value int, ordinal int, region string, layer_id string, z int, fill string, area double, kind string, cx double, cy double, rx double, ry double, angle double, "
    f"radius double, path string, n_holes int, hole_paths array<string>, n_segments int, loops array<{LOOP}>"
)
_NUMBER = pa.float64()
_SEGMENT = pa.struct([("kind", pa.string()), *[(n, _NUMBER) for n in NUMBERS], ("large_arc", pa.bool_()), ("sweep", pa.bool_())])
_PRIMITIVE = pa.struct([("kind", pa.string()), *[(n, _NUMBER) for n in ("cx", "cy", "rx", "ry", "rot", "radius")]])
_LOOP = pa.struct([("loop_id", pa.string()), ("polarity", pa.string()), ("source", pa.string()), ("confidence", _NUMBER), ("primitive", _PRIMITIVE), ("segments", pa.list_(_SEGMENT))])
_FIELDS = [
    ("value", pa.int32()), ("ordinal", pa.int32()), ("region", pa.string()), ("layer_id", pa.string()), ("z", pa.int32()), ("fill", pa.string()), ("area", _NUMBER), ("kind", pa.string()),
    *[(n, _NUMBER) for n in ("cx", "cy", "rx", "ry", "angle", "radius")], ("path", pa.string()), ("n_holes", pa.int32()), ("hole_paths", pa.list_(pa.string())), ("n_segments", pa.int32()), ("loops", pa.list_(_LOOP)),
]


def _loop_row(loop: Any) -> dict:
    segments = []
    for x in loop.segments:
        c1, c2 = x.c1 or (None, None), x.c2 or (None, None)
        arc = x.kind in "AE"
        values = (*x.start, *x.end, *c1, *c2, x.rx if arc else None, x.ry if arc else None, x.rotation if arc else None)
        segments.append({"kind": x.kind, **dict(zip(NUMBERS, values, strict=True)), "large_arc": x.large if arc else None, "sweep": x.sweep if arc else None})
    p = loop.primitive
    primitive = p and {"kind": p.kind, "cx": p.cx, "cy": p.cy, "rx": p.rx, "ry": p.ry, "rot": p.rotation, "radius": p.radius}
    return {"loop_id": loop.loop_id, "polarity": loop.polarity, "source": loop.source, "confidence": loop.confidence, "primitive": primitive, "segments": segments}


def shape_row(shape: Any, area: float, kind: str) -> dict:
    """The SHAPE columns of a typed shape."""
    from rastrel.kernels import geometry

    p = shape.outer.primitive
    loops = [shape.outer, *shape.holes]
    paths = [geometry.path_data(x.segments)[0] for x in loops]
    place = dict.fromkeys(("cx", "cy", "rx", "ry", "angle", "radius")) if p is None else {"cx": p.cx, "cy": p.cy, "rx": p.rx, "ry": p.ry, "angle": p.rotation, "radius": p.radius}
    return place | {
        "region": shape.shape_id, "layer_id": shape.layer_id, "z": shape.z, "fill": shape.fill, "area": area, "kind": kind, "path": paths[0], "n_holes": len(shape.holes), "hole_paths": paths[1:],
        "n_segments": sum(len(x.segments) for x in loops), "loops": [_loop_row(x) for x in loops],
    }


def _map(images: DataFrame, column: str, kernel: Callable[[np.ndarray, tuple[float, float]], Iterable[dict]], key: str, s: Common, channels: int = 1, by_value: bool = False) -> DataFrame:
    """(key, SHAPE): kernel's rows of every image, equal ones drawn once by a worker. It also takes the scales that lead to the
    original's coordinates, where the images have them and the order draws in these (the primitive-first one doesn't)."""
    kind = images.schema[key].dataType.simpleString()
    scaled = {"scale_x", "scale_y"} <= set(images.columns) and not isinstance(s, PrimitiveFirst)
    name, fields = f"{column} {by_value} {s!r}", pa.schema(_FIELDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scales = zip(*(part.column(c).to_pylist() for c in ("scale_x", "scale_y")), strict=True) if scaled else [(1.0, 1.0)] * part.num_rows
                found, rows = each_distinct(name, zip(planes(part, column, channels), scales, strict=True), lambda plane, scale: list(kernel(plane, scale)), fields)
                yield from found.add_column(0, key, part.column(key).take(pa.array(rows))).to_batches()

    return images.select(key, "width", "height", column, *(["scale_x", "scale_y"] if scaled else [])).mapInArrow(run, f"`{key}` {kind}, {SHAPE}")


def shapes(rasters: DataFrame, settings: Common | None = None, primitive_first: bool = False, key: str = KEY, by_value: bool = False) -> DataFrame:
    """(key, SHAPE) of rasters (key, width, height, data): one byte a cell, set where not zero; by_value: a mask for each byte
    but zero. The settings' type is the order of fitting. An image without shapes, an empty or a null one gives no row."""
    from rastrel.kernels import vectorize

    s = vectorize.settings_of(primitive_first, settings)

    def kernel(cells: np.ndarray, scale: tuple[float, float]) -> Iterator[dict]:
        for value in np.unique(cells[cells > 0]) if by_value else [1] if cells.any() else []:
            found = vectorize.shapes(cells == value if by_value else cells > 0, settings=s, scale=scale)
            yield from ({"value": int(value), "ordinal": k} | shape_row(*x) for k, x in enumerate(found))

    return _map(rasters, "data", kernel, key, s, by_value=by_value)


def color_shapes(images: DataFrame, settings: ClassifyFirst | None = None, key: str = KEY) -> DataFrame:
    """(key, SHAPE) of colour images (key, width, height, rgb): quantized to max_colors, near colours merged, the background
    left out, and a layer for each other colour by descending count of pixels. value is a colour's place in the palette."""
    from rastrel.kernels import color, vectorize

    s = settings or ClassifyFirst()

    def kernel(rgb: np.ndarray, scale: tuple[float, float]) -> Iterator[dict]:
        if not rgb.size:
            return
        found = color.segment(rgb, None, s.max_colors, s.quantization_method, s.color_distance_threshold, s.merge_similar_colors, s.background_mode, s.background_color)
        for layer in found.layers:
            drawn = vectorize.shapes(layer.mask, settings=s, scale=scale, layer_id=layer.layer_id, z=layer.z, fill=layer.colour.hex)
            yield from ({"value": layer.colour.ix, "ordinal": k} | shape_row(*x) for k, x in enumerate(drawn))

    return _map(images, "rgb", kernel, key, s, 3)


def markups(found: DataFrame, fill: str | Column | None = None, key: str = KEY, stroke: str | None = None) -> DataFrame:
    """(key, z, ordinal, markup): a primitive's tag for shapes without holes, else paths; holes are painted over. Layers are
    groups: their shapes stand between a g tag and its end."""
    fill = F.coalesce("fill", F.lit("#000000")) if fill is None else fill if isinstance(fill, Column) else F.lit(fill)
    c = {n: F.coalesce(n, F.lit(0.0)) for n in ("cx", "cy", "rx", "ry", "angle", "radius")}
    path = lambda p, f, line: F.concat(F.lit('<path d="'), p, F.lit('" '), documents.paint(f, line), F.lit("/>"))
    tag = F.when(F.col("n_holes") == 0, documents.primitive_markup(F.col("kind"), c, fill, stroke))
    lines = F.concat(F.array(F.coalesce(tag, path(F.col("path"), fill, stroke))), F.transform("hole_paths", lambda p: path(p, F.lit(documents.HOLE_FILL), None)))
    lines = F.concat(
        F.when((F.col("ordinal") == 0) & F.col("layer_id").isNotNull(), F.array(F.concat(F.lit('<g id="'), documents.escape_attribute(F.col("layer_id")), F.lit('">')))).otherwise(F.array().cast("array<string>")), lines,
    )
    place = lambda m, k: F.struct(F.concat(F.format_string("%06d-", "ordinal"), F.format_string("%06d", k)).alias("ordinal"), m.alias("markup"))
    end = F.struct(F.lit("~").alias("ordinal"), F.lit("</g>").alias("markup"))
    lines = F.transform(lines, place)
    # The group's end goes along with its first shape, so that found is made once.
    lines = F.when((F.col("ordinal") == 0) & F.col("layer_id").isNotNull(), F.concat(lines, F.array(end))).otherwise(lines)
    return found.select(key, "z", F.explode(lines).alias("line")).select(key, "z", "line.ordinal", "line.markup")


def _svg(found: DataFrame, images: DataFrame, s: Common, key: str) -> DataFrame:
    first = "original_" if "original_width" in images.columns and not isinstance(s, PrimitiveFirst) else ""
    sizes = images.select(key, F.col(f"{first}width").alias("width"), F.col(f"{first}height").alias("height"), F.create_map().cast("map<string,string>").alias("metadata"))
    return documents.export_svg(markups(found, None, key, s.stroke_color), sizes, key, s.background)


def to_svg(rasters: DataFrame, settings: Common | None = None, primitive_first: bool = False, key: str = KEY) -> DataFrame:
    """(key, svg) for every raster, drawn and written in one pass; one without width or height has a null svg.

    A document is its raster's alone, so nothing is shuffled or joined; equal rasters of equal scales and sizes are drawn once
    by a worker."""
    from rastrel.kernels import document, vectorize

    s = vectorize.settings_of(primitive_first, settings)
    kind = rasters.schema[key].dataType.simpleString()
    leads_back = not isinstance(s, PrimitiveFirst)  # that order draws in the raster's coordinates
    scaled = leads_back and {"scale_x", "scale_y"} <= set(rasters.columns)
    first = "original_" if leads_back and "original_width" in rasters.columns else ""
    more = [*(["scale_x", "scale_y"] if scaled else []), f"{first}width", f"{first}height"]
    name, fields = f"svg {s!r}", pa.schema([("svg", pa.string())])

    def make(cells: np.ndarray, own: tuple) -> list[dict]:
        *scale, width, height = own
        if width is None or height is None:
            return [{"svg": None}]
        found = vectorize.shapes(cells > 0, settings=s, scale=tuple(scale) if scaled else (1.0, 1.0)) if cells.any() else []
        return [{"svg": document.export(document.assemble(width, height, [shape for shape, _, _ in found]), s.background)}]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                given = zip(*(part.column(c).to_pylist() for c in more), strict=True)
                found, _ = each_distinct(name, zip(planes(part, "data"), given, strict=True), make, fields)
                yield from found.add_column(0, key, part.column(key)).to_batches()

    return rasters.select(key, *dict.fromkeys(["width", "height", "data", *more])).mapInArrow(run, f"`{key}` {kind}, svg string")


def color_svg(images: DataFrame, settings: ClassifyFirst | None = None, key: str = KEY) -> DataFrame:
    """(key, svg) with a layer for each colour but the background. An image all of whose cells are background gets a
    document without shapes."""
    s = settings or ClassifyFirst()
    return _svg(color_shapes(images, s, key), images, s, key)


def statistics(found: DataFrame, key: str = KEY) -> DataFrame:
    """documents.document_stats() of SHAPE rows."""
    return documents.document_stats(found.select(key, "n_holes", "n_segments", F.coalesce("layer_id", F.lit("")).alias("layer"), "fill"), key)


def decode(images: DataFrame, settings: Common | None = None, key: str = KEY) -> DataFrame:
    """(key, width, height, data, threshold, original_width, original_height, scale_x, scale_y, grey, rgb) of rows of Spark's
    image source (key, image): alpha over white, resizing, grey, denoising, threshold and morphology by the settings.

    data is the mask as bytes, grey the denoised plane, rgb the colours; scales lead back to the original's coordinates.
    Rows with fewer than 1, or with 2, channels are left out."""
    from rastrel.kernels import decode as kernels

    s = settings or ClassifyFirst()
    kind = images.schema[key].dataType.simpleString()
    rows = images.select(key, F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("d")).where("n in (1, 3, 4)")
    whole, real, plane = pa.int32(), pa.float64(), pa.binary()
    schema = {"width": whole, "height": whole, "data": plane, "threshold": whole, "original_width": whole, "original_height": whole, "scale_x": real, "scale_y": real, "grey": plane, "rgb": plane}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kernels.preprocess(kernels.from_bgr(*row), s).row() for row in zip(*(batch.column(c).to_pylist() for c in ("w", "h", "n", "d")), strict=True)]
            yield pa.RecordBatch.from_pydict({key: batch.column(key)} | {n: pa.array([r[n] for r in found], t) for n, t in schema.items()})

    names = {whole: "int", real: "double", plane: "binary"}
    return rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} {names[t]}" for n, t in schema.items()))


def vectorize_images(images: DataFrame, settings: Common | None = None, key: str = KEY) -> DataFrame:
    """(key, svg) from rows of Spark's image source: the mode in the settings decides. `color` and `auto` draw colour layers
    and fall back to one colour where no layer has a shape; `monochrome` and the primitive-first order draw the mask."""
    s = settings or ClassifyFirst()
    planes_ = decode(images, s, key)
    if isinstance(s, PrimitiveFirst) or s.vectorization_mode == "monochrome":
        return to_svg(planes_, s, key=key)
    found = color_shapes(planes_, s, key)
    plain = planes_.join(found.select(key).distinct(), key, "left_anti")
    return _svg(found.unionByName(shapes(plain, s, key=key)), planes_, s, key)

"""Statistics of vector documents and the text of their markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.scalars import format_number, let

#: Holes are painted, not cut out.
HOLE_FILL = "#F2F2F2"


def document_stats(shapes: DataFrame, key: str = "image_id") -> DataFrame:
    """shapes (key, n_holes, n_segments, layer, fill) -> counts of shapes, holes, loops, segments (also as
    num_primitives), layers and distinct fills."""
    return shapes.groupBy(key).agg(
        F.count("*").alias("num_shapes"), F.sum("n_holes").cast("long").alias("num_holes"), F.sum(F.col("n_holes") + 1).cast("long").alias("num_loops"),
        F.sum("n_segments").cast("long").alias("num_segments"), F.sum("n_segments").cast("long").alias("num_primitives"),
        F.countDistinct("layer").alias("num_layers"), F.countDistinct("fill").alias("num_fills"),
    )


def escape_attribute(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def paint(fill: Column, stroke: str | None = None) -> Column:
    """Attributes of a fill and, where there is one, a stroke."""
    line = F.concat(F.lit(' stroke="'), escape_attribute(F.lit(stroke)), F.lit('"')) if stroke else F.lit("")
    return F.concat(F.lit('fill="'), escape_attribute(fill), F.lit('"'), line)


def primitive_markup(kind: Column, p: dict[str, Column], fill: Column, stroke: str | None = None) -> Column:
    """A circle, ellipse or (rounded) rectangle tag; turned where the angle is 0.001 degrees or more; null for other kinds."""
    numbers = (p["cx"], p["cy"], p["rx"], p["ry"], p["angle"], p["radius"], p["cx"] - p["rx"], p["cy"] - p["ry"], 2 * p["rx"], 2 * p["ry"])

    def tag(t: Column) -> Column:
        cx, cy, rx, ry, angle, radius, x, y, wide, high = (t[k] for k in range(10))
        tail = F.concat(F.lit(" "), paint(fill, stroke))
        turn = F.when(F.abs(p["angle"]) >= 1e-3, F.concat(F.lit(' transform="rotate('), angle, F.lit(" "), cx, F.lit(" "), cy, F.lit(')"'))).otherwise(F.lit(""))
        centre = F.concat(F.lit('cx="'), cx, F.lit('" cy="'), cy, F.lit('"'))
        corner = F.when(p["radius"] > 0, F.concat(F.lit(' rx="'), radius, F.lit('"'))).otherwise(F.lit(""))
        box = F.concat(F.lit('<rect x="'), x, F.lit('" y="'), y, F.lit('" width="'), wide, F.lit('" height="'), high, F.lit('"'), corner, tail, turn, F.lit("/>"))
        return (
            F.when(kind == "circle", F.concat(F.lit("<circle "), centre, F.lit(' r="'), rx, F.lit('"'), tail, F.lit("/>")))
            .when(kind == "ellipse", F.concat(F.lit("<ellipse "), centre, F.lit(' rx="'), rx, F.lit('" ry="'), ry, F.lit('"'), tail, turn, F.lit("/>")))
            .when(kind.isin("rectangle", "rounded_rectangle"), box)
        )

    return let(F.transform(F.array(*[n.cast("double") for n in numbers]), format_number), tag)


def polygon_path(points: Column) -> Column:
    """Relative path data of a closed polygon of array<struct<x, y>>; each step is written from the exact point before."""
    text = lambda q, k: F.array_join(F.transform(F.when(k == 0, F.array(q["x"], q["y"])).otherwise(F.array(q["x"] - F.get(points, k - 1)["x"], q["y"] - F.get(points, k - 1)["y"])), format_number), " ")
    step = F.transform(points, lambda q, k: F.concat(F.when(k == 0, "m ").otherwise("l "), text(q, k)))
    return F.concat(F.array_join(step, " "), F.lit(" z"))


def export_svg(markups: DataFrame, sizes: DataFrame, key: str = "image_id", background: str | None = None) -> DataFrame:
    """(key, svg): the lines of each image (key, z, ordinal, markup) in order within its header; images without any get an empty document.

    sizes: key, width, height and a map `metadata` that may hold viewBox numbers."""
    from rastrel.functions.scalars import metadata_float

    lines = markups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("z", "ordinal", "markup"))).alias("lines"))
    box = [metadata_float(F.col("metadata"), f"viewBox_{k}", 0.0) for k in ("x", "y")]
    wide = F.coalesce(F.try_element_at("metadata", F.lit("viewBox_width")).try_cast("double"), F.col("width").cast("double"))
    high = F.coalesce(F.try_element_at("metadata", F.lit("viewBox_height")).try_cast("double"), F.col("height").cast("double"))
    numbers = F.transform(F.array(*[n.cast("double") for n in (F.col("width"), F.col("height"), *box, wide, high)]), format_number)
    head = let(numbers, lambda t: F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), t[0], F.lit('" height="'), t[1], F.lit('" viewBox="'), F.array_join(F.slice(t, 3, 4), " "), F.lit('">\n')))
    ground = F.concat(F.lit('<rect width="100%" height="100%" fill="'), escape_attribute(F.lit(background)), F.lit('"/>\n')) if background else F.lit("")
    body = F.coalesce(F.concat(F.array_join(F.transform("lines", lambda x: x["markup"]), "\n"), F.lit("\n")), F.lit(""))
    return sizes.join(lines, key, "left").select(key, F.concat(head, ground, body, F.lit("</svg>")).alias("svg"))

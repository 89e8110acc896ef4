"""Queries of typed segments: loops of primitives made from parts, curves and path text around the rings of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.operators import segments, spans
from rastrel.operators.segments import NUMBERS
from rastrel.plans.ring_queries import _NEAR
from rastrel.sources.procedural import rings as event_rings


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitives from parts: centre, half sides, corner radius, turn and arms."""
    key, size = F.col("p_partkey").cast("long"), F.col("p_size")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(
        key.alias("id"), (key % 50).cast("double").alias("cx"), size.cast("double").alias("cy"), (10 + size % 7).cast("double").alias("a"), (5 + size % 5).cast("double").alias("b"),
        (size % 4).cast("double").alias("r"), (key % 90).cast("double").alias("rot"), (3 + size % 6).cast("int").alias("arms"),
    )


def _flat(rows: DataFrame, loop: Column, key: str = "id") -> DataFrame:
    """A row for each segment of a loop."""
    got = rows.select(key, F.posexplode(loop).alias("seg_ix", "s"))
    return got.select(key, "seg_ix", F.col("s.kind").alias("kind"), *[F.round(F.col(f"s.{n}"), 6).alias(n) for n in NUMBERS], F.col("s.large_arc").alias("large_arc"), F.col("s.sweep").alias("sweep"))


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def circle_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_parts(spark, sf_dir), segments.circle(*_c("cx", "cy", "a")))


def circle_cubic_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_parts(spark, sf_dir), segments.circle_cubics(*_c("cx", "cy", "a")))


def ellipse_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_parts(spark, sf_dir), segments.ellipse(*_c("cx", "cy", "a", "b", "rot")))


def rectangle_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_parts(spark, sf_dir), segments.rectangle(*_c("cx", "cy", "a", "b", "rot")))


def rounded_rectangle_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_parts(spark, sf_dir), segments.rounded_rectangle(*_c("cx", "cy", "a", "b", "r", "rot")))


def _star(rows: DataFrame) -> DataFrame:
    return rows.withColumn("points", segments.star_points(*_c("cx", "cy", "a", "b", "arms"), F.radians("rot")))


def star_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _star(_parts(spark, sf_dir))
    return _flat(rows, segments.polyline(F.col("points")))


def triangle_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isosceles triangles: an apex above a base."""
    c = F.col
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = F.array(point(c("cx"), c("cy") - c("b")), point(c("cx") + c("a"), c("cy") + c("b")), point(c("cx") - c("a"), c("cy") + c("b")))
    return _flat(_parts(spark, sf_dir), segments.polyline(corners))


def rotated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    x, y = segments.rotate(*_c("cx", "cy", "rot", "a", "b"))
    return rows.select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _all(c=F.col) -> Column:
    """One loop of all kinds: two arcs, two elliptical arcs, four cubics, four lines."""
    names = lambda *n: [c(x) for x in n]
    return F.concat(segments.circle(*names("cx", "cy", "a")), segments.ellipse(*names("cx", "cy", "a", "b", "rot")), segments.circle_cubics(*names("cx", "cy", "b")), segments.rectangle(*names("cx", "cy", "a", "b", "rot")))


def segment_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of segments, twice as wide and half as high again."""
    return _flat(_parts(spark, sf_dir), segments.scale_loop(_all(), F.lit(2.0), F.lit(1.5)))


def primitive_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = F.struct(F.element_at(F.array(*[F.lit(k) for k in ("circle", "ellipse", "rounded_rectangle")]), (c("id") % 3 + 1).cast("int")).alias("kind"), c("cx"), c("cy"), c("a").alias("rx"), c("b").alias("ry"), c("rot"), c("r").alias("radius"))
    sy = F.when(c("id") % 2 == 0, 2.0).otherwise(1.5)
    got = _parts(spark, sf_dir).select("id", segments.scale_primitive(p, F.lit(2.0), sy).alias("p"), segments.needs_rescale(F.lit(2.0), sy).alias("needed"))
    return got.select("id", "needed", F.col("p.kind").alias("kind"), *[F.round(F.col(f"p.{n}"), 6).alias(n) for n in ("cx", "cy", "rx", "ry", "rot", "radius")])


def segment_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of segments in a mirror at x = 25."""
    return _flat(_parts(spark, sf_dir), segments.mirror_loop(_all(), F.lit(25.0)))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.arrays(event_rings(spark, sf_dir))


def _around(make) -> Column:
    """A segment from each point to the next by the four points around."""
    p = F.col("points")
    xy = lambda q: (q["x"], q["y"])
    return F.transform(p, lambda q, k: make(xy(spans.at(p, k - 1)), xy(q), xy(spans.at(p, k + 1)), xy(spans.at(p, k + 2))))


def polyline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _flat(_rings(spark, sf_dir), segments.polyline(F.col("points")), "ring_id")
    return got.select("ring_id", "seg_ix", "kind", "sx", "sy", "ex", "ey")


def polyline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("ring_id", segments.path_data(segments.polyline(F.col("points"))).alias("path"))


def arc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of circles and of rounded rectangles that aren't turned."""
    c = F.col
    rows = _parts(spark, sf_dir)
    boxes = segments.rounded_rectangle(*_c("cx", "cy", "a", "b"), c("r") + 1, F.lit(0.0))
    return rows.select("id", segments.path_data(segments.circle(*_c("cx", "cy", "a"))).alias("circle"), segments.path_data(boxes).alias("box"))


def catmull_rom_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _flat(_rings(spark, sf_dir), _around(segments.catmull_rom), "ring_id")
    return got.select("ring_id", "seg_ix", "c1x", "c1y", "c2x", "c2y")


def cardinal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _flat(_rings(spark, sf_dir), _around(segments.cardinal), "ring_id")
    return got.select("ring_id", "seg_ix", "c1x", "c1y", "c2x", "c2y")


def cubic_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge as a cubic, and each corner as a quadratic between its neighbours raised to a cubic."""
    lines = _flat(_rings(spark, sf_dir), _around(lambda p, a, b, q: segments.line_as_cubic(segments.line(a, b))), "ring_id")
    bends = _flat(_rings(spark, sf_dir), _around(lambda p, a, b, q: segments.quadratic_as_cubic(segments.segment("Q", p, b, a))), "ring_id")
    names = ("c1x", "c1y", "c2x", "c2y")
    return lines.select("ring_id", "seg_ix", *names).join(bends.select("ring_id", "seg_ix", *[F.col(n).alias("q" + n) for n in names]), ["ring_id", "seg_ix"])


def merged_cubics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of neighbouring curves, and the curve over both."""
    rows = _rings(spark, sf_dir).withColumn("s", _around(segments.cardinal))
    s = F.col("s")
    both = F.transform(s, lambda x, k: F.struct(segments.chord(x).alias("chord"), segments.merged_cubic(x, F.get(s, F.pmod(k + 1, F.size(s)))).alias("m")))
    got = rows.select("ring_id", F.posexplode(both).alias("seg_ix", "b"))
    return got.select("ring_id", "seg_ix", F.round("b.chord", 6).alias("chord"), *[F.round(F.col(f"b.m.{n}"), 6).alias(n) for n in ("ex", "ey", "c1x", "c1y", "c2x", "c2y")])


def segment_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point a quarter along a line, a quadratic and a cubic from each place."""
    rows = _rings(spark, sf_dir)
    out = None
    for name, make in (("line", lambda p, a, b, q: segments.line(a, b)), ("quadratic", lambda p, a, b, q: segments.segment("Q", p, b, a)), ("cubic", segments.cardinal)):
        got = rows.select("ring_id", F.posexplode(_around(make)).alias("seg_ix", "s"))
        x, y = segments.point_at(F.col("s"), 0.25)
        got = got.select("ring_id", "seg_ix", F.lit(name).alias("kind"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
        out = got if out is None else out.unionByName(got)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        circle_loop, circle_cubic_loop, ellipse_loop, rectangle_loop, rounded_rectangle_loop, star_loop, triangle_loop, rotated_points, segment_scaling, primitive_scaling, segment_mirror,
        polyline_segments, polyline_paths, arc_paths, catmull_rom_segments, cardinal_segments, cubic_elevation, merged_cubics, segment_points,
    )
}

_PARTS = """pt AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 50 AS DOUBLE) AS cx, CAST(p_size AS DOUBLE) AS cy, CAST(10 + p_size % 7 AS DOUBLE) AS a, CAST(5 + p_size % 5 AS DOUBLE) AS b,
  CAST(p_size % 4 AS DOUBLE) AS r, CAST(p_partkey % 90 AS DOUBLE) AS rot, CAST(3 + p_size % 6 AS INTEGER) AS arms FROM part)"""
_D, _N = "CAST(NULL AS DOUBLE)", "CAST(NULL AS BOOLEAN)"


def _turn(x: str, y: str, rot: str = "rot") -> tuple[str, str]:
    return f"cx + ({x}) * cos(radians({rot})) - ({y}) * sin(radians({rot}))", f"cy + ({x}) * sin(radians({rot})) + ({y}) * cos(radians({rot}))"


def _row(k: int, kind: str, s: tuple[str, str], e: tuple[str, str], c1=(_D, _D), c2=(_D, _D), arc=(_D, _D, _D), flags=(_N, _N), where: str = "TRUE") -> str:
    values = zip(NUMBERS, (*s, *e, *c1, *c2, *arc), strict=True)
    return f"SELECT id, {k} AS seg_ix, '{kind}' AS kind, {', '.join(f'CAST({v} AS DOUBLE) AS {n}' for n, v in values)}, {flags[0]} AS large_arc, {flags[1]} AS sweep FROM pt WHERE {where}"


_HALF = ("FALSE", "TRUE")


def _circle(k: int = 0) -> list[str]:
    at = (("cx + a", "cy"), ("cx - a", "cy"))
    return [_row(k + j, "A", at[j], at[1 - j], arc=("a", "a", _D), flags=_HALF) for j in (0, 1)]


def _ellipse(k: int = 0) -> list[str]:
    at = (_turn("a", "0"), _turn("-a", "0"))
    return [_row(k + j, "E", at[j], at[1 - j], arc=("a", "b", "rot"), flags=_HALF) for j in (0, 1)]


def _cubics(k: int = 0, r: str = "a") -> list[str]:
    unit = ((1, 0), (0, 1), (-1, 0), (0, -1))
    at = lambda u, v: (f"cx + {r} * ({u})", f"cy + {r} * ({v})")
    q = segments.QUARTER
    return [_row(k + j, "C", at(*a), at(*b), at(f"{a[0]} + {q} * {b[0]}", f"{a[1]} + {q} * {b[1]}"), at(f"{b[0]} + {q} * {a[0]}", f"{b[1]} + {q} * {a[1]}")) for j, (a, b) in enumerate(zip(unit, (*unit[1:], unit[0]), strict=True))]


def _rectangle(k: int = 0, where: str = "TRUE") -> list[str]:
    at = [_turn(x, y) for x, y in (("a", "-b"), ("a", "b"), ("-a", "b"), ("-a", "-b"))]
    return [_row(k + j, "L", at[j], at[(j + 1) % 4], where=where) for j in range(4)]


def _rounded(rot: str = "rot", r: str = "r") -> list[str]:
    corner = (("a", f"{r} - b"), ("a", f"b - {r}"), (f"a - {r}", "b"), (f"{r} - a", "b"), ("-a", f"b - {r}"), ("-a", f"{r} - b"), (f"{r} - a", "-b"), (f"a - {r}", "-b"))
    at = [_turn(x, y, rot) for x, y in corner]
    out = []
    for k in range(0, 8, 2):
        out.append(_row(k, "L", at[k], at[k + 1], where=f"{r} > 1e-3"))
        out.append(_row(k + 1, "A", at[k + 1], at[(k + 2) % 8], arc=(r, r, _D), flags=_HALF, where=f"{r} > 1e-3"))
    return out


def _loop(rows: list[str], final: str | None = None) -> str:
    numbers = ", ".join(f"round({n}, 6) AS {n}" for n in NUMBERS)
    return f"WITH {_PARTS}, sg AS ({' UNION ALL '.join(rows)}) " + (final or f"SELECT id, seg_ix, kind, {numbers}, large_arc, sweep FROM sg")


_EVERY = _circle() + _ellipse(2) + _cubics(4, "b") + _rectangle(8)
_SCALED = {n: f"{n} * {2 if n.endswith('x') else 1.5}" for n in NUMBERS[:8]} | {"rx": "rx * CASE WHEN kind = 'A' THEN 1.75 ELSE 2 END", "ry": "ry * CASE WHEN kind = 'A' THEN 1.75 ELSE 1.5 END", "rot": "rot"}
_MIRRORED = {"sx": "50 - ex", "sy": "ey", "ex": "50 - sx", "ey": "sy", "c1x": "50 - c2x", "c1y": "c2y", "c2x": "50 - c1x", "c2y": "c1y", "rx": "rx", "ry": "ry", "rot": "-rot"}


def _changed(values: dict[str, str], ix: str) -> str:
    return f"SELECT id, {ix} AS seg_ix, kind, {', '.join(f'round({v}, 6) AS {n}' for n, v in values.items())}, large_arc, sweep FROM sg"


def _text(v: str) -> str:
    """A number in SQL as curves.number() writes it."""
    short = f"regexp_replace(regexp_replace(printf('%.2f', {v}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    return f"CASE WHEN abs({v}) < 1e-9 OR {short} IN ('-0', '') THEN '0' ELSE {short} END"


_FOUR = f"""{_NEAR}, fo AS (SELECT a.*, b.nx AS qx, b.ny AS qy FROM nb a JOIN nb b ON a.ring_id = b.ring_id AND b.i = (a.i + 1) % a.n)"""
_CARDINAL = f"{_FOUR}, ca AS (SELECT ring_id, i, n, x, y, nx, ny, x + 0.16 * (nx - px) AS c1x, y + 0.16 * (ny - py) AS c1y, nx - 0.16 * (qx - x) AS c2x, ny - 0.16 * (qy - y) AS c2y FROM fo)"


def _held(o: str, h: str) -> str:
    """A handle (h + x, h + y) from point (o + x, o + y) of the chord x, y - nx, ny."""
    size, chord = f"sqrt(pow({h}x - {o}x, 2) + pow({h}y - {o}y, 2))", "sqrt(pow(nx - x, 2) + pow(ny - y, 2))"
    return f"CASE WHEN {size} <= 0.45 * {chord} OR {size} < 1e-12 THEN 1 ELSE 0.45 * {chord} / {size} END"


_ROUND4 = ", ".join(f"round({n}, 6) AS {n}" for n in ("c1x", "c1y", "c2x", "c2y"))
SQL = {
    "circle_loop": _loop(_circle()), "circle_cubic_loop": _loop(_cubics()), "ellipse_loop": _loop(_ellipse()), "rectangle_loop": _loop(_rectangle()),
    "rounded_rectangle_loop": _loop(_rounded() + _rectangle(0, "r <= 1e-3")),
    "star_loop": f"""WITH {_PARTS}, vt AS (SELECT id, arms, CAST(k AS INTEGER) AS k, cx + CASE WHEN k % 2 = 0 THEN a ELSE b END * cos(radians(rot) + k * pi() / arms) AS x,
  cy + CASE WHEN k % 2 = 0 THEN a ELSE b END * sin(radians(rot) + k * pi() / arms) AS y FROM pt, range(16) t(k) WHERE k < 2 * arms)
SELECT v.id, v.k AS seg_ix, 'L' AS kind, round(v.x, 6) AS sx, round(v.y, 6) AS sy, round(w.x, 6) AS ex, round(w.y, 6) AS ey, {', '.join(f'{_D} AS {n}' for n in NUMBERS[4:])}, {_N} AS large_arc, {_N} AS sweep
FROM vt v JOIN vt w ON v.id = w.id AND w.k = (v.k + 1) % (2 * v.arms)""",
    "triangle_loop": _loop([_row(k, "L", s, e) for k, (s, e) in enumerate(((("cx", "cy - b"), ("cx + a", "cy + b")), (("cx + a", "cy + b"), ("cx - a", "cy + b")), (("cx - a", "cy + b"), ("cx", "cy - b"))))]),
    "rotated_points": f"WITH {_PARTS} SELECT id, round({_turn('a', 'b')[0]}, 6) AS x, round({_turn('a', 'b')[1]}, 6) AS y FROM pt",
    "segment_scaling": _loop(_EVERY, _changed(_SCALED, "seg_ix")),
    "primitive_scaling": f"""WITH {_PARTS}, sc AS (SELECT *, CASE WHEN id % 2 = 0 THEN 2.0 ELSE 1.5 END AS sy FROM pt)
SELECT id, TRUE AS needed, CASE id % 3 WHEN 0 THEN CASE WHEN sy = 2 THEN 'circle' ELSE 'ellipse' END WHEN 1 THEN 'ellipse' ELSE 'rounded_rectangle' END AS kind,
  CAST(cx * 2 AS DOUBLE) AS cx, CAST(cy * sy AS DOUBLE) AS cy, CAST(a * 2 AS DOUBLE) AS rx, CAST(b * sy AS DOUBLE) AS ry, rot, CAST(r * (2 + sy) / 2 AS DOUBLE) AS radius FROM sc""",
    "segment_mirror": _loop(_EVERY, _changed(_MIRRORED, "11 - seg_ix")),
    "polyline_segments": f"WITH {_NEAR} SELECT ring_id, i AS seg_ix, 'L' AS kind, round(x, 6) AS sx, round(y, 6) AS sy, round(nx, 6) AS ex, round(ny, 6) AS ey FROM nb",
    "polyline_paths": f"""WITH {_NEAR} SELECT ring_id, string_agg(CASE WHEN i = 0 THEN 'm ' || ({_text('x')}) || ' ' || ({_text('y')}) || ' ' ELSE '' END
  || 'l ' || ({_text('(nx - x)')}) || ' ' || ({_text('(ny - y)')}), ' ' ORDER BY i) || ' z' AS path FROM nb GROUP BY 1""",
    "arc_paths": f"""WITH {_PARTS}, sg AS ({' UNION ALL '.join(['SELECT 0 AS shape, * FROM (' + x + ')' for x in _circle()] + ['SELECT 1 AS shape, * FROM (' + x + ')' for x in _rounded('0', '(r + 1)')])}),
tx AS (SELECT shape, id, string_agg(CASE WHEN seg_ix = 0 THEN 'm ' || ({_text('sx')}) || ' ' || ({_text('sy')}) || ' ' ELSE '' END || CASE WHEN kind = 'L' THEN 'l ' ELSE 'a ' || ({_text('rx')}) || ' ' || ({_text('ry')}) || ' 0 0 1 ' END
  || ({_text('(ex - sx)')}) || ' ' || ({_text('(ey - sy)')}), ' ' ORDER BY seg_ix) || ' z' AS path FROM sg GROUP BY ALL)
SELECT a.id, a.path AS circle, b.path AS box FROM tx a JOIN tx b ON a.id = b.id AND a.shape = 0 AND b.shape = 1""",
    "catmull_rom_segments": f"""WITH {_FOUR}, ha AS (SELECT *, x + (nx - px) * 0.72 / 6 AS hx, y + (ny - py) * 0.72 / 6 AS hy, nx - (qx - x) * 0.72 / 6 AS gx, ny - (qy - y) * 0.72 / 6 AS gy FROM fo),
sh AS (SELECT *, {_held('', 'h')} AS s, {_held('n', 'g')} AS t FROM ha)
SELECT ring_id, i AS seg_ix, round(x + (hx - x) * s, 6) AS c1x, round(y + (hy - y) * s, 6) AS c1y, round(nx + (gx - nx) * t, 6) AS c2x, round(ny + (gy - ny) * t, 6) AS c2y FROM sh""",
    "cardinal_segments": f"WITH {_CARDINAL} SELECT ring_id, i AS seg_ix, {_ROUND4} FROM ca",
    "cubic_elevation": f"""WITH {_NEAR} SELECT ring_id, i AS seg_ix, round(x + (nx - x) / 3, 6) AS c1x, round(y + (ny - y) / 3, 6) AS c1y, round(nx - (nx - x) / 3, 6) AS c2x, round(ny - (ny - y) / 3, 6) AS c2y,
  round(px + (x - px) * 2 / 3, 6) AS qc1x, round(py + (y - py) * 2 / 3, 6) AS qc1y, round(nx + (x - nx) * 2 / 3, 6) AS qc2x, round(ny + (y - ny) * 2 / 3, 6) AS qc2y FROM nb""",
    "merged_cubics": f"""WITH {_CARDINAL} SELECT a.ring_id, a.i AS seg_ix, round(sqrt(pow(a.nx - a.x, 2) + pow(a.ny - a.y, 2)), 6) AS chord, round(b.nx, 6) AS ex, round(b.ny, 6) AS ey,
  round(a.c1x, 6) AS c1x, round(a.c1y, 6) AS c1y, round(b.c2x, 6) AS c2x, round(b.c2y, 6) AS c2y FROM ca a JOIN ca b ON a.ring_id = b.ring_id AND b.i = (a.i + 1) % a.n""",
    "segment_points": f"""WITH {_CARDINAL}
SELECT ring_id, i AS seg_ix, 'line' AS kind, round(0.75 * x + 0.25 * nx, 6) AS x, round(0.75 * y + 0.25 * ny, 6) AS y FROM nb
UNION ALL SELECT ring_id, i, 'quadratic', round(0.5625 * px + 0.375 * x + 0.0625 * nx, 6), round(0.5625 * py + 0.375 * y + 0.0625 * ny, 6) FROM nb
UNION ALL SELECT ring_id, i, 'cubic', round(0.421875 * x + 0.421875 * c1x + 0.140625 * c2x + 0.015625 * nx, 6), round(0.421875 * y + 0.421875 * c1y + 0.140625 * c2y + 0.015625 * ny, 6) FROM ca""",
}

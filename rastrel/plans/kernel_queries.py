"""Queries whose steps depend on order or iterate: array kernels for each image or ring."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.operators import images
from rastrel.plans import pipelines, pixel_queries, span_queries
from rastrel.plans.ring_queries import _ANGLES, _MEASURES, _NEAR
from rastrel.plans.segment_queries import _text
from rastrel.sources import procedural as sources
from rastrel.sources.procedural import RINGS_SQL, SIDE


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.masks(sources.images(spark, sf_dir, ("grey",)))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings as two arrays a row."""
    points = sources.rings(spark, sf_dir).groupBy("ring_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    return points.select("ring_id", F.transform("p", lambda q: q["x"]).alias("xs"), F.transform("p", lambda q: q["y"]).alias("ys"))


def _per_ring(rows: DataFrame, kernel, schema: str) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"ring_id": r.ring_id} | kernel(np.stack([r.xs, r.ys], 1)) for r in frame.itertuples()], columns=["ring_id", *[f.split()[0] for f in schema.split(", ")]])

    return rows.mapInPandas(run, f"ring_id long, {schema}")


def _per_mask(rows: DataFrame, kernel, schema: str) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                mask = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) != 0
                out += [{"image_id": r.image_id} | row for row in kernel(mask)]
            yield pd.DataFrame(out, columns=["image_id", *[f.split()[0] for f in schema.split(", ")]])

    return rows.mapInPandas(run, f"image_id long, {schema}")


def small_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set cells before and after components of fewer than 40 cells go."""
    from rastrel.kernels import raster as kernels

    return _per_mask(_rasters(spark, sf_dir), lambda m: [{"n_before": int(m.sum()), "n_after": int(kernels.remove_small(m, 40).sum())}], "n_before long, n_after long")


def tiny_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set cells before and after holes of at most 40 cells are filled."""
    from rastrel.kernels import raster as kernels

    return _per_mask(_rasters(spark, sf_dir), lambda m: [{"n_before": int(m.sum()), "n_after": int(kernels.fill_holes(m, 40).sum())}], "n_before long, n_after long")


def contour_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import raster as kernels

    def kernel(mask: np.ndarray) -> list[dict]:
        return [{"contour": b["id"], "parent": -1 if b["parent"] is None else b["parent"], "hole": b["hole"], "depth": b["depth"], "points": len(b["cells"])} for b in kernels.borders(mask)]

    return _per_mask(_rasters(spark, sf_dir), kernel, "contour int, parent int, hole boolean, depth int, points long")


def contour_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders of every image with what they lie in, numbered by their first cells."""
    return contour_trace(spark, sf_dir).select("image_id", "contour", "parent", "hole", "depth")


def cleanup_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import ring

    def kernel(p: np.ndarray) -> dict:
        q = ring.clean(p, gap=0.5)
        return {"points": len(p), "kept": len(q), "area": round(ring.area(q), 6)}

    return _per_ring(_arrays(spark, sf_dir), kernel, "points long, kept long, area double")


def douglas_peucker(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import ring

    return _per_ring(_arrays(spark, sf_dir), lambda p: {"points": len(p), "kept": len(ring.simplify_closed(p, 2.0))}, "points long, kept long")


def schneider_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import curves, ring

    def kernel(p: np.ndarray) -> dict:
        found = curves.fit_closed(p, ring.hard_corners(p), 2.0)
        return {"curves": len(found), "path": curves.path(found)}

    return _per_ring(_arrays(spark, sf_dir), kernel, "curves long, path string")


def enclosing_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import ring

    return _per_ring(_arrays(spark, sf_dir), lambda p: dict(zip(("cx", "cy", "r"), (round(v, 6) for v in ring.enclosing_circle(p)), strict=True)), "cx double, cy double, r double")


def circular_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arc through the first half of each ring."""
    from rastrel.kernels import curves

    names = ("cx", "cy", "r", "start", "sweep", "confidence")
    return _per_ring(_arrays(spark, sf_dir), lambda p: {k: round(v, 6) for k, v in (curves.arc_fit(p[: len(p) // 2 + 1]) or dict.fromkeys(names, float("nan"))).items()}, ", ".join(f"{n} double" for n in names))


def shape_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import ring

    def kernel(p: np.ndarray) -> dict:
        d = ring.describe(p)
        return {k: round(float(d[k]), 6) for k in ("area", "perimeter", "circularity", "solidity", "aspect", "symmetry")} | {"corners": d["corners"], "extrema": d["extrema"]}

    return _per_ring(_arrays(spark, sf_dir), kernel, "area double, perimeter double, circularity double, solidity double, aspect double, symmetry double, corners int, extrema int")


def straight_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import decompose

    def kernel(p: np.ndarray) -> dict:
        marks = decompose.anchors(p, 2.0)
        found = decompose.straight_runs(p, marks, 2.0)
        return {"anchors": len(marks), "runs": len(found), "length": round(sum(r["length"] for r in found), 6)}

    return _per_ring(_arrays(spark, sf_dir), kernel, "anchors long, runs long, length double")


def spline_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import curves, decompose

    return _per_ring(_arrays(spark, sf_dir), lambda p: {"curves": len(found := decompose.spline_loop(p)), "path": curves.path(found)}, "curves long, path string")


def corner_fillets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.kernels import decompose

    def kernel(p: np.ndarray) -> dict:
        found = [f for k in range(len(p)) if (f := decompose.fillet(p[k - 1], p[k], p[(k + 1) % len(p)]))]
        return {"fillets": len(found), "radius": round(sum(f["radius"] for f in found), 6)}

    return _per_ring(_arrays(spark, sf_dir), kernel, "fillets long, radius double")


def shape_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region shapes of the rasters with their kinds."""
    return pipelines.shapes(_rasters(spark, sf_dir)).select("image_id", "region", "kind", "n_holes", F.round("area", 6).alias("area"))


def v1_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.to_svg(_rasters(spark, sf_dir))


def v2_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.to_svg(_rasters(spark, sf_dir), primitive_first=True)


def color_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.color_svg(sources.images(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (small_components, tiny_holes, contour_trace, contour_tree, cleanup_ring, douglas_peucker, schneider_fit, enclosing_circle, circular_arc, shape_descriptors, straight_runs, spline_loop, corner_fillets, shape_classes, v1_svg, v2_svg, color_svg)
}


def _components(reach: int) -> str:
    """CTEs of the components of set cells (8-connected with reach 1, else 4-connected) and of the 4-connected unset ones,
    with a margin around each image: rn has runs of a row by value v, lb the least run of each run's component."""
    return f"""{pixel_queries._MASK.replace('m0 AS (', 'm0 AS MATERIALIZED (', 1)}, pd AS MATERIALIZED (SELECT i.image_id, CAST(gx.x AS INTEGER) AS x, CAST(gy.y AS INTEGER) AS y, coalesce(m, FALSE) AS v FROM (SELECT DISTINCT image_id FROM m0) i, range(-1, {SIDE + 1}) gx(x), range(-1, {SIDE + 1}) gy(y)
  LEFT JOIN m0 ON m0.image_id = i.image_id AND m0.x = gx.x AND m0.y = gy.y),
rn AS MATERIALIZED (SELECT image_id, v, y, min(x) AS x0, max(x) AS x1, (y + 1) * 64 + min(x) + 1 AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y, v ORDER BY x) AS g FROM pd) GROUP BY image_id, v, y, g),
ed AS MATERIALIZED (SELECT a.image_id, a.v, a.id, b.id AS oid FROM rn a JOIN rn b ON a.image_id = b.image_id AND a.v = b.v AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + CASE WHEN a.v THEN {reach} ELSE 0 END AND b.x0 <= a.x1 + CASE WHEN a.v THEN {reach} ELSE 0 END),
lb(image_id, v, id, l) USING KEY (image_id, v, id) AS (SELECT image_id, v, id, id FROM rn UNION
  SELECT e.image_id, e.v, e.id, min(w.l) FROM lb w JOIN ed e ON e.image_id = w.image_id AND e.v = w.v AND e.oid = w.id JOIN recurring.lb a ON a.image_id = e.image_id AND a.v = e.v AND a.id = e.id WHERE w.l < a.l GROUP BY ALL),
cl AS (SELECT image_id, x, y, v, l FROM pd JOIN rn USING (image_id, v, y) JOIN lb USING (image_id, v, id) WHERE x BETWEEN x0 AND x1),
cs AS (SELECT image_id, v, l, count(*) AS n, min((y + 1) * 64 + x + 1) AS first FROM cl GROUP BY ALL)"""


def _simplified(tolerance: float) -> str:
    """CTEs of Douglas-Peucker on closed rings: kp has the places that stay. Spans are split at their farthest points."""
    off = "sqrt(pow(p.x - a.x - t * (b.x - a.x), 2) + pow(p.y - a.y - t * (b.y - a.y), 2))"
    return f"""{RINGS_SQL.replace('ring AS (', 'ring AS MATERIALIZED (', 1)}, un AS MATERIALIZED (SELECT ring_id, i, n, x, y FROM ring UNION ALL SELECT ring_id, i + n, n, x, y FROM ring),
m1 AS (SELECT ring_id, arg_min(i, (x, y)) AS a FROM ring GROUP BY 1),
m2 AS MATERIALIZED (SELECT r.ring_id, any_value(a) AS a, any_value(n) AS n, arg_max(r.i, (sqrt(pow(r.x - f.x, 2) + pow(r.y - f.y, 2)), -r.i)) AS b FROM ring r JOIN m1 USING (ring_id) JOIN (SELECT ring_id, i, x, y FROM ring) f ON f.ring_id = r.ring_id AND f.i = a GROUP BY 1),
sp(ring_id, a, b) AS (SELECT ring_id, least(a, b), greatest(a, b) FROM m2 UNION ALL SELECT ring_id, greatest(a, b), least(a, b) + n FROM m2
  UNION ALL SELECT ring_id, CASE WHEN h = 0 THEN a ELSE k END, CASE WHEN h = 0 THEN k ELSE b END FROM (
    SELECT ring_id, a, b, arg_max(i, (d, -i)) AS k, max(d) AS d FROM (
      SELECT s.ring_id, s.a, s.b, p.i, {off} AS d FROM (SELECT s.*, a.x AS ax FROM sp s JOIN un a ON a.ring_id = s.ring_id AND a.i = s.a) s JOIN un a ON a.ring_id = s.ring_id AND a.i = s.a JOIN un b ON b.ring_id = s.ring_id AND b.i = s.b
      JOIN un p ON p.ring_id = s.ring_id AND p.i > s.a AND p.i < s.b,
      LATERAL (SELECT CASE WHEN pow(b.x - a.x, 2) + pow(b.y - a.y, 2) > 1e-12 THEN greatest(0, least(1, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / (pow(b.x - a.x, 2) + pow(b.y - a.y, 2)))) ELSE 0 END AS t) q)
    GROUP BY ALL HAVING max(d) > {tolerance}), (VALUES (0), (1)) v(h)),
kp AS MATERIALIZED (SELECT DISTINCT sp.ring_id, sp.a % n AS i, n FROM sp JOIN m2 USING (ring_id))"""


#: Hull vertices: points from which all others are seen within half a turn. hl has them in order around the middle.
_HULL = f"""{RINGS_SQL}, se AS (SELECT a.ring_id, a.i, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM ring a JOIN ring b ON a.ring_id = b.ring_id AND (a.x <> b.x OR a.y <> b.y)),
ga AS (SELECT ring_id, i, x, y, coalesce(lead(t) OVER w - t, min(t) OVER v + 2 * pi() - t) AS g FROM se WINDOW w AS (PARTITION BY ring_id, i ORDER BY t), v AS (PARTITION BY ring_id, i)),
hv AS (SELECT ring_id, i, any_value(x) AS x, any_value(y) AS y FROM ga GROUP BY 1, 2 HAVING max(g) > pi() + 1e-12),
hl AS (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY atan2(y - my, x - mx)) AS k, count(*) OVER (PARTITION BY ring_id) AS c FROM (SELECT *, avg(x) OVER (PARTITION BY ring_id) AS mx, avg(y) OVER (PARTITION BY ring_id) AS my FROM hv))"""
#: Angles and measures of rings, without the CTE of the rings themselves.
_MORE = _ANGLES.removeprefix(RINGS_SQL + ", ") + "," + _MEASURES.removeprefix(_NEAR + ",")
_FIRST = "(first // 64 - 1) AS y, (first % 64 - 1) AS x"
SQL = {
    "small_components": f"WITH RECURSIVE {_components(0)} SELECT image_id, CAST(sum(n) AS BIGINT) AS n_before, CAST(coalesce(sum(n) FILTER (n >= 40), 0) AS BIGINT) AS n_after FROM cs WHERE v GROUP BY 1",
    "tiny_holes": f"""WITH RECURSIVE {_components(0)} SELECT image_id, CAST(sum(n) FILTER (v) AS BIGINT) AS n_before, CAST(sum(n) FILTER (v) + coalesce(sum(n) FILTER (NOT v AND n <= 40 AND l <> 0), 0) AS BIGINT) AS n_after FROM cs GROUP BY 1""",
    "contour_tree": f"""WITH RECURSIVE {_components(1)},
fi AS (SELECT image_id, v, l, {_FIRST} FROM cs WHERE v OR l <> 0),
bo AS (SELECT fi.image_id, fi.v, fi.l, NOT fi.v AS hole, CASE WHEN fi.v THEN fi.x ELSE fi.x - 1 END AS x, fi.y, cl.l AS beside FROM fi JOIN cl ON cl.image_id = fi.image_id AND cl.v <> fi.v AND cl.x = fi.x - 1 AND cl.y = fi.y),
nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x, hole) - 1 AS INTEGER) AS contour FROM bo),
up AS (SELECT a.image_id, a.contour, a.hole, coalesce(b.contour, -1) AS parent FROM nu a LEFT JOIN nu b ON b.image_id = a.image_id AND b.v <> a.v AND b.l = a.beside),
de AS (SELECT image_id, contour, parent, hole, 0 AS depth, parent AS at FROM up UNION ALL SELECT de.image_id, de.contour, de.parent, de.hole, depth + 1, up.parent FROM de JOIN up ON up.image_id = de.image_id AND up.contour = de.at)
SELECT image_id, contour, parent, hole, CAST(max(depth) AS INTEGER) AS depth FROM de GROUP BY ALL""",
    "circular_arc": span_queries.SQL["arc_fits"],
    "corner_fillets": f"""WITH {_ANGLES}, sh AS (SELECT ring_id, least(ea, eb) AS s, greatest(ea, eb) AS l, radians(angle) AS th FROM an WHERE angle < 180 - degrees(1e-3)),
ra AS (SELECT *, least(3.25, s * 0.11, 0.9 * 0.24 * s * tan(th / 2)) AS r FROM sh WHERE s > 1 AND s / l >= 0.58 AND th >= 1e-6),
ok AS (SELECT ring_id, r FROM ra WHERE r > 0.2 AND r / tan(th / 2) > 0.2 AND 2 * r / tan(th / 2) * sin(th / 2) > 0.5)
SELECT ring_id, count(r) AS fillets, coalesce(round(sum(r), 6), 0) AS radius FROM (SELECT DISTINCT ring_id FROM ring) LEFT JOIN ok USING (ring_id) GROUP BY 1""",
    "enclosing_circle": f"""WITH {_HULL}, c2 AS (SELECT a.ring_id, (a.x + b.x) / 2 AS cx, (a.y + b.y) / 2 AS cy, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 2 AS r FROM hv a JOIN hv b ON a.ring_id = b.ring_id AND a.i < b.i),
t3 AS (SELECT a.ring_id, a.x, a.y, b.x - a.x AS ux, b.y - a.y AS uy, c.x - a.x AS vx, c.y - a.y AS vy FROM hv a JOIN hv b ON a.ring_id = b.ring_id AND a.i < b.i JOIN hv c ON c.ring_id = b.ring_id AND b.i < c.i),
c3 AS (SELECT ring_id, x + (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / d AS cx, y + (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / d AS cy, ux, uy, vx, vy, x, y FROM (SELECT *, 2 * (ux * vy - uy * vx) AS d FROM t3) WHERE abs(d) > 1e-12),
al AS (SELECT ring_id, cx, cy, r FROM c2 UNION ALL SELECT ring_id, cx, cy, sqrt(pow(cx - x, 2) + pow(cy - y, 2)) FROM c3),
ok AS (SELECT al.ring_id, cx, cy, r FROM al JOIN hv USING (ring_id) GROUP BY ALL HAVING max(sqrt(pow(hv.x - cx, 2) + pow(hv.y - cy, 2))) <= r + 1e-7)
SELECT ring_id, round(arg_min(cx, r), 6) AS cx, round(arg_min(cy, r), 6) AS cy, round(min(r), 6) AS r FROM ok GROUP BY 1""",
    "douglas_peucker": f"WITH RECURSIVE {_simplified(2.0)} SELECT ring_id, n AS points, count(*) AS kept FROM (SELECT ring_id, CAST(n AS BIGINT) AS n FROM kp) GROUP BY ALL",
    "straight_runs": f"""WITH RECURSIVE {_simplified(2.0)}, nx AS (SELECT ring_id, i AS a, n, coalesce(lead(i) OVER w, min(i) OVER v + n) AS b FROM kp WINDOW w AS (PARTITION BY ring_id ORDER BY i), v AS (PARTITION BY ring_id)),
sg AS MATERIALIZED (SELECT s.ring_id, s.a, s.b, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM nx s JOIN un a ON a.ring_id = s.ring_id AND a.i = s.a JOIN un b ON b.ring_id = s.ring_id AND b.i = s.b),
pp AS MATERIALIZED (SELECT sg.*, p.x - ax AS px, p.y - ay AS py FROM sg JOIN un p ON p.ring_id = sg.ring_id AND p.i >= sg.a AND p.i <= sg.b),
tt AS (SELECT *, CASE WHEN dx * dx + dy * dy > 1e-12 THEN greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM pp),
dv AS (SELECT ring_id, a, b, sqrt(dx * dx + dy * dy) AS len, sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) AS d FROM tt),
rn AS (SELECT ring_id, a, len FROM dv GROUP BY ring_id, a, b, len HAVING max(d) <= 2 AND avg(d) <= 1.2 AND len >= 6)
SELECT ring_id, anchors, count(rn.a) AS runs, coalesce(round(sum(len), 6), 0) AS length FROM (SELECT ring_id, count(*) AS anchors FROM kp GROUP BY 1) LEFT JOIN rn USING (ring_id) GROUP BY ALL""",
    "spline_loop": f"""WITH RECURSIVE {_simplified(0.8)}, st AS (SELECT ring_id, least(a, b) AS begin FROM m2),
kq AS (SELECT kp.ring_id, (kp.i - begin + kp.n) % kp.n AS o, ring.x, ring.y FROM kp JOIN st USING (ring_id) JOIN ring ON ring.ring_id = kp.ring_id AND ring.i = kp.i),
kr AS (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY o) - 1 AS k, count(*) OVER (PARTITION BY ring_id) AS c FROM kq),
kn AS (SELECT q.*, p.x AS px, p.y AS py, n.x AS nx, n.y AS ny, m.x AS qx, m.y AS qy FROM kr q JOIN kr p ON p.ring_id = q.ring_id AND p.k = (q.k + q.c - 1) % q.c JOIN kr n ON n.ring_id = q.ring_id AND n.k = (q.k + 1) % q.c JOIN kr m ON m.ring_id = q.ring_id AND m.k = (q.k + 2) % q.c),
ks AS (SELECT *, 180 - degrees(acos(greatest(-1, least(1, ((px - x) * (nx - x) + (py - y) * (ny - y)) / (sqrt(pow(px - x, 2) + pow(py - y, 2)) * sqrt(pow(nx - x, 2) + pow(ny - y, 2))))))) >= 60 AS sharp,
  x + 0.16 * (nx - px) AS c1x, y + 0.16 * (ny - py) AS c1y, nx - 0.16 * (qx - x) AS c2x, ny - 0.16 * (qy - y) AS c2y, nx - x AS dx, ny - y AS dy, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM kn),
kl AS (SELECT a.*, a.sharp OR b.sharp OR (abs((a.c1x - a.x) * a.dy - (a.c1y - a.y) * a.dx) / a.len <= 0.25 AND abs((a.c2x - a.x) * a.dy - (a.c2y - a.y) * a.dx) / a.len <= 0.25) AS straight FROM ks a JOIN ks b ON a.ring_id = b.ring_id AND b.k = (a.k + 1) % a.c)
SELECT ring_id, count(*) AS curves, string_agg(CASE WHEN k = 0 THEN 'm ' || ({_text('x')}) || ' ' || ({_text('y')}) || ' ' ELSE '' END || CASE WHEN straight THEN 'l ' ELSE 'c ' || ({_text('(c1x - x)')}) || ' ' || ({_text('(c1y - y)')}) || ' ' || ({_text('(c2x - x)')}) || ' ' || ({_text('(c2y - y)')}) || ' ' END
  || ({_text('dx')}) || ' ' || ({_text('dy')}), ' ' ORDER BY k) || ' z' AS path FROM kl GROUP BY 1""",
    "shape_descriptors": f"""WITH {_HULL}, {_MORE},
ha AS (SELECT a.ring_id, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS around FROM hl a JOIN hl b ON a.ring_id = b.ring_id AND b.k = a.k % a.c + 1 GROUP BY 1),
so AS (SELECT a.ring_id, a.i, a.n, avg(180 - b.angle) AS s FROM an a JOIN an b ON a.ring_id = b.ring_id AND (b.i - a.i + a.n + 2) % a.n <= 4 GROUP BY ALL),
pk AS (SELECT a.ring_id, count(*) FILTER (a.s >= 35) AS corners, count(*) FILTER (a.s >= 18 AND a.s > b.s AND a.s >= c.s) AS extrema FROM so a JOIN so b ON a.ring_id = b.ring_id AND b.i = (a.i + a.n - 1) % a.n JOIN so c ON a.ring_id = c.ring_id AND c.i = (a.i + 1) % a.n GROUP BY 1),
po AS (SELECT ring_id, i, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d, CASE WHEN atan2(y - cy, x - cx) < 0 THEN atan2(y - cy, x - cx) + 2 * pi() ELSE atan2(y - cy, x - cx) END AS t FROM ring JOIN ms USING (ring_id)),
pw AS (SELECT ring_id, d, t FROM po UNION ALL SELECT ring_id, d, t - 2 * pi() FROM po UNION ALL SELECT ring_id, d, t + 2 * pi() FROM po),
sa AS (SELECT DISTINCT ring_id, k, k * 2 * pi() / 144 AS w FROM ring, range(144) r(k)),
iv AS (SELECT sa.ring_id, k, w, max(t) FILTER (t <= w) AS t0, min(t) FILTER (t > w) AS t1 FROM sa JOIN pw USING (ring_id) GROUP BY ALL),
sg AS (SELECT iv.ring_id, k, a.d + (b.d - a.d) * (w - t0) / (t1 - t0) AS r FROM iv JOIN pw a ON a.ring_id = iv.ring_id AND a.t = t0 JOIN pw b ON b.ring_id = iv.ring_id AND b.t = t1),
sy AS (SELECT a.ring_id, greatest(0, 1 - avg(abs(a.r - b.r)) / greatest(avg(a.r), 1e-9)) AS symmetry FROM sg a JOIN sg b ON a.ring_id = b.ring_id AND b.k = (a.k + 72) % 144 GROUP BY 1)
SELECT ring_id, round(abs(area), 6) AS area, round(perimeter, 6) AS perimeter, round(least(1, 4 * pi() * abs(area) / pow(perimeter, 2)), 6) AS circularity, round(abs(area) / around, 6) AS solidity,
  round((max_x - min_x) / greatest(max_y - min_y, 1e-9), 6) AS aspect, round(symmetry, 6) AS symmetry, CAST(corners AS INTEGER) AS corners, CAST(extrema AS INTEGER) AS extrema FROM ms JOIN ha USING (ring_id) JOIN pk USING (ring_id) JOIN sy USING (ring_id)""",
}

"""Queries on rings made from events and on radial signatures made from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.operators import guard, rings
from rastrel.sources.procedural import RINGS_SQL, SIGNATURES_SQL, signatures
from rastrel.sources.procedural import rings as event_rings


def _round(df: DataFrame, *exact: str) -> DataFrame:
    return df.select(*[c if c in exact else F.round(c, 6).alias(c) for c in df.columns])


def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.measures(event_rings(spark, sf_dir)).select("ring_id", "n", "area"), "ring_id", "n")


def polygon_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.measures(event_rings(spark, sf_dir)).select("ring_id", "perimeter"), "ring_id")


def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.measures(event_rings(spark, sf_dir)).select("ring_id", "min_x", "min_y", "max_x", "max_y"), "ring_id")


def polygon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.measures(event_rings(spark, sf_dir)).select("ring_id", "cx", "cy"), "ring_id")


def circularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.measures(event_rings(spark, sf_dir)).select("ring_id", "circularity"), "ring_id")


def corner_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.angles(event_rings(spark, sf_dir)).select("ring_id", "i", "angle"), "ring_id", "i")


def hard_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.hard_corners(event_rings(spark, sf_dir)).groupBy("ring_id").agg(F.count("*").alias("corners"), F.sum("i").alias("sum_i"))


def corner_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.corner_classes(event_rings(spark, sf_dir)).select("ring_id", "i", "kind")


def curvature_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.curvature_variance(event_rings(spark, sf_dir)), "ring_id")


def collinear_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.drop_collinear(event_rings(spark, sf_dir), 2.0).groupBy("ring_id").agg(F.count("*").alias("kept"), F.sum("i").alias("sum_i"))


def pca_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.frames(event_rings(spark, sf_dir)), "ring_id")


def fit_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.fit_ellipse(event_rings(spark, sf_dir)), "ring_id")


def fit_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.fit_rectangle(event_rings(spark, sf_dir)), "ring_id")


def fit_rounded_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.fit_rounded_rectangle(event_rings(spark, sf_dir)), "ring_id")


def fit_circle_lsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.fit_circle_lsq(event_rings(spark, sf_dir)), "ring_id")


def narrow_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.narrow_gaps(event_rings(spark, sf_dir), 6.0).groupBy("ring_id").agg(F.count("*").alias("protected"), F.sum("i").alias("sum_i"))


def gap_island_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.spans(rings.angles(event_rings(spark, sf_dir)), F.col("angle") <= 120.0)
    return found.groupBy("ring_id", "span").agg(F.count("*").alias("points"))


def circular_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.smooth_box(signatures(spark, sf_dir), "shape_id", "r").select("shape_id", "k", F.round("smooth", 6).alias("smooth"))


def radial_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.radial_symmetry(signatures(spark, sf_dir)), "shape_id")


def star_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rings.star_signature(signatures(spark, sf_dir)), "shape_id", "arms")


def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ring's box against that of the next ring."""
    boxes = rings.measures(event_rings(spark, sf_dir)).select("ring_id", "min_x", "min_y", "max_x", "max_y")
    other = boxes.select((F.col("ring_id") - 1).alias("ring_id"), *[F.col(c).alias("o_" + c) for c in boxes.columns[1:]])
    side = lambda p: tuple(F.col(p + c) for c in ("min_x", "min_y", "max_x", "max_y"))
    return boxes.join(other, "ring_id").select("ring_id", F.round(guard.box_iou(side(""), side("o_")), 6).alias("iou"))


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether points on a cross lie in each ring."""
    points = event_rings(spark, sf_dir)
    probes = points.select("ring_id").distinct().select("ring_id", F.explode(F.sequence(F.lit(-30), F.lit(30))).alias("k"))
    probes = probes.select("ring_id", "k", (F.col("k") * 2.0 + 0.25).alias("qx"), (F.col("k") * 0.5 - 0.125).alias("qy"))
    return guard.points_inside(probes, points).groupBy("ring_id").agg(F.sum(F.col("inside").cast("int")).alias("inside"))


def self_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with every second point mirrored, so that some cross themselves."""
    points = event_rings(spark, sf_dir)
    folded = points.withColumn("y", F.when((F.col("i") % 9 == 4) & (F.col("ring_id") % 2 == 0), -F.col("y")).otherwise(F.col("y")))
    return guard.crossings(folded)


QUERIES = {
    f.__name__: f
    for f in (
        polygon_area, polygon_perimeter, bounding_box, polygon_centroid, circularity, corner_angles, hard_corners, corner_classes, curvature_variance,
        collinear_drop, pca_frame, fit_ellipse, fit_rectangle, fit_rounded_rectangle, fit_circle_lsq, narrow_gap, gap_island_spans, circular_smooth,
        radial_symmetry, star_signature, bbox_iou, point_in_polygon, self_intersections,
    )
}

_NEAR = f"""{RINGS_SQL}, nb AS (SELECT *, x * ny - nx * y AS cr, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS el FROM (
  SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER v) AS px, coalesce(lag(y) OVER w, last_value(y) OVER v) AS py,
    coalesce(lead(x) OVER w, first_value(x) OVER v) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER v) AS ny
  FROM ring WINDOW w AS (PARTITION BY ring_id ORDER BY i), v AS (PARTITION BY ring_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""
_MEASURES = f"""{_NEAR}, ms AS (SELECT ring_id, count(*) AS n, sum(cr) / 2 AS area, sum(el) AS perimeter, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y,
  CASE WHEN abs(sum(cr) / 2) < 1e-9 THEN avg(x) ELSE sum((x + nx) * cr) / (3 * sum(cr)) END AS cx, CASE WHEN abs(sum(cr) / 2) < 1e-9 THEN avg(y) ELSE sum((y + ny) * cr) / (3 * sum(cr)) END AS cy FROM nb GROUP BY 1)"""
_ANGLES = f"""{_NEAR}, an AS (SELECT *, CASE WHEN ea < 1e-9 OR eb < 1e-9 THEN 180 ELSE degrees(acos(greatest(-1, least(1, ((px - x) * (nx - x) + (py - y) * (ny - y)) / (ea * eb))))) END AS angle
  FROM (SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS ea, el AS eb FROM nb))"""
_FRAME = f"""{_MEASURES}, fs AS (SELECT ring_id, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) AS angle FROM ring GROUP BY 1),
fu AS (SELECT ring_id, mx, my, angle, (x - mx) * cos(angle) + (y - my) * sin(angle) AS u, (y - my) * cos(angle) - (x - mx) * sin(angle) AS v FROM ring JOIN fs USING (ring_id)),
fb AS (SELECT ring_id, mx, my, angle, (min(u) + max(u)) / 2 AS mu, (min(v) + max(v)) / 2 AS mv, (max(u) - min(u)) / 2 AS half_u, (max(v) - min(v)) / 2 AS half_v FROM fu GROUP BY ALL),
fr AS (SELECT ring_id, mx, my, angle, mx + mu * cos(angle) - mv * sin(angle) AS cx, my + mu * sin(angle) + mv * cos(angle) AS cy, half_u, half_v FROM fb),
lo AS (SELECT fr.*, abs(area) AS ar, (x - fr.cx) * cos(angle) + (y - fr.cy) * sin(angle) AS u, (y - fr.cy) * cos(angle) - (x - fr.cx) * sin(angle) AS v FROM ring JOIN fr USING (ring_id) JOIN ms USING (ring_id))"""


def _dn(v: str, a: float, b: float) -> str:
    return f"(1 - least(1.0, greatest(0.0, (({v}) - {a}) / ({b} - {a}))))"


def _measure(columns: str) -> str:
    return f"WITH {_MEASURES} SELECT ring_id, {columns} FROM ms"


_BOX = "sqrt(pow(greatest(abs(u) - hu, 0), 2) + pow(greatest(abs(v) - hv, 0), 2)) + least(greatest(abs(u) - hu, abs(v) - hv), 0)"
SQL = {
    "polygon_area": _measure("n, round(area, 6) AS area"),
    "polygon_perimeter": _measure("round(perimeter, 6) AS perimeter"),
    "bounding_box": _measure("round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y"),
    "polygon_centroid": _measure("round(cx, 6) AS cx, round(cy, 6) AS cy"),
    "circularity": _measure("round(CASE WHEN perimeter > 1e-9 THEN least(1.0, 4 * pi() * abs(area) / (perimeter * perimeter)) ELSE 0 END, 6) AS circularity"),
    "corner_angles": f"WITH {_ANGLES} SELECT ring_id, i, round(angle, 6) AS angle FROM an",
    "hard_corners": f"WITH {_ANGLES} SELECT ring_id, count(*) AS corners, CAST(sum(i) AS BIGINT) AS sum_i FROM an WHERE 180 - angle >= 60 GROUP BY 1",
    "corner_classes": f"""WITH {_ANGLES}, sh AS (SELECT *, least(ea, eb) AS s, greatest(ea, eb) AS l, radians(angle) / 2 AS h FROM an WHERE angle <= 144),
ra AS (SELECT *, least(3.25, s * 0.11, 0.9 * 0.24 * s * tan(h)) AS r FROM sh)
SELECT ring_id, i, CASE WHEN angle <= 92 THEN 'sharp' WHEN angle <= 124 THEN CASE WHEN NOT coalesce(s / nullif(l, 0) >= 0.58, FALSE) THEN 'sharp'
  WHEN s > 1 AND r > 0.2 AND r / tan(h) > 0.2 AND 2 * r / tan(h) * sin(h) > 0.5 THEN 'fillet' WHEN angle <= 102 THEN 'sharp' ELSE 'smooth' END ELSE 'smooth' END AS kind FROM ra""",
    "curvature_variance": f"WITH {_ANGLES} SELECT ring_id, round(CASE WHEN count(*) < 5 THEN 'inf'::DOUBLE ELSE var_pop(radians(180 - angle)) END, 6) AS variance FROM an GROUP BY 1",
    "collinear_drop": f"""WITH {_NEAR}, tt AS (SELECT *, (nx - px) * (nx - px) + (ny - py) * (ny - py) AS sq FROM nb),
pr AS (SELECT *, greatest(0, least(1, ((x - px) * (nx - px) + (y - py) * (ny - py)) / nullif(sq, 0))) AS t FROM tt),
ds AS (SELECT ring_id, i, CASE WHEN sq < 1e-12 THEN sqrt(pow(x - px, 2) + pow(y - py, 2)) ELSE sqrt(pow(x - px - t * (nx - px), 2) + pow(y - py - t * (ny - py), 2)) END > 2 AS keep FROM pr),
ct AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY ring_id) AS c FROM ds)
SELECT ring_id, count(*) AS kept, CAST(sum(i) AS BIGINT) AS sum_i FROM ct WHERE keep OR c < 3 GROUP BY 1""",
    "pca_frame": f"WITH {_FRAME} SELECT ring_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('mx', 'my', 'angle', 'cx', 'cy', 'half_u', 'half_v'))} FROM fr",
    "fit_ellipse": f"""WITH {_FRAME}, er AS (SELECT ring_id, cx, cy, half_u, half_v, angle, ar, avg(abs(pow(u / half_u, 2) + pow(v / half_v, 2) - 1)) AS e, max(abs(pow(u / half_u, 2) + pow(v / half_v, 2) - 1)) AS m, count(*) AS n FROM lo GROUP BY ALL)
SELECT ring_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(half_u, 6) AS rx, round(half_v, 6) AS ry, round(angle, 6) AS angle, round(e, 6) AS mean_error, round(m, 6) AS max_error,
  round(({_dn('e', 0, 0.14)} + {_dn('m', 0, 0.22)} + {_dn('abs(1 - ar / (pi() * half_u * half_v))', 0, 0.18)}) / 3, 6) AS confidence FROM er WHERE n >= 8""",
    "fit_rectangle": f"""WITH {_FRAME}, bx AS (SELECT *, abs({_BOX}) / greatest(1, least(hu, hv)) AS d FROM (SELECT *, half_u AS hu, half_v AS hv FROM lo)),
er AS (SELECT ring_id, cx, cy, half_u, half_v, angle, ar, avg(d) AS e, max(d) AS m FROM bx GROUP BY ALL)
SELECT ring_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(2 * half_u, 6) AS width, round(2 * half_v, 6) AS height, round(angle, 6) AS angle, round(e, 6) AS mean_error, round(m, 6) AS max_error,
  round(({_dn('e', 0, 0.06)} + {_dn('m', 0, 0.12)} + {_dn('abs(1 - ar / (4 * half_u * half_v))', 0, 0.14)}) / 3, 6) AS confidence FROM er""",
    "fit_rounded_rectangle": f"""WITH {_FRAME}, tr AS (SELECT lo.*, (0.1 + 0.9 * k / 15) * 0.48 * least(half_u, half_v) AS radius FROM lo, range(16) s(k)),
bx AS (SELECT *, abs({_BOX} - radius) / greatest(1, least(half_u, half_v)) AS d FROM (SELECT *, half_u - radius AS hu, half_v - radius AS hv FROM tr)),
er AS (SELECT ring_id, cx, cy, half_u, half_v, angle, ar, radius, avg(d) AS e, max(d) AS m FROM bx GROUP BY ALL),
be AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY ring_id ORDER BY round(e, 9), radius) = 1)
SELECT ring_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(2 * half_u, 6) AS width, round(2 * half_v, 6) AS height, round(angle, 6) AS angle, round(radius, 6) AS radius, round(e, 6) AS mean_error, round(m, 6) AS max_error,
  round(({_dn('e', 0, 0.07)} + {_dn('m', 0, 0.14)} + {_dn('abs(1 - ar / (4 * half_u * half_v - (4 - pi()) * radius * radius))', 0, 0.18)} + 1 - {_dn('radius / least(half_u, half_v)', 0.12, 0.38)}) / 4, 6) AS confidence FROM be""",
    "fit_circle_lsq": f"""WITH {RINGS_SQL}, md AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM ring WINDOW w AS (PARTITION BY ring_id)),
sm AS (SELECT ring_id, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, (sum(u * u * u) + sum(u * v * v)) / 2 AS p, (sum(v * v * v) + sum(v * u * u)) / 2 AS q FROM md GROUP BY 1),
so AS (SELECT *, (p * vv - q * uv) / (uu * vv - uv * uv) AS a, (q * uu - p * uv) / (uu * vv - uv * uv) AS b FROM sm)
SELECT ring_id, round(mx + a, 6) AS cx, round(my + b, 6) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 6) AS r FROM so""",
    "narrow_gap": f"""WITH {RINGS_SQL}, pr AS (SELECT DISTINCT a.ring_id, a.i, a.n FROM ring a JOIN ring b ON a.ring_id = b.ring_id
  AND least(abs(a.i - b.i), a.n - abs(a.i - b.i)) >= 3 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 6),
sp AS (SELECT DISTINCT ring_id, (i + d + n) % n AS i FROM pr, range(-2, 3) t(d))
SELECT ring_id, count(*) AS protected, CAST(sum(i) AS BIGINT) AS sum_i FROM sp GROUP BY 1""",
    "gap_island_spans": f"""WITH {_ANGLES}, rn AS (SELECT ring_id, i, sum(CAST(angle <= 120 AS INT)) OVER (PARTITION BY ring_id ORDER BY i) AS run, sum(CAST(angle <= 120 AS INT)) OVER (PARTITION BY ring_id) AS total FROM an)
SELECT ring_id, CAST(CASE WHEN run = 0 THEN total ELSE run END AS BIGINT) AS span, count(*) AS points FROM rn GROUP BY ALL""",
    "circular_smooth": f"WITH {SIGNATURES_SQL} SELECT a.shape_id, a.k, round(avg(b.r), 6) AS smooth FROM sig a JOIN sig b ON a.shape_id = b.shape_id AND (b.k - a.k + a.n + 2) % a.n <= 4 GROUP BY ALL",
    "radial_symmetry": f"""WITH {SIGNATURES_SQL} SELECT a.shape_id, round(greatest(0, 1 - avg(abs(a.r - b.r)) / avg(a.r)), 6) AS symmetry
FROM sig a JOIN sig b ON a.shape_id = b.shape_id AND b.k = (a.k + a.n // 2) % a.n GROUP BY 1""",
    "star_signature": f"""WITH {SIGNATURES_SQL}, se AS (SELECT shape_id, CAST(arms AS INTEGER) AS arms, CAST(floor(k * 2 * arms / n) AS INTEGER) AS sector, avg(r) AS m FROM sig, range(3, 9) t(arms) GROUP BY ALL),
sc AS (SELECT shape_id, arms, avg(m) FILTER (sector % 2 = 0) AS a, avg(m) FILTER (sector % 2 = 1) AS b FROM se GROUP BY ALL)
SELECT shape_id, arms, round(round(abs(a - b) / nullif(a + b, 0), 9), 6) AS contrast FROM sc QUALIFY row_number() OVER (PARTITION BY shape_id ORDER BY round(abs(a - b) / nullif(a + b, 0), 9) DESC, arms) = 1""",
    "bbox_iou": f"""WITH {_MEASURES}, pr AS (SELECT a.ring_id, greatest(0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * greatest(0, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) AS i,
  (a.max_x - a.min_x) * (a.max_y - a.min_y) + (b.max_x - b.min_x) * (b.max_y - b.min_y) AS t FROM ms a JOIN ms b ON b.ring_id = a.ring_id + 1)
SELECT ring_id, round(CASE WHEN t - i <= 1e-9 THEN 1 ELSE i / (t - i) END, 6) AS iou FROM pr""",
    "point_in_polygon": f"""WITH {_NEAR}, pb AS (SELECT ring_id, k, k * 2.0 + 0.25 AS qx, k * 0.5 - 0.125 AS qy FROM (SELECT DISTINCT ring_id FROM ring), range(-30, 31) t(k)),
cr AS (SELECT pb.ring_id, k, count(*) FILTER ((y > qy) <> (ny > qy) AND qx < (nx - x) * (qy - y) / (ny - y) + x) % 2 AS o FROM pb JOIN nb USING (ring_id) GROUP BY ALL)
SELECT ring_id, CAST(sum(o) AS BIGINT) AS inside FROM cr GROUP BY 1""",
    "self_intersections": f"""WITH {RINGS_SQL}, fo AS (SELECT ring_id, i, n, x, CASE WHEN i % 9 = 4 AND ring_id % 2 = 0 THEN -y ELSE y END AS y FROM ring),
eg AS (SELECT a.ring_id, a.i, a.n, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM fo a JOIN fo b ON a.ring_id = b.ring_id AND b.i = (a.i + 1) % a.n),
pr AS (SELECT e.ring_id, ((e.bx - e.ax) * (f.ay - e.ay) - (e.by_ - e.ay) * (f.ax - e.ax)) AS o1, ((e.bx - e.ax) * (f.by_ - e.ay) - (e.by_ - e.ay) * (f.bx - e.ax)) AS o2,
  ((f.bx - f.ax) * (e.ay - f.ay) - (f.by_ - f.ay) * (e.ax - f.ax)) AS o3, ((f.bx - f.ax) * (e.by_ - f.ay) - (f.by_ - f.ay) * (e.bx - f.ax)) AS o4
  FROM eg e JOIN eg f ON e.ring_id = f.ring_id AND f.i > e.i + 1 AND NOT (e.i = 0 AND f.i = e.n - 1))
SELECT ring_id, count(*) AS crossings FROM pr WHERE o1 * o2 < 0 AND o3 * o4 < 0 GROUP BY 1""",
}

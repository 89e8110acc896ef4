"""Queries of clean-up and of chains: smoothing, anchors, shadow-like contours, parameters, resampling, least-squares curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.operators import fits, rings, spans
from rastrel.plans.ring_queries import _ANGLES, _MEASURES, _NEAR
from rastrel.sources.procedural import RINGS_SQL
from rastrel.sources.procedural import rings as event_rings

#: Rings are drawn this much wider, so that some look like shadows; and this much higher for pins.
WIDE, HIGH = 1.8, 1.4


def _wide(spark: SparkSession, sf_dir: str, x: float = WIDE, y: float = 1.0) -> DataFrame:
    return event_rings(spark, sf_dir).withColumn("x", F.col("x") * x).withColumn("y", F.col("y") * y)


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.arrays(event_rings(spark, sf_dir))


def _points(rows: DataFrame, column) -> DataFrame:
    got = rows.select("ring_id", F.explode(column).alias("p"))
    return got.select("ring_id", F.col("p.i").alias("i"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def gaussian_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_arrays(spark, sf_dir), spans.gaussian_closed(F.col("points"), 1.15))


def gaussian_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_arrays(spark, sf_dir), spans.gaussian_open(F.col("points"), 1.0))


def presmoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadow-like rings drawn to their Gaussian means, hard corners kept; the others as they are."""
    points = _wide(spark, sf_dir)
    m = rings.measures(points)
    shadow = spans.looks_like(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.abs("area"), spans.SHADOW_CLEAN)
    p = F.col("points")
    rows = spans.arrays(points).join(m.select("ring_id", shadow.alias("shadow")), "ring_id").withColumn("fixed", spans.hard_places(p))
    moved = spans.blend(p, spans.gaussian_closed(p, 1.15), 0.4, F.col("fixed"))
    return _points(rows, F.when(F.col("shadow") & (F.size("points") >= 8), moved).otherwise(p))


def lower_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrays(spark, sf_dir).withColumn("fixed", spans.hard_places(F.col("points")))
    return _points(rows, spans.steady_lower_mass(F.col("points"), F.col("fixed")))


def smooth_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrays(spark, sf_dir).withColumn("fixed", spans.hard_places(F.col("points")))
    return _points(rows, spans.smooth_pass(F.col("points"), F.col("fixed"), 0.42))


def curve_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.angles(event_rings(spark, sf_dir)).select("ring_id", "i", F.round(spans.curve_factor(F.col("angle")), 6).alias("factor"))


def expanded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrays(spark, sf_dir).withColumn("fixed", spans.hard_places(F.col("points")))
    return rows.select("ring_id", F.explode(spans.expanded(F.col("fixed"), F.size("points"), 2)).alias("i"))


def extrema_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark, sf_dir).select("ring_id", spans.extrema(F.col("points")).alias("e")).select("ring_id", "e.*")


def bridge_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark, sf_dir).select("ring_id", spans.bridge(F.col("points")).alias("e")).select("ring_id", "e.*")


def fit_bridge_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge as fitting sees it: a deeper notch, and no lowest point."""
    return _arrays(spark, sf_dir).select("ring_id", spans.bridge(F.col("points"), 0.78).alias("e")).select("ring_id", "e.left", "e.right", "e.notch")


def body_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark, sf_dir).select("ring_id", spans.body_anchors(F.col("points")).alias("e")).select("ring_id", "e.*")


def contour_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which wide rings look like shadows, to clean-up and to fitting, and which high ones like pins; limits of clean-up."""
    size = lambda m: (F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.abs("area"))
    m = rings.measures(_wide(spark, sf_dir))
    clean, fit = (spans.looks_like(*size(m), limits) for limits in (spans.SHADOW_CLEAN, spans.SHADOW_FIT))
    wanted = (F.col("ring_id") % 10) / 8.0
    rows = m.select("ring_id", clean.alias("shadow_clean"), fit.alias("shadow_fit"), F.round(spans.simplify_tolerance(wanted, clean), 6).alias("tolerance"), F.round(spans.smoothing_strength(wanted, clean), 6).alias("strength"))
    pin = rings.measures(_wide(spark, sf_dir, 1.0, HIGH)).select("ring_id", spans.looks_like(*size(m), spans.PIN, True).alias("pin"))
    return rows.join(pin, "ring_id")


def closed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from the last quarter to the first one, around the end."""
    n = F.size("points")
    part = spans.slice_closed(F.col("points"), (n * 3 / 4).cast("int"), (n / 4).cast("int"))
    got = _arrays(spark, sf_dir).select("ring_id", F.posexplode(part).alias("k", "p"))
    return got.select("ring_id", "k", F.col("p.i").alias("i"))


def _first_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open chain: the first half of each ring."""
    return _arrays(spark, sf_dir).select("ring_id", F.slice("points", 1, (F.size("points") / 2).cast("int") + 1).alias("points"))


def chain_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("points")
    rows = _arrays(spark, sf_dir).select("ring_id", F.size("points").alias("n"), spans.chain_length(p, False).alias("open"), spans.chain_length(p, True).alias("closed"))
    made = (F.col("ring_id") % 5).cast("int")
    return rows.select(
        "ring_id", F.round("open", 6).alias("open"), F.round("closed", 6).alias("closed"), spans.too_coarse(F.col("n"), made, F.col("closed"), True).alias("coarse_closed"), spans.too_coarse(F.col("n"), made, F.col("open"), False).alias("coarse_open")
    )


def chain_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chord-length and centripetal parameters of each ring's first half."""
    p = F.col("points")
    both = F.zip_with(spans.parameters(p), spans.parameters(p, 0.5), lambda t, u: F.struct(t.alias("t"), u.alias("u")))
    got = _first_half(spark, sf_dir).select("ring_id", F.posexplode(both).alias("k", "v"))
    return got.select("ring_id", "k", F.round("v.t", 6).alias("t"), F.round("v.u", 6).alias("u"))


def parameter_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("points")
    return _first_half(spark, sf_dir).select("ring_id", F.round(spans.parameter_shift(spans.parameters(p), spans.parameters(p, 0.5)), 6).alias("shift"))


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_first_half(spark, sf_dir), spans.resample(F.col("points"), 16))


def chord_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the first half's points lie from its chord, and where farthest."""
    d = spans.chord_deviations(F.col("points"))
    rows = _first_half(spark, sf_dir).select("ring_id", d.alias("d"))
    best = F.array_max(F.transform("d", lambda v, k: F.struct(F.round(v, 9).alias("v"), (-k).alias("k"))))
    return rows.select("ring_id", F.round(F.array_max("d"), 6).alias("worst"), F.round(F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / F.size("d"), 6).alias("mean"), (-best["k"]).alias("split"))


def mirrored_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half with its mirror image at the mean of its ends, by place."""
    p = F.col("points")
    axis = (F.get(p, F.lit(0))["x"] + F.get(p, F.size(p) - 1)["x"]) / 2
    got = _first_half(spark, sf_dir).select("ring_id", F.posexplode(spans.mirrored(p, axis)).alias("k", "p"))
    return got.select("ring_id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def symmetric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each ring resampled, and the first drawn towards the mirror image of the second."""
    half = (F.size("points") / 2).cast("int")
    rows = _arrays(spark, sf_dir).select("ring_id", F.slice("points", 1, half + 1).alias("a"), F.reverse(spans.slice_closed(F.col("points"), half, F.lit(0))).alias("b"))
    a, b = spans.resample(F.col("a"), 12), spans.resample(F.col("b"), 12)
    return _points(rows, spans.symmetric_profile(a, b, F.lit(0.0), 0.5))


def quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least-squares quadratic through the first sixth of each ring, with its largest error."""
    return _rounded(fits.quadratic(_sixth(spark, sf_dir)), "worst")


def cubic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least-squares cubic through the first sixth of each ring, with its largest error."""
    return _rounded(fits.cubic(_sixth(spark, sf_dir)), "worst")


def _rounded(df: DataFrame, place: str) -> DataFrame:
    return df.select(*[c if c in ("ring_id", place) else F.round(c, 6).alias(c) for c in df.columns])


def _sixth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.slice("points", 1, (F.size("points") / 6).cast("int") + 2)
    rows = _arrays(spark, sf_dir).select("ring_id", p.alias("points"))
    both = F.zip_with("points", spans.parameters(F.col("points")), lambda p, t: F.struct(p["x"].alias("x"), p["y"].alias("y"), t.alias("t")))
    return rows.select("ring_id", F.posexplode(both).alias("k", "v")).select("ring_id", "k", "v.*")


def arc_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circular arc through the first half of each ring."""
    return _rounded(fits.circular_arc(_half_points(spark, sf_dir)), "")


def _half_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rings(spark, sf_dir).where(F.col("i") <= F.floor(F.col("n") / 2))


def anchor_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard corners with the places to the next one, around the ring."""
    found = rings.hard_corners(event_rings(spark, sf_dir)).select("ring_id", "i", "n")
    return fits.anchor_distances(found)


QUERIES = {
    f.__name__: f
    for f in (
        gaussian_closed, gaussian_open, presmoothed, lower_mass, smooth_pass, curve_factor, expanded_places, extrema_anchors, bridge_anchors, fit_bridge_anchors, body_anchors, contour_looks,
        closed_slices, chain_lengths, chain_parameters, parameter_shift, resampled, chord_deviation, mirrored_span, symmetric_profile, quadratic_fit, cubic_fit, arc_fits, anchor_distances,
    )
}


def _weights(sigma: float) -> str:
    return ", ".join(f"({d}, {w!r})" for d, w in spans.gaussian_weights(sigma).items())


def _gauss(source: str, sigma: float, name: str = "gs") -> str:
    """A CTE of Gaussian means (gx, gy) around the rings of source."""
    return f"""{name} AS (SELECT a.ring_id, a.i, sum(w * b.x) AS gx, sum(w * b.y) AS gy FROM {source} a, (VALUES {_weights(sigma)}) k(d, w), {source} b
  WHERE b.ring_id = a.ring_id AND b.i = (a.i + d + 8 * a.n) % a.n GROUP BY ALL)"""


_FIXED = "fx AS (SELECT ring_id, i, n, 180 - angle >= 60 AS fixed FROM an)"
_BOUNDS = """bd AS (SELECT ring_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS ax, avg(y) AS ay FROM ring GROUP BY 1),
rb AS (SELECT ring.*, x0, x1, y0, y1, ax, ay, (x0 + x1) / 2 AS mx, x1 - x0 AS w, y1 - y0 AS h FROM ring JOIN bd USING (ring_id))"""
_PLACES = "CAST({} AS INTEGER) AS {}"


def _arg(first: str, second: str, name: str, where: str = "TRUE") -> str:
    return f"arg_min(i, ({first}, {second}, i)) FILTER ({where}) AS \"{name}\""


def _bridge(notch: float) -> str:
    return ", ".join((
        _arg("-x", "0.0", "left", "x < mx AND y <= y0 + 0.18 * h"), _arg("x", "0.0", "right", "x > mx AND y <= y0 + 0.18 * h"), _arg("-y", "abs(x - mx)", "notch", f"abs(x - mx) <= 0.18 * w AND y <= y0 + {notch} * h"),
    ))


def _look(area: str, a: str, b: str, limits: tuple[float, float, float]) -> str:
    return f"{a} / {b} >= {limits[0]} AND {area} / greatest(1e-6, {a} * {b}) BETWEEN {limits[1]} AND {limits[2]}"


_HALF = f"""{_NEAR}, hf AS (SELECT ring_id, i AS k, x, y, nx, ny, el, CAST(n // 2 AS INTEGER) AS last FROM nb WHERE i <= n // 2)"""


def _params(source: str, power: float, name: str, out: str) -> str:
    return f"""{name} AS (SELECT ring_id, k, coalesce(sum(l) OVER (PARTITION BY ring_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(l) OVER (PARTITION BY ring_id) AS {out}
  FROM (SELECT ring_id, k, CASE WHEN k < last THEN pow(el, {power}) ELSE 0 END AS l FROM {source}))"""


def _sampled(source: str, t: str, count: int, name: str) -> str:
    """A CTE of count points at even parameters of a chain (ring_id, k, x, y, last) with parameters t (ring_id, k, t)."""
    return f"""{name} AS (SELECT c.ring_id, CAST(j AS INTEGER) AS i, c.x + CASE WHEN v.t - u.t > 1e-12 THEN (j / {count - 1} - u.t) / (v.t - u.t) ELSE 0 END * (d.x - c.x) AS x,
    c.y + CASE WHEN v.t - u.t > 1e-12 THEN (j / {count - 1} - u.t) / (v.t - u.t) ELSE 0 END * (d.y - c.y) AS y
  FROM (SELECT p.ring_id, j, least(max(k) FILTER (p.t <= j / {count - 1}), max(k) - 1) AS k FROM {t} p, range({count}) g(j) GROUP BY ALL) s
  JOIN {source} c ON c.ring_id = s.ring_id AND c.k = s.k JOIN {source} d ON d.ring_id = s.ring_id AND d.k = s.k + 1
  JOIN {t} u ON u.ring_id = s.ring_id AND u.k = s.k JOIN {t} v ON v.ring_id = s.ring_id AND v.k = s.k + 1)"""


_SIXTH = f"""{_NEAR}, hf AS (SELECT ring_id, i AS k, x, y, el, CAST(n // 6 + 1 AS INTEGER) AS last FROM nb WHERE i <= n // 6 + 1), {_params('hf', 1, 'pa', 't')},
sx AS (SELECT hf.ring_id, k, x, y, t, first_value(x) OVER w AS ax, first_value(y) OVER w AS ay, last_value(x) OVER w AS bx, last_value(y) OVER w AS "by" FROM hf JOIN pa USING (ring_id, k)
  WINDOW w AS (PARTITION BY hf.ring_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_XY = "round(x, 6) AS x, round(y, 6) AS y"
SQL = {
    "gaussian_closed": f"WITH {RINGS_SQL}, {_gauss('ring', 1.15)} SELECT ring_id, i, round(gx, 6) AS x, round(gy, 6) AS y FROM gs",
    "gaussian_open": f"""WITH {RINGS_SQL}, gs AS (SELECT a.ring_id, a.i, a.n, a.x, a.y, sum(w * b.x) AS gx, sum(w * b.y) AS gy FROM ring a, (VALUES {_weights(1.0)}) k(d, w), ring b
  WHERE b.ring_id = a.ring_id AND b.i = greatest(0, least(a.n - 1, a.i + d)) GROUP BY ALL)
SELECT ring_id, i, round(CASE WHEN i IN (0, n - 1) THEN x ELSE gx END, 6) AS x, round(CASE WHEN i IN (0, n - 1) THEN y ELSE gy END, 6) AS y FROM gs""",
    "presmoothed": f"""WITH {_ANGLES.replace('ring AS (', 'ring0 AS (', 1).replace(', nb AS (', f', ring AS (SELECT ring_id, i, n, x * {WIDE} AS x, y FROM ring0), nb AS (', 1)}, {_FIXED}, {_gauss('ring', 1.15)},
lk AS (SELECT ring_id, {_look('abs(sum(cr) / 2)', '(max(x) - min(x))', '(max(y) - min(y))', spans.SHADOW_CLEAN)} AND count(*) >= 8 AS shadow FROM nb GROUP BY 1)
SELECT ring_id, i, round(CASE WHEN shadow AND NOT fixed THEN 0.6 * x + 0.4 * gx ELSE x END, 6) AS x, round(CASE WHEN shadow AND NOT fixed THEN 0.6 * y + 0.4 * gy ELSE y END, 6) AS y
FROM ring JOIN fx USING (ring_id, i) JOIN gs USING (ring_id, i) JOIN lk USING (ring_id)""",
    "lower_mass": f"""WITH {_ANGLES}, {_FIXED}, {_gauss('ring', 1.3)}, {_BOUNDS}
SELECT ring_id, i, round(CASE WHEN y > y0 + 0.34 * h AND NOT fixed THEN 0.38 * x + 0.62 * gx ELSE x END, 6) AS x, round(CASE WHEN y > y0 + 0.34 * h AND NOT fixed THEN 0.38 * y + 0.62 * gy ELSE y END, 6) AS y
FROM rb JOIN fx USING (ring_id, i) JOIN gs USING (ring_id, i)""",
    "smooth_pass": f"""WITH {_ANGLES}, {_FIXED}, ta AS (SELECT a.ring_id, a.i, sum(w * b.x) / 16 AS gx, sum(w * b.y) / 16 AS gy FROM ring a, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) k(d, w), ring b
  WHERE b.ring_id = a.ring_id AND b.i = (a.i + d + a.n) % a.n GROUP BY ALL),
be AS (SELECT DISTINCT ring_id, (i + d + n) % n AS i FROM fx, (VALUES (-1), (1)) k(d) WHERE fixed),
mv AS (SELECT an.ring_id, an.i, x, y, gx, gy, 0.42 * CASE WHEN fixed THEN 0 WHEN be.i IS NOT NULL THEN 0.65 ELSE 1 END * (0.2 + 0.8 * least(1.0, greatest(0.0, (angle - 105) / 65))) AS s
  FROM an JOIN fx USING (ring_id, i) JOIN ta USING (ring_id, i) LEFT JOIN be ON be.ring_id = an.ring_id AND be.i = an.i)
SELECT ring_id, i, round(x + s * (gx - x), 6) AS x, round(y + s * (gy - y), 6) AS y FROM mv""",
    "curve_factor": f"WITH {_ANGLES} SELECT ring_id, i, round(0.2 + 0.8 * least(1.0, greatest(0.0, (angle - 105) / 65)), 6) AS factor FROM an",
    "expanded_places": f"WITH {_ANGLES}, {_FIXED} SELECT DISTINCT ring_id, CAST((i + d + n) % n AS INTEGER) AS i FROM fx, (VALUES (-2), (-1), (0), (1), (2)) k(d) WHERE fixed",
    "extrema_anchors": f"WITH {RINGS_SQL}, {_BOUNDS} SELECT ring_id, {_arg('y', 'abs(x - ax)', 'top')}, {_arg('-y', 'abs(x - ax)', 'bottom')}, {_arg('x', 'abs(y - ay)', 'left')}, {_arg('-x', 'abs(y - ay)', 'right')} FROM rb GROUP BY 1",
    "bridge_anchors": f"WITH {RINGS_SQL}, {_BOUNDS} SELECT ring_id, {_bridge(0.75)}, {_arg('-y', '0.0', 'bottom')} FROM rb GROUP BY 1",
    "fit_bridge_anchors": f"WITH {RINGS_SQL}, {_BOUNDS} SELECT ring_id, {_bridge(0.78)} FROM rb GROUP BY 1",
    "body_anchors": f"""WITH {RINGS_SQL}, {_BOUNDS} SELECT ring_id, {_arg('1.6 * abs(y - y0 - 0.6 * h)', 'abs(x - x0 - 0.23 * w)', 'left', 'x <= mx')},
  {_arg('1.6 * abs(y - y0 - 0.6 * h)', 'abs(x - x1 + 0.23 * w)', 'right', 'x >= mx')} FROM rb GROUP BY 1""",
    "contour_looks": f"""WITH {_MEASURES}, lk AS (SELECT ring_id, (max_x - min_x) AS w, (max_y - min_y) AS h, abs(area) AS a, (ring_id % 10) / 8.0 AS v FROM ms),
sh AS (SELECT *, {_look(f'(a * {WIDE})', f'(w * {WIDE})', 'h', spans.SHADOW_CLEAN)} AS shadow_clean, {_look(f'(a * {WIDE})', f'(w * {WIDE})', 'h', spans.SHADOW_FIT)} AS shadow_fit, {_look(f'(a * {HIGH})', f'(h * {HIGH})', 'w', spans.PIN)} AS pin FROM lk)
SELECT ring_id, shadow_clean, shadow_fit, pin, CAST(round(CASE WHEN shadow_clean THEN least(0.85, greatest(0.45, 0.95 * least(0.8, greatest(0.2, v)))) ELSE least(0.8, greatest(0.2, v)) END, 6) AS DOUBLE) AS tolerance,
  CAST(round(CASE WHEN shadow_clean THEN least(0.26, greatest(0, least(0.85, v))) ELSE greatest(0, least(0.85, v)) END, 6) AS DOUBLE) AS strength FROM sh""",
    "closed_slices": f"""WITH {RINGS_SQL}, sz AS (SELECT DISTINCT ring_id, n, n * 3 // 4 AS a, n // 4 AS b FROM ring)
SELECT ring_id, CAST(k AS INTEGER) AS k, CAST((a + k) % n AS INTEGER) AS i FROM sz, range(100000) t(k) WHERE k <= (b - a + n) % n""",
    "chain_lengths": f"""WITH {_NEAR}, le AS (SELECT ring_id, count(*) AS n, sum(el) FILTER (i < n - 1) AS open, sum(el) AS closed, ring_id % 5 AS made FROM nb GROUP BY 1)
SELECT ring_id, round(open, 6) AS open, round(closed, 6) AS closed, n >= 8 AND made < 12 AND closed >= 120 AND made < greatest(3, least(12, round_even(closed / 120, 0))) AS coarse_closed,
  n >= 8 AND made < 12 AND open >= 120 AND made < greatest(2, least(12, round_even(open / 140, 0))) AS coarse_open FROM le""",
    "chain_parameters": f"WITH {_HALF}, {_params('hf', 1, 'pa', 't')}, {_params('hf', 0.5, 'pb', 'u')} SELECT ring_id, k, round(t, 6) AS t, round(u, 6) AS u FROM pa JOIN pb USING (ring_id, k)",
    "parameter_shift": f"WITH {_HALF}, {_params('hf', 1, 'pa', 't')}, {_params('hf', 0.5, 'pb', 'u')} SELECT ring_id, round(max(abs(t - u)), 6) AS shift FROM pa JOIN pb USING (ring_id, k) GROUP BY 1",
    "resampled": f"WITH {_HALF}, {_params('hf', 1, 'pa', 't')}, {_sampled('hf', 'pa', 16, 'rs')} SELECT ring_id, i, {_XY} FROM rs",
    "chord_deviation": f"""WITH {_HALF}, en AS (SELECT *, first_value(x) OVER w AS ax, first_value(y) OVER w AS ay, last_value(x) OVER w - first_value(x) OVER w AS dx, last_value(y) OVER w - first_value(y) OVER w AS dy FROM hf
  WINDOW w AS (PARTITION BY ring_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
tt AS (SELECT *, CASE WHEN dx * dx + dy * dy <= 1e-12 THEN 0 ELSE greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM en),
dv AS (SELECT ring_id, k, sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2)) AS d FROM tt)
SELECT ring_id, round(max(d), 6) AS worst, round(avg(d), 6) AS mean, arg_max(k, (round(d, 9), -k)) AS split FROM dv GROUP BY 1""",
    "mirrored_span": f"""WITH {_HALF}, ax AS (SELECT ring_id, any_value(last) AS last, (max(x) FILTER (k = 0) + max(x) FILTER (k = last)) / 2 AS a FROM hf GROUP BY 1),
ml AS (SELECT ring_id, k, x, y FROM hf UNION ALL SELECT ring_id, CAST(2 * ax.last - k AS INTEGER), 2 * a - x, y FROM hf JOIN ax USING (ring_id) WHERE k > 0 AND k < ax.last) SELECT ring_id, k, {_XY} FROM ml""",
    "symmetric_profile": f"""WITH {_HALF}, {_params('hf', 1, 'pa', 't')}, {_sampled('hf', 'pa', 12, 'ra')},
ot AS (SELECT ring_id, CAST((n - i) % n AS INTEGER) AS k, x, y, CAST(n - n // 2 AS INTEGER) AS last, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS el FROM nb WHERE i >= n // 2 OR i = 0), {_params('ot', 1, 'pb', 't')}, {_sampled('ot', 'pb', 12, 'rb')}
SELECT ra.ring_id, ra.i, round(0.5 * ra.x + 0.25 * (ra.x - rb.x), 6) AS x, round(0.5 * ra.y + 0.25 * (ra.y + rb.y), 6) AS y FROM ra JOIN rb USING (ring_id, i)""",
    "quadratic_fit": f"""WITH {_SIXTH}, wt AS (SELECT *, 2 * t * (1 - t) AS w FROM sx), so AS (SELECT ring_id, sum(w * (x - (1 - t) * (1 - t) * ax - t * t * bx)) / sum(w * w) AS cx, sum(w * (y - (1 - t) * (1 - t) * ay - t * t * "by")) / sum(w * w) AS cy FROM wt GROUP BY 1 HAVING sum(w * w) > 1e-12),
er AS (SELECT ring_id, k, cx, cy, sqrt(pow((1 - t) * (1 - t) * ax + w * cx + t * t * bx - x, 2) + pow((1 - t) * (1 - t) * ay + w * cy + t * t * "by" - y, 2)) AS e FROM wt JOIN so USING (ring_id))
SELECT ring_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(max(e), 6) AS error, arg_max(k, (round(e, 9), -k)) AS worst FROM er GROUP BY ALL""",
    "cubic_fit": f"""WITH {_SIXTH}, wt AS (SELECT *, 3 * t * (1 - t) * (1 - t) AS u, 3 * t * t * (1 - t) AS v, x - pow(1 - t, 3) * ax - pow(t, 3) * bx AS rx, y - pow(1 - t, 3) * ay - pow(t, 3) * "by" AS ry FROM sx),
sm AS (SELECT ring_id, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * rx) AS ux, sum(u * ry) AS uy, sum(v * rx) AS vx, sum(v * ry) AS vy FROM wt GROUP BY 1),
so AS (SELECT ring_id, (ux * vv - vx * uv) / (uu * vv - uv * uv) AS c1x, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS c1y, (vx * uu - ux * uv) / (uu * vv - uv * uv) AS c2x, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS c2y FROM sm WHERE abs(uu * vv - uv * uv) > 1e-12),
er AS (SELECT ring_id, k, c1x, c1y, c2x, c2y, sqrt(pow(u * c1x + v * c2x - rx, 2) + pow(u * c1y + v * c2y - ry, 2)) AS e FROM wt JOIN so USING (ring_id))
SELECT ring_id, round(c1x, 6) AS c1x, round(c1y, 6) AS c1y, round(c2x, 6) AS c2x, round(c2y, 6) AS c2y, round(max(e), 6) AS error, arg_max(k, (round(e, 9), -k)) AS worst FROM er GROUP BY ALL""",
    "arc_fits": f"""WITH {RINGS_SQL}, hf AS (SELECT * FROM ring WHERE i <= n // 2), md AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM hf WINDOW w AS (PARTITION BY ring_id)),
sm AS (SELECT ring_id, any_value(mx) AS mx, any_value(my) AS my, count(*) AS c, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, (sum(u * u * u) + sum(u * v * v)) / 2 AS p, (sum(v * v * v) + sum(v * u * u)) / 2 AS q FROM md GROUP BY 1),
so AS (SELECT ring_id, mx + (p * vv - q * uv) / (uu * vv - uv * uv) AS cx, my + (q * uu - p * uv) / (uu * vv - uv * uv) AS cy,
  sqrt(pow((p * vv - q * uv) / (uu * vv - uv * uv), 2) + pow((q * uu - p * uv) / (uu * vv - uv * uv), 2) + (uu + vv) / c) AS r FROM sm WHERE c >= 3 AND abs(uu * vv - uv * uv) > 1e-12),
an AS (SELECT ring_id, i, cx, cy, r, atan2(y - cy, x - cx) AS t, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM hf JOIN so USING (ring_id)),
st AS (SELECT *, t - lag(t) OVER (PARTITION BY ring_id ORDER BY i) AS s FROM an),
su AS (SELECT ring_id, cx, cy, r, arg_min(t, i) AS start, sum(s - 2 * pi() * round(s / (2 * pi()))) AS sweep, max(abs(d - r)) / greatest(1, r) AS worst, stddev_pop(d) / r AS spread FROM st GROUP BY ring_id, cx, cy, r)
SELECT ring_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(r, 6) AS r, round(start, 6) AS start, round(sweep, 6) AS sweep,
  round((1 - least(1, greatest(0, worst / 0.12)) + 1 - least(1, greatest(0, spread / 0.1)) + least(1, greatest(0, (abs(degrees(sweep)) - 18) / 152))) / 3, 6) AS confidence FROM su""",
    "anchor_distances": f"""WITH {_ANGLES}, hc AS (SELECT ring_id, i, n FROM an WHERE 180 - angle >= 60),
nx AS (SELECT ring_id, i, n, coalesce(lead(i) OVER (PARTITION BY ring_id ORDER BY i), min(i) OVER (PARTITION BY ring_id)) AS j FROM hc)
SELECT ring_id, i, CAST(least(abs(i - j), n - abs(i - j)) AS INTEGER) AS apart FROM nx""",
}

"""Queries of the topology guard and of the gates of fitted primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.operators import fits, guard, rings
from rastrel.plans import ring_queries
from rastrel.plans.ring_queries import _FRAME, _MEASURES, _NEAR, _dn
from rastrel.sources.procedural import RINGS_SQL
from rastrel.sources.procedural import rings as event_rings


def _pairs(*names: str) -> list[tuple]:
    return [(F.col(n + "x"), F.col(n + "y")) for n in names]


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with every ninth point of the even ones mirrored, so that some cross themselves."""
    return event_rings(spark, sf_dir).withColumn("y", F.when((F.col("i") % 9 == 4) & (F.col("ring_id") % 2 == 0), -F.col("y")).otherwise(F.col("y")))


def _moved(points: DataFrame, scale: float, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    return points.withColumn("x", F.col("x") * scale + dx).withColumn("y", F.col("y") * scale + dy)


def orientation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each ring's points turn: on one line, clockwise, counter-clockwise."""
    before, here, after = _pairs("p", "", "n")
    rows = rings.neighbours(event_rings(spark, sf_dir)).select("ring_id", guard.orientation(before, here, after).alias("way"))
    return rows.groupBy("ring_id", "way").agg(F.count("*").alias("points"))


def turn_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed turns at each point; around a ring they add up to whole turns."""
    c = F.col
    turn = guard.vector_angle((c("x") - c("px"), c("y") - c("py")), (c("nx") - c("x"), c("ny") - c("y")))
    rows = rings.neighbours(event_rings(spark, sf_dir)).select("ring_id", turn.alias("turn"))
    return rows.groupBy("ring_id").agg(F.round(F.sum("turn"), 6).alias("total"), F.round(F.max("turn"), 6).alias("sharpest"))


def edge_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of folded rings that cross, touch or overlap."""
    return guard.edge_meetings(_folded(spark, sf_dir)).groupBy("ring_id").agg(F.count("*").alias("pairs"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


def segment_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge against the two beyond the next, and whether they share an end or a point of one lies on the other."""
    c = F.col
    e = rings.neighbours(event_rings(spark, sf_dir)).select("ring_id", "i", "n", "x", "y", "nx", "ny")
    other = e.select("ring_id", c("i").alias("j"), c("x").alias("ox"), c("y").alias("oy"), c("nx").alias("qx"), c("ny").alias("qy"))
    rows = e.select("*", F.explode(F.array(*[F.pmod(c("i") + d, c("n")) for d in (1, 2, 3)])).alias("j")).join(other, ["ring_id", "j"])
    a, b, p, q = _pairs("", "n", "o", "q")
    got = rows.select("ring_id", guard.meet(a, b, p, q).alias("m"), guard.shares_end(a, b, p, q).alias("s"), guard.on_segment(a, b, p).alias("t"), guard.in_box(a, b, p).alias("x"))
    count = lambda n: F.sum(c(n).cast("int"))
    return got.groupBy("ring_id").agg(count("m").alias("meet"), count("s").alias("share"), count("t").alias("touch"), count("x").alias("boxed"))


def rings_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each ring's outline meets that of the next ring, moved aside by a distance that differs."""
    points = event_rings(spark, sf_dir)
    other = points.withColumn("ring_id", F.col("ring_id") - 1).withColumn("x", F.col("x") * 0.5 + F.pmod("ring_id", F.lit(7)) * 12.0)
    return guard.rings_meet(points, other)


def winding_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes on a cross, and a corner and the middle of an edge, which are inside as the boundary is."""
    c = F.col
    points = event_rings(spark, sf_dir)
    cross = points.select("ring_id").distinct().select("ring_id", F.explode(F.sequence(F.lit(-20), F.lit(20))).alias("k"))
    cross = cross.select("ring_id", "k", (c("k") * 3.0 + 0.25).alias("qx"), (c("k") * 0.5 - 0.125).alias("qy"))
    corner = points.where("i = 3").select("ring_id", F.lit(100).alias("k"), c("x").alias("qx"), c("y").alias("qy"))
    return guard.winding_inside(cross.unionByName(corner), points).groupBy("ring_id").agg(F.sum(c("inside").cast("int")).alias("inside"))


def shape_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with a smaller copy as a hole, both drawn a little smaller, by ring id too far off or out of the ring."""
    c = F.col
    outer = event_rings(spark, sf_dir)
    hole = _moved(outer, 0.3)
    fitted = outer.withColumn("s", F.when(c("ring_id") % 5 == 0, 0.9).otherwise(0.98)).withColumn("x", c("x") * c("s")).withColumn("y", c("y") * c("s")).drop("s")
    drawn = hole.withColumn("x", c("x") + F.when(c("ring_id") % 3 == 0, 3.0).otherwise(0.0)).where(c("ring_id") % 7 != 0)
    return guard.shape_topology(outer, hole, fitted, drawn)


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of ellipse, rectangle and rounded rectangle with the area, aspect and errors in cells, a row for each kind."""
    c = F.col
    points = event_rings(spark, sf_dir)
    m = rings.measures(points).select("ring_id", F.abs("area").alias("area"), ((c("max_x") - c("min_x")) / F.greatest(F.lit(1e-6), c("max_y") - c("min_y"))).alias("aspect"), "circularity")
    e = rings.fit_ellipse(points).select("ring_id", F.lit("ellipse").alias("kind"), c("rx").alias("a"), c("ry").alias("b"), F.lit(0.0).alias("radius"), "mean_error", "max_error", "confidence")
    r = rings.fit_rectangle(points).select("ring_id", F.lit("rectangle").alias("kind"), (c("width") / 2).alias("a"), (c("height") / 2).alias("b"), F.lit(0.0).alias("radius"), "mean_error", "max_error", "confidence")
    o = rings.fit_rounded_rectangle(points).select("ring_id", F.lit("rounded_rectangle").alias("kind"), (c("width") / 2).alias("a"), (c("height") / 2).alias("b"), "radius", "mean_error", "max_error", "confidence")
    rows = e.unionByName(r).unionByName(o).join(m, "ring_id")
    full = F.when(c("kind") == "ellipse", F.pi() * c("a") * c("b")).otherwise(4 * c("a") * c("b") - (4 - F.pi()) * c("radius") * c("radius"))
    cells = F.when(c("kind") == "ellipse", 1.0).otherwise(F.greatest(F.lit(1.0), F.least("a", "b")))
    return rows.withColumn("ratio", c("area") / full).withColumn("mean_error", c("mean_error") * cells).withColumn("max_error", c("max_error") * cells)


def primitive_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fits pass the second ladder's gates, loosened as far as these rings need."""
    c = F.col
    rows = _fits(spark, sf_dir)
    short = F.least("a", "b")
    ok = (
        F.when(c("kind") == "ellipse", fits.is_ellipse(c("mean_error"), c("max_error"), c("ratio"), c("confidence"), 0.7, 0.05))
        .when(c("kind") == "rectangle", fits.is_rectangle(c("mean_error"), c("max_error"), c("ratio"), c("confidence"), 12.0, 0.0))
        .otherwise(fits.is_rounded_rectangle(c("mean_error"), c("max_error"), c("ratio"), c("radius") / (2 * short), c("confidence"), 12.0, 0.0))
    )
    round_ = fits.is_circle(c("mean_error") / 10, c("max_error") / 10, c("ratio"), c("circularity"), c("aspect"), c("confidence") + 0.6, 0.2, 0.2, 0.7)
    return rows.select("ring_id", "kind", ok.alias("passes"), round_.alias("as_circle"))


def first_order_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits under the primitive-first order's gates, as outer contours and holes by turns, ranked by score."""
    from pyspark.sql import Window

    c = F.col
    hole = c("ring_id") % 4 == 0
    sure = F.least(F.lit(1.0), c("confidence") + 0.5)
    rows = _fits(spark, sf_dir).withColumn("sure", sure).withColumn("corner", c("radius") / F.least("a", "b"))
    kinds = ("ellipse", "rectangle", "rounded_rectangle")
    ok = score = F.lit(None)
    for k in kinds:
        ok = F.when(c("kind") == k, fits.accepts_first(k, c("sure"), c("ratio"), hole, c("aspect"), c("corner"))).otherwise(ok)
        score = F.when(c("kind") == k, fits.first_score(k, c("sure"), hole)).otherwise(score)
    circle = fits.accepts_first("circle", c("sure"), c("ratio"), hole, c("aspect"))
    got = rows.select("ring_id", "kind", ok.alias("passes"), circle.alias("as_circle"), F.round(score, 6).alias("score"))
    order = Window.partitionBy("ring_id").orderBy(F.desc("passes"), F.desc("score"), "kind")
    return got.withColumn("place", F.row_number().over(order))


def elliptical_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arc of each ring's ellipse that its points run through."""
    got = fits.elliptical_arc(event_rings(spark, sf_dir))
    return got.select(*[c if c in ("ring_id", "large_arc", "clockwise") else F.round(c, 5).alias(c) for c in got.columns])


def corner_fillet_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the fillets of each ring's corners begin and end, and their handles."""
    got = rings.fillets(event_rings(spark, sf_dir))
    return got.select("ring_id", "i", "sweep", *[F.round(c, 6).alias(c) for c in ("radius", "trim", "entry_x", "entry_y", "exit_x", "exit_y", "c1x", "c1y", "c2x", "c2y")])


QUERIES = {
    f.__name__: f
    for f in (orientation_classes, turn_angles, edge_meetings, segment_tests, rings_meet, winding_inside, shape_topology, primitive_gates, first_order_gates, elliptical_arcs, corner_fillet_points)
}


def _side(a: str, b: str, p: str) -> str:
    """Cross product in SQL of points named by their columns' prefix."""
    return f"(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"


def _way(a: str, b: str, c: str) -> str:
    return f"CASE WHEN abs({_side(a, b, c)}) <= 1e-8 THEN 0 WHEN {_side(a, b, c)} < 0 THEN 1 ELSE 2 END"


def _in(a: str, b: str, p: str) -> str:
    return " AND ".join(f"{p}{k} BETWEEN least({a}{k}, {b}{k}) - 1e-8 AND greatest({a}{k}, {b}{k}) + 1e-8" for k in "xy")


def _on(a: str, b: str, p: str) -> str:
    return f"(abs({_side(a, b, p)}) <= 1e-8 AND {_in(a, b, p)})"


def _shares(a: str, b: str, c: str, d: str) -> str:
    return "(" + " OR ".join(f"sqrt(pow({p}x - {q}x, 2) + pow({p}y - {q}y, 2)) <= 1e-6" for p in (a, b) for q in (c, d)) + ")"


def _meet(a: str, b: str, c: str, d: str) -> str:
    proper = f"({_way(a, b, c)}) <> ({_way(a, b, d)}) AND ({_way(c, d, a)}) <> ({_way(c, d, b)})"
    return f"((({proper}) OR {_on(a, b, c)} OR {_on(a, b, d)} OR {_on(c, d, a)} OR {_on(c, d, b)}) AND NOT {_shares(a, b, c, d)})"


_E = "e.a", "e.b", "f.a", "f.b"


def _edges(source: str, name: str) -> str:
    return f"""{name} AS (SELECT a.ring_id, a.i, a.n, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM {source} a JOIN {source} b ON a.ring_id = b.ring_id AND b.i = (a.i + 1) % a.n)"""


def _gate(source: str, fitted: str, area: float, iou: float, name: str) -> str:
    """A CTE (ring_id, ok, mx, my) of the gate of rings fitted against source; the middle is fitted's centroid."""
    both = f"greatest(0, least(s.x1, t.x1) - greatest(s.x0, t.x0)) * greatest(0, least(s.y1, t.y1) - greatest(s.y0, t.y0))"
    return f"""{name}0 AS (SELECT s.ring_id, abs(abs(t.a) - abs(s.a)) / greatest(1, abs(s.a)) <= {area} AND
    {both} / ((s.x1 - s.x0) * (s.y1 - s.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {both}) >= {iou} AS ok, t.cx AS mx, t.cy AS my FROM m_{source} s JOIN m_{fitted} t USING (ring_id)),
{name} AS (SELECT ring_id, ok AND NOT EXISTS (SELECT 1 FROM e_{fitted} e JOIN e_{fitted} f ON e.ring_id = f.ring_id AND f.i > e.i + 1 AND NOT (e.i = 0 AND f.i = e.n - 1) WHERE e.ring_id = {name}0.ring_id AND {_meet(*_E)}) AS ok, mx, my FROM {name}0)"""


def _measured(source: str) -> str:
    return f"""{_edges(source, 'e_' + source)}, m_{source} AS (SELECT ring_id, sum(ax * "by" - bx * ay) / 2 AS a, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1,
  sum((ax + bx) * (ax * "by" - bx * ay)) / (3 * sum(ax * "by" - bx * ay)) AS cx, sum((ay + "by") * (ax * "by" - bx * ay)) / (3 * sum(ax * "by" - bx * ay)) AS cy FROM e_{source} GROUP BY 1)"""


def _inside(edges: str, probes: str) -> str:
    """Probes (ring_id, k, qx, qy) with inside by winding number."""
    return f"""SELECT ring_id, k, sum(CASE WHEN e.ay <= qy AND e."by" > qy AND s > 0 THEN 1 WHEN e.ay > qy AND e."by" <= qy AND s < 0 THEN -1 ELSE 0 END) <> 0 OR bool_or(t) AS inside
  FROM (SELECT p.ring_id, k, qx, qy, e.ax, e.ay, e.bx, e."by", {_side('e.a', 'e.b', 'q').replace('qx', 'p.qx').replace('qy', 'p.qy')} AS s, {_on('e.a', 'e.b', 'p.q')} AS t FROM {probes} p JOIN {edges} e USING (ring_id)) e GROUP BY ALL"""


_FITS = f"""fe AS ({ring_queries.SQL['fit_ellipse'].replace('round(', '(').replace(', 6)', ')')}), fq AS ({ring_queries.SQL['fit_rectangle'].replace('round(', '(').replace(', 6)', ')')}),
fo AS ({ring_queries.SQL['fit_rounded_rectangle'].replace(', 6)', ')').replace(' round((', ' ((').replace('round(cx)', '(cx)').replace('round(cy)', '(cy)').replace('round(2 *', '(2 *').replace('round(angle)', '(angle)').replace('round(radius)', '(radius)').replace('round(e) AS', '(e) AS').replace('round(m) AS', '(m) AS')}),
me AS (WITH {_MEASURES} SELECT ring_id, abs(area) AS area, (max_x - min_x) / greatest(1e-6, max_y - min_y) AS aspect, CASE WHEN perimeter > 1e-9 THEN least(1.0, 4 * pi() * abs(area) / (perimeter * perimeter)) ELSE 0 END AS circularity FROM ms),
al AS (SELECT ring_id, 'ellipse' AS kind, rx AS a, ry AS b, 0.0 AS radius, mean_error, max_error, confidence FROM fe UNION ALL SELECT ring_id, 'rectangle', width / 2, height / 2, 0.0, mean_error, max_error, confidence FROM fq
  UNION ALL SELECT ring_id, 'rounded_rectangle', width / 2, height / 2, radius, mean_error, max_error, confidence FROM fo),
ft AS (SELECT ring_id, kind, a, b, CAST(radius AS DOUBLE) AS radius, aspect, circularity, confidence, area / CASE WHEN kind = 'ellipse' THEN pi() * a * b ELSE 4 * a * b - (4 - pi()) * radius * radius END AS ratio,
  mean_error * CASE WHEN kind = 'ellipse' THEN 1 ELSE greatest(1, least(a, b)) END AS mean_error, max_error * CASE WHEN kind = 'ellipse' THEN 1 ELSE greatest(1, least(a, b)) END AS max_error FROM al JOIN me USING (ring_id))"""
_FOLDED = f"{RINGS_SQL}, fd AS (SELECT ring_id, i, n, x, CASE WHEN i % 9 = 4 AND ring_id % 2 = 0 THEN -y ELSE y END AS y FROM ring)"
SQL = {
    "orientation_classes": f"WITH {_NEAR} SELECT ring_id, {_way('p', '', 'n')} AS way, count(*) AS points FROM nb GROUP BY ALL",
    "turn_angles": f"""WITH {_NEAR}, tn AS (SELECT ring_id, CASE WHEN sqrt(ux * ux + uy * uy) < 1e-12 OR sqrt(vx * vx + vy * vy) < 1e-12 THEN 0 ELSE atan2(ux * vy - uy * vx, ux * vx + uy * vy) END AS t
  FROM (SELECT ring_id, x - px AS ux, y - py AS uy, nx - x AS vx, ny - y AS vy FROM nb)) SELECT ring_id, round(sum(t), 6) AS total, round(max(t), 6) AS sharpest FROM tn GROUP BY 1""",
    "edge_meetings": f"""WITH {_FOLDED}, {_edges('fd', 'eg')} SELECT e.ring_id, count(*) AS pairs, CAST(sum(e.i) AS BIGINT) AS sum_i, CAST(sum(f.i) AS BIGINT) AS sum_j
FROM eg e JOIN eg f ON e.ring_id = f.ring_id AND f.i > e.i + 1 AND NOT (e.i = 0 AND f.i = e.n - 1) WHERE {_meet(*_E)} GROUP BY 1""",
    "segment_tests": f"""WITH {RINGS_SQL}, {_edges('ring', 'eg')}, pr AS (SELECT e.ring_id, {_meet(*_E)} AS m, {_shares(*_E)} AS s, {_on('e.a', 'e.b', 'f.a')} AS t, {_in('e.a', 'e.b', 'f.a')} AS x
  FROM eg e, (VALUES (1), (2), (3)) d(d), eg f WHERE f.ring_id = e.ring_id AND f.i = (e.i + d) % e.n)
SELECT ring_id, count(*) FILTER (m) AS meet, count(*) FILTER (s) AS share, count(*) FILTER (t) AS touch, count(*) FILTER (x) AS boxed FROM pr GROUP BY 1""",
    "rings_meet": f"""WITH {RINGS_SQL}, ot AS (SELECT ring_id - 1 AS ring_id, i, n, x * 0.5 + ((ring_id - 1) % 7 + 7) % 7 * 12.0 AS x, y FROM ring), {_edges('ring', 'ea')}, {_edges('ot', 'eb')},
mt AS (SELECT DISTINCT e.ring_id FROM ea e JOIN eb f ON e.ring_id = f.ring_id WHERE {_meet(*_E)}) SELECT DISTINCT ring_id, ring_id IN (SELECT ring_id FROM mt) AS meet FROM ring""",
    "winding_inside": f"""WITH {RINGS_SQL}, {_edges('ring', 'eg')}, pb AS (SELECT ring_id, CAST(k AS INTEGER) AS k, k * 3.0 + 0.25 AS qx, k * 0.5 - 0.125 AS qy FROM (SELECT DISTINCT ring_id FROM ring), range(-20, 21) t(k) UNION ALL SELECT ring_id, 100, x, y FROM ring WHERE i = 3),
wi AS ({_inside('eg', 'pb')}) SELECT ring_id, count(*) FILTER (inside) AS inside FROM wi GROUP BY 1""",
    "shape_topology": f"""WITH {RINGS_SQL}, ho AS (SELECT ring_id, i, n, x * 0.3 AS x, y * 0.3 AS y FROM ring), ft AS (SELECT ring_id, i, n, x * CASE WHEN ring_id % 5 = 0 THEN 0.9 ELSE 0.98 END AS x, y * CASE WHEN ring_id % 5 = 0 THEN 0.9 ELSE 0.98 END AS y FROM ring),
dr AS (SELECT ring_id, i, n, x + CASE WHEN ring_id % 3 = 0 THEN 3.0 ELSE 0 END AS x, y FROM ho WHERE ring_id % 7 <> 0), {_measured('ring')}, {_measured('ho')}, {_measured('ft')}, {_measured('dr')}, {_gate('ring', 'ft', 0.12, 0.68, 'ga')}, {_gate('ho', 'dr', 0.16, 0.56, 'gb')},
pb AS (SELECT ring_id, 0 AS k, mx AS qx, my AS qy FROM gb), wi AS ({_inside('e_ft', 'pb')}), mt AS (SELECT DISTINCT e.ring_id FROM e_dr e JOIN e_ft f ON e.ring_id = f.ring_id WHERE {_meet(*_E)}),
al AS (SELECT ga.ring_id, ga.ok AS outer_ok, gb.ok AS hole_ok, inside, CASE WHEN gb.ok IS NOT NULL THEN ga.ring_id NOT IN (SELECT ring_id FROM mt) END AS apart FROM ga LEFT JOIN gb USING (ring_id) LEFT JOIN wi USING (ring_id))
SELECT ring_id, outer_ok, hole_ok, inside, apart, outer_ok AND coalesce(hole_ok AND inside AND apart, TRUE) AS valid FROM al""",
    "primitive_gates": f"""WITH {_FITS} SELECT ring_id, kind, CASE kind WHEN 'ellipse' THEN mean_error <= 0.7 AND max_error <= 1.05 AND ratio BETWEEN 0.84 AND 1.16 AND confidence >= 0.05
  WHEN 'rectangle' THEN mean_error <= 12 AND max_error <= 19.2 AND ratio BETWEEN 0.84 AND 1.16 ELSE mean_error <= 12 AND max_error <= 19.8 AND ratio BETWEEN 0.8 AND 1.2 AND radius / (2 * least(a, b)) BETWEEN 0.08 AND 0.28 END AS passes,
  CASE WHEN circularity > 0.88 THEN aspect BETWEEN 0.82 AND 1.18 AND max_error / 10 <= 0.36 AND ratio BETWEEN 0.72 AND 1.08
    ELSE aspect BETWEEN 0.9 AND 1.1 AND mean_error / 10 <= 0.2 AND max_error / 10 <= 0.29 AND circularity >= 0.2 AND ratio BETWEEN 0.88 AND 1.12 AND confidence + 0.6 >= 0.7 END AS as_circle FROM ft""",
    "first_order_gates": f"""WITH {_FITS}, sc AS (SELECT *, ring_id % 4 = 0 AS hole, least(1.0, confidence + 0.5) AS sure, radius / least(a, b) AS corner FROM ft),
ga AS (SELECT ring_id, kind, CASE kind WHEN 'ellipse' THEN sure >= CASE WHEN hole THEN 0.81 ELSE 0.84 END AND ratio BETWEEN 0.72 AND 1.30 WHEN 'rectangle' THEN NOT hole AND sure >= 0.90 AND ratio BETWEEN 0.82 AND 1.18
    ELSE NOT hole AND sure >= 0.88 AND ratio BETWEEN 0.74 AND 1.26 AND corner BETWEEN 0.05 AND 0.30 END AS passes,
  sure >= CASE WHEN hole THEN 0.85 ELSE 0.88 END AND ratio BETWEEN 0.80 AND 1.20 AND CASE WHEN hole THEN aspect BETWEEN 0.84 AND 1.16 ELSE aspect BETWEEN 0.90 AND 1.10 END AS as_circle,
  round(sure + CASE kind WHEN 'ellipse' THEN 0.03 + CASE WHEN hole THEN 0.04 ELSE 0 END WHEN 'rounded_rectangle' THEN 0.02 ELSE 0 END, 6) AS score FROM sc)
SELECT *, CAST(row_number() OVER (PARTITION BY ring_id ORDER BY passes DESC, score DESC, kind) AS INTEGER) AS place FROM ga""",
    "elliptical_arcs": f"""WITH {_FRAME}, lf AS (SELECT ring.ring_id, i, half_u, half_v, angle, abs(area) AS ar, (x - fr.cx) * cos(angle) + (y - fr.cy) * sin(angle) AS u, (y - fr.cy) * cos(angle) - (x - fr.cx) * sin(angle) AS v FROM ring JOIN fr USING (ring_id) JOIN ms USING (ring_id)),
tt AS (SELECT *, atan2(v / half_v, u / half_u) AS t, abs(pow(u / half_u, 2) + pow(v / half_v, 2) - 1) AS q FROM lf), st AS (SELECT *, t - lag(t) OVER (PARTITION BY ring_id ORDER BY i) AS s, sqrt(pow(u - half_u * cos(t), 2) + pow(v - half_v * sin(t), 2)) AS d FROM tt),
su AS (SELECT ring_id, half_u, half_v, angle, ar, sum(s - 2 * pi() * round(s / (2 * pi()))) AS sweep, avg(d) AS mean, max(d) AS worst, avg(q) AS e, max(q) AS m, count(*) AS n FROM st GROUP BY ALL),
fi AS (SELECT *, ({_dn('e', 0, 0.14)} + {_dn('m', 0, 0.22)} + {_dn('abs(1 - ar / (pi() * half_u * half_v))', 0, 0.18)}) / 3 AS sure FROM su WHERE n >= 8)
SELECT ring_id, round(half_u, 5) AS rx, round(half_v, 5) AS ry, round(angle, 5) AS angle, round(sweep, 5) AS sweep, round(mean, 5) AS mean, round(worst, 5) AS max,
  round(({_dn('worst / greatest(1, least(half_u, half_v))', 0, 0.16)} + {_dn('e', 0, 0.20)} + 1 - {_dn('abs(degrees(sweep))', 18, 170)} + sure) / 4, 5) AS confidence, abs(sweep) > pi() AS large_arc, sweep > 0 AS clockwise FROM fi WHERE abs(degrees(sweep)) > 1""",
    "corner_fillet_points": f"""WITH {ring_queries._ANGLES}, sh AS (SELECT *, least(ea, eb) AS s, greatest(ea, eb) AS l, radians(angle) AS th, greatest(0.25, least(1, (angle - 92) / 32)) AS sc FROM an),
ra AS (SELECT *, least(3.25, s * 0.11 * sc, 0.9 * 0.24 * s * tan(th / 2)) AS r FROM sh WHERE angle < 180 - degrees(1e-3) AND angle > 0 AND s > 1 AND s / l >= 0.58),
tr AS (SELECT *, r / tan(th / 2) AS t, (px - x) / ea AS ux, (py - y) / ea AS uy, (nx - x) / eb AS vx, (ny - y) / eb AS vy FROM ra WHERE r > 0.2),
pt AS (SELECT *, x + ux * t AS fx, y + uy * t AS fy, x + vx * t AS gx, y + vy * t AS gy, 4.0 / 3 * tan((pi() - th) / 4) * r AS h FROM tr WHERE t > 0.2)
SELECT ring_id, i, round(r, 6) AS radius, round(t, 6) AS trim, round(fx, 6) AS entry_x, round(fy, 6) AS entry_y, round(gx, 6) AS exit_x, round(gy, 6) AS exit_y, round(fx - ux * h, 6) AS c1x, round(fy - uy * h, 6) AS c1y,
  round(gx - vx * h, 6) AS c2x, round(gy - vy * h, 6) AS c2y, (x - fx) * (gy - y) - (y - fy) * (gx - x) > 0 AS sweep FROM pt WHERE sqrt(pow(gx - fx, 2) + pow(gy - fy, 2)) > 0.5""",
}

"""Queries of scalar functions, sampled curves, candidates and document statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.functions import scalars
from rastrel.operators import candidates, documents, guard


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def hex_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _part(spark, sf_dir).select("p_partkey", scalars.rgb_to_hex((k % 256).cast("int"), (k * 7 % 256).cast("int"), F.col("p_size") * 5).alias("hex"))
    back = scalars.parse_hex_color(F.col("hex"))
    return rows.select("p_partkey", "hex", back["r"].alias("r"), back["g"].alias("g"), back["b"].alias("b"))


def svg_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select("p_partkey", ((F.col("p_retailprice") - 1000) / 8).alias("v"))
    return rows.select("p_partkey", scalars.format_number(F.col("v")).alias("text"))


def metadata_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    meta = F.create_map(F.lit("width"), F.when(F.col("event_id") % 3 == 0, F.lit("wide")).otherwise(F.col("value").cast("string")))
    return events.select("event_id", F.round(scalars.metadata_float(meta, "width", -1.0), 6).alias("width"), scalars.metadata_float(meta, "height", 2.5).alias("height"))


def svg_valid_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<SVG>"), "html", F.lit("</svg>"))).otherwise(F.col("html"))
    return pages.groupBy((F.col("page_id") % 3).alias("part")).agg(F.round(scalars.svg_valid_ratio(text), 6).alias("ratio"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.round(scalars.loss_to_perplexity(F.col("value") / 10), 4).alias("perplexity"))


def image_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scalars.short_sha1(F.col("html")).alias("sha"))


def quantize_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.lit(" Fast_Octree")).when(F.col("p_size") % 3 == 1, F.lit("max_coverage")).otherwise(F.col("p_type"))
    return _part(spark, sf_dir).groupBy(scalars.quantize_method(name).alias("method")).agg(F.count("*").alias("n"))


def bezier_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("double"), (F.col("p_partkey") % 10).cast("double")
    zero = F.lit(0.0)
    rows = _part(spark, sf_dir).select("p_partkey", F.posexplode(guard.cubic_points((zero, zero), (size, key), (size * 2, -key), (size * 3, zero))).alias("k", "p"))
    return rows.select("p_partkey", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def quadratic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("double"), (F.col("p_partkey") % 10).cast("double")
    zero = F.lit(0.0)
    rows = _part(spark, sf_dir).select("p_partkey", F.posexplode(guard.quadratic_points((zero, zero), (size, key), (size * 3, zero))).alias("k", "p"))
    return rows.select("p_partkey", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def arc_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("double"), (F.col("p_partkey") % 10).cast("double")
    points = guard.arc_points(F.lit(5.0), F.lit(7.0), size, size / 2, key / 10, key / 3, F.lit(1.5))
    rows = _part(spark, sf_dir).select("p_partkey", F.posexplode(points).alias("k", "p"))
    return rows.select("p_partkey", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def candidate_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences made from part numbers stand for those of the detectors."""
    parts = _part(spark, sf_dir).select(F.col("p_partkey").alias("contour"), (F.col("p_size") % 4 == 0).alias("is_hole"))
    scored = [(F.col("contour") * (13 + 4 * k) % 101 / 100).alias("c") for k in range(len(candidates.KINDS))]
    rows = parts.select("contour", F.posexplode(F.array(*scored)).alias("k", "confidence"))
    kinds = F.array(*[F.lit(k) for k, _ in candidates.KINDS])
    return candidates.best(rows.select("contour", F.get(kinds, "k").alias("kind"), "confidence"), parts, "contour")


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their lines as shapes."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shapes = lines.select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 3).alias("n_holes"), F.col("l_quantity").cast("long").alias("n_segments"), F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("fill"))
    return documents.document_stats(shapes)


QUERIES = {
    f.__name__: f
    for f in (hex_colour, svg_number_format, metadata_float, svg_valid_ratio, perplexity, image_sha1, quantize_method, bezier_sample, quadratic_sample, arc_sample, candidate_argmax, document_stats)
}
_CURVE = "SELECT p_partkey, CAST(k AS INTEGER) AS k, k / 12.0 AS t, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 10 AS DOUBLE) AS c FROM part, range(13) r(k)"
SQL = {
    "hex_colour": "SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_size * 5 AS b FROM part)",
    "svg_number_format": r"""SELECT p_partkey, CASE WHEN t IN ('-0', '') THEN '0' ELSE t END AS text FROM (
SELECT p_partkey, regexp_replace(regexp_replace(printf('%.2f', (p_retailprice - 1000) / 8), '(\.\d*?)0+$', '\1'), '\.$', '') AS t FROM part)""",
    "metadata_float": "SELECT event_id, round(CASE WHEN event_id % 3 = 0 OR value IS NULL THEN -1.0 ELSE value END, 6) AS width, CAST(2.5 AS DOUBLE) AS height FROM events",
    "svg_valid_ratio": """SELECT page_id % 3 AS part, round(avg(CAST(contains(lower(t), '<svg') AND contains(lower(t), '</svg>') AS DOUBLE)), 6) AS ratio
FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '<SVG>' || html || '</svg>' ELSE html END AS t FROM pages) GROUP BY 1""",
    "perplexity": "SELECT event_id, round(exp(least(20.0, value / 10)), 4) AS perplexity FROM events",
    "image_sha1": "SELECT page_id, substr(sha1(html), 1, 12) AS sha FROM pages",
    "quantize_method": """SELECT CASE WHEN p_size % 3 = 0 THEN 'fast_octree' WHEN p_size % 3 = 1 THEN 'max_coverage' WHEN lower(trim(p_type)) IN ('median_cut', 'max_coverage', 'fast_octree') THEN lower(trim(p_type)) ELSE 'median_cut' END AS method, count(*) AS n FROM part GROUP BY 1""",
    "bezier_sample": f"SELECT p_partkey, k, round(3 * (1 - t) * (1 - t) * t * s + 3 * (1 - t) * t * t * 2 * s + t * t * t * 3 * s, 6) AS x, round(3 * (1 - t) * (1 - t) * t * c - 3 * (1 - t) * t * t * c, 6) AS y FROM ({_CURVE})",
    "quadratic_sample": f"SELECT p_partkey, k, round(2 * (1 - t) * t * s + t * t * 3 * s, 6) AS x, round(2 * (1 - t) * t * c, 6) AS y FROM ({_CURVE})",
    "arc_sample": f"SELECT p_partkey, k, round(5 + s * cos(c / 3 + 1.5 * t) * cos(c / 10) - s / 2 * sin(c / 3 + 1.5 * t) * sin(c / 10), 6) AS x, round(7 + s * cos(c / 3 + 1.5 * t) * sin(c / 10) + s / 2 * sin(c / 3 + 1.5 * t) * cos(c / 10), 6) AS y FROM ({_CURVE})",
    "candidate_argmax": """WITH ca AS (SELECT p_partkey AS contour, p_size % 4 = 0 AS hole, k, kind, least_, (p_partkey * (13 + 4 * k) % 101) / 100.0 AS confidence
  FROM part, (VALUES (0, 'circle', 0.9), (1, 'ellipse', 0.88), (2, 'rounded_rectangle', 0.84), (3, 'isosceles_triangle', 0.84), (4, 'star', 0.86), (5, 'dshape', 0.82)) v(k, kind, least_)),
ok AS (SELECT * FROM ca WHERE confidence >= least_ AND (NOT hole OR k < 3) QUALIFY row_number() OVER (PARTITION BY contour ORDER BY confidence DESC, k) = 1)
SELECT p_partkey AS contour, coalesce(kind, 'freeform') AS kind, CAST(coalesce(confidence, 1.0) AS DOUBLE) AS confidence FROM part LEFT JOIN ok ON contour = p_partkey""",
    "document_stats": """SELECT l_orderkey AS image_id, count(*) AS num_shapes, CAST(sum(l_linenumber % 3) AS BIGINT) AS num_holes, CAST(sum(l_linenumber % 3 + 1) AS BIGINT) AS num_loops,
CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS num_segments, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS num_primitives, count(DISTINCT l_returnflag) AS num_layers, count(DISTINCT l_linestatus) AS num_fills FROM lineitem GROUP BY 1""",
}

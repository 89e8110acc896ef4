"""Rasters, rings and radial signatures made from the star-schema tables, by exact rules.

Pixels come from integer arithmetic alone, so that any engine makes the same ones."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels a side.
SIDE = 32
#: A whole turn in radians, to the digits that the SQL writes.
TURN = 2 * Decimal("3.141592653589793")


def _inside(kind: Column, size: Column, u: Column, v: Column) -> Column:
    """Whether the pixel whose doubled centre is (u, v) lies in the part's shape."""
    reach = 2 * (size % 9 + 6)
    square = u * u + v * v
    left, right = (u + 15) * (u + 15) + v * v, (u - 15) * (u - 15) + v * v
    return (
        F.when(kind == 0, square <= reach * reach)
        .when(kind == 1, (F.abs(u) <= reach) & (F.abs(v) <= reach))
        .when(kind == 2, (square <= reach * reach) & (4 * square > reach * reach))
        .when(kind == 3, (v >= -reach) & (v <= reach) & (2 * F.abs(u) <= v + reach))
        .otherwise((left <= 100) | (right <= (size % 8) * (size % 8)))
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, size, brand) dealt out before each row becomes a raster: a part is narrow, so that shuffle is small."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").cast("long").alias("image_id"), F.col("p_size").cast("int").alias("size"), F.col("p_brand").alias("brand")
    )
    return part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")


def images(spark: SparkSession, sf_dir: str, kept: tuple[str, ...] = ("grey", "rgb")) -> DataFrame:
    """(image_id, width, height int, grey, rgb binary): the rasters of pixels(), a row each. kept: the planes to make, in this order."""
    y, x = (a.ravel() for a in np.mgrid[:SIDE, :SIDE])
    u, v = 2 * x - (SIDE - 1), 2 * y - (SIDE - 1)
    square, ground = u * u + v * v, 200 + (7 * x + 13 * y) % 40
    ground[0] = 110

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n = batch.num_rows
                ids, sizes = batch.column("image_id").to_numpy(), batch.column("size").to_numpy().astype(np.int64)
                # Kind and size make a shape; equal ones are made once.
                drawn, at_drawn = np.unique(ids % 5 + 5 * sizes, return_inverse=True)
                kind, size = drawn % 5, drawn // 5
                reach = 2 * (size % 9 + 6)[:, None]
                two = ((u + 15) ** 2 + v * v <= 100) | ((u - 15) ** 2 + v * v <= ((size % 8) ** 2)[:, None])
                kinds = (
                    square <= reach**2, (np.abs(u) <= reach) & (np.abs(v) <= reach), (square <= reach**2) & (4 * square > reach**2),
                    (v >= -reach) & (v <= reach) & (2 * np.abs(u) <= v + reach), two,
                )
                inside = np.choose(kind[:, None], kinds)
                made = {}
                if "grey" in kept:
                    grey = [r.tobytes() for r in np.where(inside, (40 + size)[:, None], ground).astype(np.uint8)]
                    made["grey"] = [grey[k] for k in at_drawn]
                if "rgb" in kept:
                    digit = np.array([int(b[6]) for b in batch.column("brand").to_pylist()])
                    rgb = np.full((n, SIDE * SIDE, 3), 240)
                    for k, tone in enumerate((25 * digit[:, None] + np.where(y < SIDE // 2, 6, 0), (30 * (sizes % 6))[:, None], 90)):
                        rgb[..., k] = np.where(inside[at_drawn], tone, 240)
                    made["rgb"] = [r.tobytes() for r in rgb.astype(np.uint8)]
                sides = {c: pa.array(np.full(n, SIDE, np.int32)) for c in ("width", "height")}
                yield pa.RecordBatch.from_pydict({"image_id": batch.column("image_id")} | sides | {c: pa.array(made[c], pa.binary()) for c in kept})

    return _parts(spark, sf_dir).mapInArrow(run, "image_id long, width int, height int" + "".join(f", {c} binary" for c in kept))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, r, g, b, a, grey int) for every part: a dark shape on a light ground, and one cell of middle
    grey, so that a threshold lies between both.

    The raster is generated row by row from the part, so no pixel is joined or shuffled."""
    part = _parts(spark, sf_dir)
    axis = F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))
    grid = part.select("*", axis.alias("y")).select("*", axis.alias("x"))
    u, v = 2 * F.col("x") - (SIDE - 1), 2 * F.col("y") - (SIDE - 1)
    digit = lambda k: F.substring("brand", k, 1).cast("int")
    grid = grid.withColumn("inside", _inside((F.col("image_id") % 5).cast("int"), F.col("size"), u, v))
    ground = 200 + (7 * F.col("x") + 13 * F.col("y")) % 40
    tint = F.when(F.col("y") < SIDE // 2, 6).otherwise(0)
    return grid.select(
        "image_id", "x", "y",
        F.when(F.col("inside"), 25 * digit(7) + tint).otherwise(240).cast("int").alias("r"),
        F.when(F.col("inside"), 30 * (F.col("size") % 6)).otherwise(240).cast("int").alias("g"),
        F.when(F.col("inside"), 90).otherwise(240).cast("int").alias("b"),
        F.lit(255).alias("a"),
        F.when(F.col("inside"), 40 + F.col("size")).when((F.col("x") == 0) & (F.col("y") == 0), 110).otherwise(ground).cast("int").alias("grey"),
    )


#: The same pixels in DuckDB SQL: a CTE `px`.
PIXELS_SQL = f"""px AS (
  SELECT image_id, x, y,
    CAST(CASE WHEN inside THEN 25 * m + CASE WHEN y < {SIDE // 2} THEN 6 ELSE 0 END ELSE 240 END AS INTEGER) AS r,
    CAST(CASE WHEN inside THEN 30 * (size % 6) ELSE 240 END AS INTEGER) AS g,
    CAST(CASE WHEN inside THEN 90 ELSE 240 END AS INTEGER) AS b, 255 AS a,
    CAST(CASE WHEN inside THEN 40 + size WHEN x = 0 AND y = 0 THEN 110 ELSE 200 + (7 * x + 13 * y) % 40 END AS INTEGER) AS grey
  FROM (SELECT *, CASE image_id % 5
      WHEN 0 THEN u * u + v * v <= reach * reach
      WHEN 1 THEN abs(u) <= reach AND abs(v) <= reach
      WHEN 2 THEN u * u + v * v <= reach * reach AND 4 * (u * u + v * v) > reach * reach
      WHEN 3 THEN v >= -reach AND v <= reach AND 2 * abs(u) <= v + reach
      ELSE (u + 15) * (u + 15) + v * v <= 100 OR (u - 15) * (u - 15) + v * v <= (size % 8) * (size % 8) END AS inside
    FROM (SELECT CAST(p_partkey AS BIGINT) AS image_id, CAST(p_size AS INTEGER) AS size,
        CAST(substr(p_brand, 7, 1) AS INTEGER) AS m,
        CAST(gx.i AS INTEGER) AS x, CAST(gy.i AS INTEGER) AS y, 2 * (p_size % 9 + 6) AS reach,
        CAST(2 * gx.i - {SIDE - 1} AS INTEGER) AS u, CAST(2 * gy.i - {SIDE - 1} AS INTEGER) AS v
      FROM part, range({SIDE}) gx(i), range({SIDE}) gy(i))))"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ring_id, i, n, x, y): each user's events in time order as a closed ring around the origin."""
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    by = Window.partitionBy("user_id")
    rows = events.select(
        F.col("user_id").cast("long").alias("ring_id"),
        (F.row_number().over(by.orderBy("ts", "event_id")) - 1).cast("int").alias("i"),
        F.count("*").over(by).cast("int").alias("n"),
        (20 + F.coalesce("value", F.lit(0.0)) / 10).alias("radius"),
    )
    # As in the SQL, where the literals are decimals: the product is exact, and only then a double. A rounded one moves points by
    # a unit in the last place, which decides whether edges that lie on each other count as crossing.
    angle = (F.lit(TURN) * F.col("i").cast("decimal(10,0)")).cast("double") / F.col("n")
    return rows.select("ring_id", "i", "n", (F.col("radius") * F.cos(angle)).alias("x"), (F.col("radius") * F.sin(angle)).alias("y"))


#: The same rings in DuckDB SQL: a CTE `ring`.
RINGS_SQL = """ring AS (
  SELECT ring_id, i, n, radius * cos(2 * 3.141592653589793 * i / n) AS x, radius * sin(2 * 3.141592653589793 * i / n) AS y
  FROM (SELECT CAST(user_id AS BIGINT) AS ring_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i,
      CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n, 20 + coalesce(value, 0.0) / 10 AS radius FROM events))"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape_id, k, n, r double): each embedding as a closed radial signature of positive radii."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("shape_id"), "embedding", F.size("embedding").alias("n"))
    rows = rows.select("shape_id", "n", F.posexplode("embedding").alias("k", "v"))
    return rows.select("shape_id", "k", "n", (2 + F.col("v").cast("double")).alias("r"))


SIGNATURES_SQL = """sig AS (
  SELECT shape_id, k, n, 2 + CAST(embedding[k + 1] AS DOUBLE) AS r
  FROM (SELECT CAST(vec_id AS BIGINT) AS shape_id, embedding, CAST(len(embedding) AS INTEGER) AS n, CAST(unnest(range(len(embedding))) AS INTEGER) AS k FROM embeddings))"""

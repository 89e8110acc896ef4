"""Operators on exploded pixels (image_id, x, y, ...): thresholds, masks, stencils and their measures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "image_id"


def composite_over_white(channel: Column, alpha: Column) -> Column:
    """Blend an 8-bit channel over white by an 8-bit alpha, rounded as integer image code does it."""
    total = channel * alpha + 255 * (255 - alpha) + 128
    return F.shiftright(total + F.shiftright(total, 8), 8).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit grey of an RGB pixel with the ITU-R 601 weights in 16-bit fixed point."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 0x8000, 16).cast("int")


def otsu(pixels: DataFrame, key: str = KEY, grey: str = "grey") -> DataFrame:
    """(key, threshold int): the first grey level that maximises the variance between both sides; 127 for one level.

    One row for each level and key leaves the map side; cumulative sums run over at most 256 rows of a key."""
    counts = pixels.groupBy(key, grey).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(key).orderBy(grey)
    whole = Window.partitionBy(key)
    step = counts.select(
        key, F.col(grey).alias("t"),
        F.sum("c").over(upto).alias("w0"), F.sum("c").over(whole).alias("w"),
        F.sum(F.col("c") * F.col(grey)).over(upto).alias("s0"), F.sum(F.col("c") * F.col(grey)).over(whole).alias("s"),
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0))
    spread = F.col("w0").cast("double") * w1 * gap * gap
    best = step.select(key, "t", spread.alias("v")).groupBy(key).agg(F.max_by("t", F.when(F.col("v") > 0, F.struct("v", -F.col("t")))).alias("t"))
    return best.select(key, F.coalesce("t", F.lit(127)).cast("int").alias("threshold"))


def foreground(pixels: DataFrame, key: str = KEY, invert: bool = False, use_alpha: bool = True) -> DataFrame:
    """pixels with `field` float: tone, or the larger of tone and alpha where an image is partly transparent."""
    tone = (F.col("grey").cast("float") / F.lit(255.0).cast("float")).cast("float")
    tone = tone if invert else (F.lit(1.0).cast("float") - tone).cast("float")
    if not use_alpha:
        return pixels.withColumn("field", tone)
    alpha = (F.col("a").cast("float") / F.lit(255.0).cast("float")).cast("float")
    ends = pixels.groupBy(key).agg(F.max("a").alias("__hi"), F.min("a").alias("__lo"))
    partly = (F.col("__hi") > 0) & ((F.col("__lo") / 255.0) < 0.999)
    return pixels.join(ends, key).withColumn("field", F.when(partly, F.greatest(tone, alpha)).otherwise(tone)).drop("__hi", "__lo")


def foreground_level(threshold: Column, invert: bool = False) -> Column:
    """A grey threshold as a level of `field`; both are 32-bit, so pixels at the threshold may fall either way."""
    level = threshold.cast("double") / 255.0
    return (level if invert else 1.0 - level).cast("float")


def mask(pixels: DataFrame, key: str = KEY, invert: bool = False) -> DataFrame:
    """pixels with `m` boolean: field at or above the level of the image's Otsu threshold."""
    level = otsu(pixels, key).select(key, foreground_level(F.col("threshold"), invert).alias("level"))
    return foreground(pixels, key, invert).join(level, key).withColumn("m", F.col("field") >= F.col("level")).drop("level")


def _by_image(cells: DataFrame, steps: str, key: str) -> DataFrame:
    """(key, x, y, m) after morphology: an image's cells come together once, whatever the number of steps, and are
    dealt out again as rows where they are."""
    from rastrel.kernels import raster

    kind = cells.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                xs, ys, ms = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("x", "y", "m"))
                grid = np.zeros((int(ys.max()) + 1, int(xs.max()) + 1), bool)
                grid[ys, xs] = ms
                out = raster.morphology(grid, steps)[ys, xs]
                own = pa.array([batch.column(key)[k].as_py()] * len(xs), batch.schema.field(key).type)
                yield pa.RecordBatch.from_pydict({key: own, "x": pa.array(xs.astype(np.int32)), "y": pa.array(ys.astype(np.int32)), "m": pa.array(out)})

    held = cells.groupBy(key).agg(*[F.collect_list(F.coalesce(c, F.lit(False)) if c == "m" else c).alias(c) for c in ("x", "y", "m")])
    return held.mapInArrow(run, f"`{key}` {kind}, x int, y int, m boolean")


def dilate(cells: DataFrame, key: str = KEY) -> DataFrame:
    """(key, x, y, m): set where any cell of the 3x3 neighbourhood is."""
    return _by_image(cells, "d", key)


def erode(cells: DataFrame, key: str = KEY) -> DataFrame:
    """(key, x, y, m): set where the whole 3x3 neighbourhood is; cells outside count as unset."""
    return _by_image(cells, "e", key)


def binary_open(cells: DataFrame, iterations: int = 1, key: str = KEY) -> DataFrame:
    return _by_image(cells, "ed" * iterations, key)


def binary_close(cells: DataFrame, iterations: int = 1, key: str = KEY) -> DataFrame:
    return _by_image(cells, "de" * iterations, key)


def mask_iou(left: Column, right: Column) -> Column:
    """Aggregate: cells set in both over cells set in either; 1 where none is."""
    both = F.sum(F.when(left & right, 1).otherwise(0))
    either = F.sum(F.when(left | right, 1).otherwise(0))
    return F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(1.0))


def moments(cells: DataFrame, key: str = KEY) -> DataFrame:
    """(key, area long, min_x .. max_y int, cx, cy double) of the set cells; pixel centres are at +0.5."""
    return (
        cells.where("m").groupBy(key)
        .agg(F.count("*").alias("area"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))], F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        .select(key, "area", "min_x", "min_y", "max_x", "max_y", (F.col("sx") / F.col("area") + 0.5).alias("cx"), (F.col("sy") / F.col("area") + 0.5).alias("cy"))
    )


def rasters(cells: DataFrame, key: str = KEY, value: str = "m") -> DataFrame:
    """(key, width, height, data binary): one row an image, a byte a cell in row order, for array kernels.

    Cells that have no row are 0; values beyond a byte are an error."""
    kind = cells.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, data = [], []
            for k in range(batch.num_rows):
                xs, ys, vs = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("x", "y", "v"))
                if len(vs) and (vs.max() > 255 or vs.min() < 0):
                    raise ValueError(f"{value} of image {batch.column(key)[k]} does not fit a byte")
                grid = np.zeros((int(ys.max()) + 1, int(xs.max()) + 1), np.uint8)
                grid[ys, xs] = vs
                size.append(grid.shape)
                data.append(grid.tobytes())
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "width": pa.array([s[1] for s in size], pa.int32()), "height": pa.array([s[0] for s in size], pa.int32()), "data": pa.array(data, pa.binary())})

    held = cells.groupBy(key).agg(*[F.collect_list(c).alias(n) for c, n in (("x", "x"), ("y", "y"), (F.coalesce(F.col(value).cast("int"), F.lit(0)), "v"))])
    return held.mapInArrow(run, f"`{key}` {kind}, width int, height int, data binary")

"""Operators on whole images, a row each: thresholds, morphology and measures without a shuffle.

A raster of any size is one row, so all of these are map-only; cells are a byte each in row order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rastrel.operators.pixels import KEY


def planes(batch: pa.RecordBatch, column: str, channels: int = 1) -> Iterator[np.ndarray]:
    """Each row's plane as (height, width) or (height, width, channels); null or short data is an empty image."""
    for w, h, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", column)), strict=True):
        w, h = w or 0, h or 0
        if data is None or len(data) < w * h * channels:
            w = h = 0
        cells = np.frombuffer(data or b"", np.uint8)[: w * h * channels]
        yield cells.reshape((h, w) if channels == 1 else (h, w, channels))


#: Bytes of rasters, and of what was made of them, that a worker remembers before it starts afresh.
REMEMBERED = 64 << 20
_known: dict[tuple, tuple[pa.RecordBatch, int]] = {}


def _recall(own: tuple, make: Callable[[], list[dict]], schema: pa.Schema) -> pa.RecordBatch:
    found = _known.get(own)
    if found is None:
        made = pa.RecordBatch.from_pylist(make(), schema=schema)
        size = made.nbytes + sum(len(x) for x in own if isinstance(x, bytes)) + 1024
        total = size + (next(reversed(_known.values()))[1] if _known else 0)  # the last entry's is that of all
        if total > REMEMBERED:
            _known.clear()
            total = size
        found = _known[own] = made, total
    return found[0]


def each_distinct(name: str, planes_: Iterable[tuple[np.ndarray, tuple]], make: Callable[[np.ndarray, tuple], list[dict]], schema: pa.Schema) -> tuple[pa.Table, np.ndarray]:
    """(rows, the place of the input that each belongs to): make's rows of every (plane, settings of its own).

    Equal planes are worked on once by a worker, whose memory of them is bounded; unlike ones cost what they did. name tells
    all that make depends on besides its arguments."""
    place: dict[tuple, int] = {}
    parts: list[pa.RecordBatch] = []
    which = []
    for plane, more in planes_:
        own = (name, plane.shape, more, plane.tobytes())
        if own not in place:
            place[own] = len(parts)
            parts.append(_recall(own, lambda: make(plane, more), schema))  # noqa: B023
        which.append(place[own])
    which = np.array(which, np.int64)
    sizes = np.array([p.num_rows for p in parts], np.int64)
    opens = np.cumsum(sizes) - sizes
    counts = sizes[which] if len(which) else which
    rows = np.repeat(np.arange(len(which)), counts)
    at = np.repeat(opens[which] if len(which) else which, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return pa.Table.from_batches(parts, schema).combine_chunks().take(pa.array(at)), rows


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(a, np.uint8).tobytes() for a in arrays], pa.binary())


def map_planes(images: DataFrame, column: str, kernel: Callable[[np.ndarray], dict[str, Any]], schema: dict[str, tuple[str, pa.DataType]], key: str = KEY, channels: int = 1, once: bool = False) -> DataFrame:
    """(key, one column for each of schema): kernel's values of every image. schema: name -> (Spark type, Arrow type). once: equal
    planes among 1024 rows are worked on once."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            known: dict = {}
            rows = []
            for k, p in enumerate(planes(batch, column, channels)):
                own = (p.shape, p.tobytes()) if once else k
                if own not in known:
                    known[own] = kernel(p)
                rows.append(known[own])
            yield pa.RecordBatch.from_pydict({key: batch.column(key)} | {n: pa.array([r[n] for r in rows], t) for n, (_, t) in schema.items()})

    return images.select(key, "width", "height", column).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} {s}" for n, (s, _) in schema.items()))


def masks(images: DataFrame, threshold: int | None = None, bias: int = 0, invert: bool = False, steps: str = "", key: str = KEY, column: str = "grey") -> DataFrame:
    """(key, width, height, data binary): the mask of each grey image by its Otsu level or a given one, then `steps`, a
    letter each: e(rode), d(ilate), o(pen), c(lose)."""
    from rastrel.kernels import raster

    def kernel(grey: np.ndarray) -> dict:
        mask = raster.foreground(grey, threshold, invert, bias=bias) if grey.size else grey.astype(bool)
        mask = raster.morphology(mask, steps)
        return {"width": mask.shape[1], "height": mask.shape[0], "data": np.ascontiguousarray(mask, np.uint8).tobytes()}

    return map_planes(images, column, kernel, {"width": ("int", pa.int32()), "height": ("int", pa.int32()), "data": ("binary", pa.binary())}, key, once=True)


def measures(held: DataFrame, key: str = KEY) -> DataFrame:
    """(key, n, sum_x, sum_y, sum_xy long, min_x .. max_y int) of each mask's set cells; without any, n = 0 and null ends."""

    def kernel(cells: np.ndarray) -> dict:
        y, x = np.nonzero(cells)
        some = len(x) > 0
        ends = {f"{n}_{c}": int(f(v)) if some else None for c, v in (("x", x), ("y", y)) for n, f in (("min", np.min), ("max", np.max))}
        return {"n": len(x), "sum_x": int(x.sum()), "sum_y": int(y.sum()), "sum_xy": int((x * y).sum())} | ends

    long, short = ("long", pa.int64()), ("int", pa.int32())
    return map_planes(held, "data", kernel, {"n": long, "sum_x": long, "sum_y": long, "sum_xy": long, "min_x": short, "max_x": short, "min_y": short, "max_y": short}, key)


def moments(held: DataFrame, key: str = KEY) -> DataFrame:
    """(key, area long, min_x .. max_y int, cx, cy double) of masks with set cells; pixel centres are at +0.5."""
    from pyspark.sql import functions as F

    found = measures(held, key).where("n > 0")
    centre = lambda c: (F.col(f"sum_{c}") / F.col("n") + 0.5).alias(f"c{c}")
    return found.select(key, F.col("n").alias("area"), "min_x", "min_y", "max_x", "max_y", centre("x"), centre("y"))

"""Shared plumbing: scratch tables in the cluster's shared folder and byte-bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handed to a kernel at once; bounds the kernels' array memory.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a temporary one in local mode; on a
    cluster, whose executors would each write to a disk of their own, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master or 'the cluster'} shares")
        found = "file://" + tempfile.mkdtemp(prefix="rastrel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def clear_scratch(spark: SparkSession) -> bool:
    """Delete all scratch tables of this and earlier jobs; results that still read them fail from then on."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rastrel")
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def own_name(wanted: str, taken: list[str]) -> str:
    """wanted, with as many underscores before it as keep it from the names in use."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and a lost
    executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rastrel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about `limit` text bytes (one row at least)."""
    import numpy as np

    if not batch.num_rows:
        return
    sizes = batch.column(column)
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_slices(df: DataFrame, kernel: Callable, schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with batches cut by text bytes. kernel: RecordBatch -> dict of arrays by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, limit):
                yield pa.RecordBatch.from_pydict(kernel(part))

    return df.mapInArrow(run, schema)

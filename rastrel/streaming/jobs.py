"""Uploads as a stream of files, vectorized batch by batch into an append-only table of jobs."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rastrel.config import ClassifyFirst, Common, PrimitiveFirst

if TYPE_CHECKING:
    from rastrel.kernels.geometry import Document

JOB = (
    "job_id string, image_name string, input_path string, ok boolean, status string, message string, error string, pipeline string, "
    "started_at timestamp, finished_at timestamp, duration_ms double, image_sha1_short string, svg_sha1_short string, svg_char_length long, svg_content string"
)


def document_of(data: bytes | None, settings: Common) -> Document:
    """The vector document of one image file's bytes; ValueError where they are no image.

    Colour modes draw a layer for each colour, and the mask where no layer has a shape. The classify-first order draws in
    the original's coordinates, the primitive-first one in those of the resized image."""
    from rastrel.kernels import color, decode, document, image_files, vectorize

    planes = decode.preprocess(image_files.decode(data), settings)
    first = isinstance(settings, PrimitiveFirst)
    scale, size = ((1.0, 1.0), planes.working) if first else (planes.scale, planes.original)
    found: list = []
    if isinstance(settings, ClassifyFirst) and settings.vectorization_mode != "monochrome":
        s = settings
        parts = color.segment(planes.rgb, planes.alpha > 0, s.max_colors, s.quantization_method, s.color_distance_threshold, s.merge_similar_colors, s.background_mode, s.background_color)
        for layer in parts.layers:
            found += vectorize.shapes(layer.mask, settings=s, scale=scale, layer_id=layer.layer_id, z=layer.z, fill=layer.colour.hex)
    if not found and planes.mask.any():
        found = vectorize.shapes(planes.mask, settings=settings, scale=scale)
    return document.assemble(*size, [shape for shape, _, _ in found])


def draw(data: bytes | None, settings: Common) -> tuple[str, int]:
    """(SVG text, number of shapes) of one image file's bytes."""
    from rastrel.kernels import document

    found = document_of(data, settings)
    return document.export(found, settings.background), len(found.shapes)


def run_jobs(files: DataFrame, settings: Common | None = None, primitive_first: bool = False) -> DataFrame:
    """JOB rows for files (path, content): every file is a job of its own, and one that can't be decoded fails alone.

    A job's id is the name with a hash of the content, so a file that comes again makes the same id."""
    names = [f.split()[0] for f in JOB.split(", ")]
    chosen = settings or (PrimitiveFirst() if primitive_first else ClassifyFirst())
    label = "primitive-first" if isinstance(chosen, PrimitiveFirst) else "classify-first"

    def job(path: str, data: bytes | None) -> dict:
        started, clock = time.time(), time.perf_counter()
        name = path.rsplit("/", 1)[-1]
        sha = hashlib.sha1(data or b"").hexdigest()[:12]
        out = dict.fromkeys(names) | {"job_id": f"{name}-{sha}", "image_name": name, "input_path": path, "pipeline": label, "image_sha1_short": sha}
        try:
            svg, n = draw(data, chosen)
            out |= {"ok": True, "status": "completed", "message": f"{n} shapes", "svg_content": svg, "svg_char_length": len(svg), "svg_sha1_short": hashlib.sha1(svg.encode()).hexdigest()[:12]}
        except ValueError as e:
            out |= {"ok": False, "status": "failed", "message": "not vectorized", "error": str(e)}
        spent = time.perf_counter() - clock
        return out | {"started_at": int(started * 1e6), "finished_at": int((started + spent) * 1e6), "duration_ms": 1000 * spent}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"ok": pa.bool_(), "started_at": pa.timestamp("us", "UTC"), "finished_at": pa.timestamp("us", "UTC"), "duration_ms": pa.float64(), "svg_char_length": pa.int64()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            rows = [job(p, d) for p, d in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], schema.field(n).type) for n in names}, schema=schema)

    return files.select("path", "content").mapInArrow(run, JOB)


def start(spark: SparkSession, uploads: str, table: str, checkpoint: str, settings: Common | None = None, at_once: int = 100, once: bool = False) -> StreamingQuery:
    """Watch a folder of uploaded images and append a job for each to the Parquet table.

    The file source lists every file once, and none of zero length. A batch that runs again after a failure writes to its own folder of the
    table, over what it had written, so no job is there twice."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", at_once).load(uploads)

    def write(batch: DataFrame, number: int) -> None:
        run_jobs(batch, settings).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The last run of each job."""
    rows = spark.read.option("basePath", table).parquet(table)
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("job_id", "batch")]), F.struct("batch", "started_at")).alias("r")).select("job_id", "r.*")

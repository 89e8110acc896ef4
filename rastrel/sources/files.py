"""Files as DataFrames: images, SVG listings, JSON and JSON lines, and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id string, image struct) by Spark's image source; files that aren't images are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("image_id"), "image")


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files right in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).load(path)


def svg_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the SVG files right in a folder, whatever the case of the ending."""
    return read_binary(spark, path, "*.[sS][vV][gG]").select("path")


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One JSON value a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """All rows as JSON values, with fields that are null and letters beyond ASCII as they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_svg(documents: DataFrame, path: str, key: str = "image_id") -> None:
    """Documents (key, svg) as text in a folder a key; bytes of a row are one file's lines."""
    documents.select(F.col(key).cast("string").alias(key), F.col("svg").alias("value")).write.mode("overwrite").partitionBy(key).text(path)

"""Files as rows (name, content), in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Whole files: name, length, content. ``glob`` and ``max_bytes`` are applied before contents are read."""
    return _named(spark.read.format("binaryFile").options(**({"pathGlobFilter": glob} if glob else {})).load(path), max_bytes)


def stream_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = None, per_trigger: int = 100) -> DataFrame:
    """As binary_files, for files that arrive over time."""
    options = {"maxFilesPerTrigger": str(per_trigger)} | ({"pathGlobFilter": glob} if glob else {})
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _named(spark.readStream.format("binaryFile").schema(schema).options(**options).load(path), max_bytes)


def _named(df: DataFrame, max_bytes: int | None) -> DataFrame:
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")

"""Unbounded sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def link_stream(
    spark: SparkSession, path: str, schema: str | StructType, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of ``path`` as they arrive.

    ``max_files_per_trigger`` bounds a micro-batch: that is the backpressure.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)

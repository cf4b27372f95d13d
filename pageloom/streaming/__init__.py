"""Extraction from streams of pages: it keeps no state, so a stream's rows pass through it like a table's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.page import Page


def read_pages(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the pages in the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def extract_stream(pages: DataFrame, page: Page, html: str = "html", encoding: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Fields of each page as it arrives, for append mode; no watermark is needed."""
    return page.select(pages, html, encoding, keep)


def counts(extracted: DataFrame, time: str, field: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Pages and pages without a value for ``field`` per window of ``time``; rows later than ``late`` are dropped."""
    return extracted.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("pages"), F.count(F.when(F.col(field).isNull(), 1)).alias("missing"))

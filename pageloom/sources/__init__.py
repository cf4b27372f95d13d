"""Where pages come from: any DataFrame with a text or binary column, or folders of files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def html_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """One row per file below ``path``: path, body (binary). Files are read where they are processed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("content").alias("body"))


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """Folders ``<name>/pages/*.html`` with ``<name>/selectors.json``: pages (page_object, page, body) and selectors by page object."""
    pages = html_files(spark, path)
    parts = F.split("path", "/")
    pages = pages.where(F.element_at(parts, -2) == "pages").select(F.element_at(parts, -3).alias("page_object"), F.element_at(parts, -1).alias("page"), "body")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "selectors.json").load(path)
    schemas = files.select("path", "content").collect()  # one small file for each page object
    return pages, {r["path"].rstrip("/").split("/")[-2]: json.loads(bytes(r["content"]).decode("utf-8")) for r in sorted(schemas, key=lambda r: r["path"])}

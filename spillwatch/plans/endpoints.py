"""Endpoint scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import endpoints as e

METHOD = "GET"
REGEX_SOURCE = "Regex"


def endpoints_of(files: DataFrame) -> DataFrame:
    """``(path, method, file, source)`` without any shuffle: a path is deduped inside its own row."""
    paths = files.select("file", F.explode(e.distinct_paths(F.col("content"))).alias("path"))
    return paths.where(e.is_endpoint(F.col("path"))).select(
        "path", F.lit(METHOD).alias("method"), "file", F.lit(REGEX_SOURCE).alias("source")
    )


def scan_endpoints(files: DataFrame) -> DataFrame:
    """Endpoints quoted in each file, each path once per file."""
    return endpoints_of(files.select("file", "content"))

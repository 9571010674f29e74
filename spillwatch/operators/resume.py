"""Incremental runs: what is done, what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def non_empty_files(files: DataFrame) -> DataFrame:
    """Names of stored files with a body. A ``size`` column saves reading the texts."""
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    return files.where(size > 0).select("file")


def finished(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows ``(url, filename)`` whose file still exists and is not empty."""
    stored = non_empty_files(files).select(F.col("file").alias("filename"))
    return manifest.join(stored, "filename", "left_semi").select("url", "filename")


def pending_urls(urls: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """URLs still to fetch."""
    return urls.join(finished(manifest, files), "url", "left_anti")


def done_urls(urls: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """URLs that need no fetch, with the file they are stored in."""
    # The manifest has one row per URL, so this adds no rows.
    return urls.join(finished(manifest, files), "url")


def pending_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files without a non-empty processed copy."""
    return files.join(non_empty_files(processed), "file", "left_anti")


def only_fetched(files: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Successful fetches; a processed copy's text takes the place of the raw text."""
    fetched = files.where("fetched")
    if processed is None:
        return fetched
    copies = processed.where(F.octet_length("content") > 0).select("file", F.col("content").alias("_processed"))
    joined = fetched.join(copies, "file", "left")
    return joined.withColumn("content", F.coalesce("_processed", "content")).select(*files.columns)

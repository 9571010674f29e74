"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillwatch.operators.settle import ensure_checkpoint_dir, shared_folder
from spillwatch.shipping import ship_package

# ASCII white space of the word and line rules.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so other columns can't clash; null text is empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def prepare(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package on its Python workers."""
    ship_package(df.sparkSession)
    return df.sparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    ensure_checkpoint_dir(spark)
    base = shared_folder(spark) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: lost executors cost nothing, and it is computed once."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null is empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def partitions_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _give_back() -> None:
    """Freed memory goes back to the system; a Python worker outlives its task, and the next stage's may be others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call in this C library
        pass


def tidy(work):
    """A function over batches that leaves no freed memory with its Python worker."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run

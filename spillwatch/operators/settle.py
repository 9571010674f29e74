"""Cutting lineage where a result must stay the same while it is read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the session names for data that all executors see."""
    return spark.conf.get(CHECKPOINT_SETTING, None)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = shared_folder(spark)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so it survives lost executors unchanged."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()

"""Reliable materialisation of intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="depotcast-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder.

    Used where several branches of a plan read one small, expensive result (a
    monthly aggregate of the raw tables): the raw tables are scanned once, and a
    lost executor costs a re-read of the written result, not a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A folder below the one that the cluster shares, the same for every call with one purpose."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        ensure_checkpoint_dir(spark)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/depotcast-{purpose}"

"""Tables that cut lineage, and the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of this machine only where a session names none and is of this machine alone."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/{context.applicationId}"


def cut(rows: DataFrame) -> DataFrame:
    """rows without their lineage, from a checkpoint in the shared folder."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()

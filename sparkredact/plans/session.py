"""Runs that can be stopped and taken up again: a log of finished files, snapshots of the lookup, and their removal by age."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Session:
    """State of a run in a folder that driver and executors share. Files are told apart by path, not by position."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name, self.path = spark, root, name, f"{root}/{name}"

    def _table(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def finish(self, files: DataFrame) -> None:
        """Note the files (doc_id) that are done."""
        files.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("at", F.lit(time.time())).write.mode("append").parquet(f"{self.path}/done")

    def pending(self, files: DataFrame) -> DataFrame:
        return files.join(self._table("done", "doc_id string, at double").select(F.col("doc_id").cast(files.schema["doc_id"].dataType).alias("doc_id")).distinct(), "doc_id", "left_anti")

    def snapshot(self, lookup: DataFrame) -> None:
        """Write a new snapshot and then remove those before; a half-written one has no success mark and isn't read."""
        lookup.drop("order").write.parquet(f"{self.path}/lookup-{time.time_ns():020d}")
        for old in self._snapshots()[1:]:
            fs, path = self._fs(old)
            fs.delete(path, True)

    def restore(self) -> DataFrame | None:
        """The last whole snapshot."""
        found = self._snapshots()
        return self.spark.read.parquet(found[0]) if found else None

    def _snapshots(self) -> list[str]:
        """Whole snapshots, newest first."""
        fs, path = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [f"{self.path}/{n}" for n in sorted(names, reverse=True) if n.startswith("lookup-") and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1])]

    def _fs(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def delete(self) -> None:
        fs, path = self._fs(self.path)
        fs.delete(path, True)


def sessions(spark: SparkSession, root: str) -> list[tuple[str, float]]:
    """Names and times of the last change, newest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(found, key=lambda x: -x[1])


def clean_up(spark: SparkSession, root: str, max_age_days: float) -> list[str]:
    """Delete sessions older than that; their names."""
    old = [name for name, at in sessions(spark, root) if at < time.time() - max_age_days * 86400]
    for name in old:
        Session(spark, root, name).delete()
    return old

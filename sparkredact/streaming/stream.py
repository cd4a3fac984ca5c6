"""Redacting a stream of documents, with one lookup that is carried on from batch to batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, replay
from ..operators.segments import segments_of_texts

KEPT = "norm_key string, original_term string, anonymised_term string, pii_category string, first_seen_doc string, first_seen_line int, is_alias boolean, n long"


class CarriedLookup:
    """A lookup as a folder of one Parquet table for each batch. Writing a batch again replaces it, so retries change nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def before(self, batch: int) -> DataFrame:
        """Entries of the batches before one."""
        try:
            rows = self.spark.read.parquet(self.path)
        except Exception:  # noqa: BLE001  nothing written yet
            return self.spark.createDataFrame([], KEPT)
        return rows.filter(F.col("batch") < batch).drop("batch")

    def all(self) -> DataFrame:
        return self.before(2**31 - 1)

    def add(self, found: DataFrame, batch: int) -> DataFrame:
        """Give tags to the new keys among detections and keep them; all entries that the batch may use."""
        known = self.before(batch)
        counters = known.filter("NOT is_alias").groupBy("pii_category").agg(F.max("n").alias("n")).withColumnRenamed("pii_category", "category")
        fresh = lookup.assign_tags(found.withColumn("doc_no", F.col("doc_id").cast("long")), "persist", "doc_no", counters, known)
        number = F.regexp_extract("anonymised_term", r"(\d+)\]$", 1).cast("long")
        fresh = fresh.select("norm_key", "original_term", "anonymised_term", "pii_category", "first_seen_doc", F.col("first_seen_line").cast("int").alias("first_seen_line"), "is_alias", number.alias("n"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return known.unionByName(self.spark.read.schema(KEPT).parquet(f"{self.path}/batch={batch}"))


def redact_batch(docs: DataFrame, batch: int, detect: Callable[[DataFrame], DataFrame], carried: CarriedLookup) -> DataFrame:
    """docs (doc_id, text) of one batch with ``redacted``."""
    found = detect(segments_of_texts(docs))
    table = carried.add(found, batch).withColumn("scope", F.lit("all"))
    seen = found.select("doc_id", F.col("original").alias("form")).distinct().withColumn("norm_key", lookup.T.normalize_key("form"))
    forms = seen.join(table.select("norm_key", F.col("anonymised_term").alias("tag")), "norm_key").select(F.col("doc_id").alias("scope"), "form", "tag")
    return replay.redact_texts(docs, forms)


def redact_stream(stream: DataFrame, detect: Callable[[DataFrame], DataFrame], lookup_path: str, out: str, checkpoint: str, **options: str):
    """Start a query that redacts a stream of (doc_id, text) into Parquet under ``out``, a folder for each batch."""
    carried = CarriedLookup(stream.sparkSession, lookup_path)

    def one(docs: DataFrame, batch: int) -> None:
        docs.persist()
        try:
            redact_batch(docs, batch, detect, carried).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        finally:
            docs.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).options(**options).start()

"""A change log applied as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.store import Store

CHANGES = "idx long, type string, key binary, value binary, timestamp long"


def read_changes(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """SET and DELETE commands from a growing folder of Parquet files."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_at_once).parquet(path)


def apply_changes(changes: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each batch becomes one manifest; a batch that comes again finds its versions there and upserts
    them with the same (key, ts, seq)."""

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col("type").isin("SET", "DELETE")).select("key", F.col("timestamp").alias("ts"), (F.col("type") == "SET").alias("live"), F.when(F.col("type") == "SET", F.col("value")).alias("value"), F.col("idx").alias("seq"))
        newest = rows.agg(F.max("ts")).first()[0]
        if newest is not None:
            # a write record each, so that transactions which read these keys see the change
            records = rows.select("key", F.col("ts").alias("commit_ts"), F.col("ts").alias("start_ts"))
            store.update(lambda base: {"add": {"versions": rows, "write_records": records}, "clock": newest})

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def windowed_counts(changes: DataFrame, width_us: int, late: str = "10 minutes") -> DataFrame:
    """Commands per key and window of log time, with a watermark for late ones."""
    timed = changes.withColumn("at", F.timestamp_micros("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", f"{width_us} microseconds"), "key").agg(F.count("*").alias("commands"))

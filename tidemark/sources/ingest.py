"""Versions, write records, locks and key tables out of ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def versions_of(df: DataFrame, key: Column, ts: Column, value: Column, live: Column | None = None, seq: Column | None = None) -> DataFrame:
    """key, ts, live, value and seq; seq orders writers of the same (key, ts), the last one wins."""
    return df.select(key.alias("key"), ts.cast("long").alias("ts"), (F.lit(True) if live is None else live).alias("live"), value.alias("value"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"))


def event_versions(spark: SparkSession, directory: str) -> DataFrame:
    """One version per event: key users:<user_id>; an event of type error is a deletion."""
    e = table(spark, directory, "events")
    return versions_of(e, F.concat(F.lit("users:"), F.col("user_id").cast("string")), micros(F.col("ts")), F.col("value").cast("string"), F.col("event_type") != "error", F.col("event_id"))


def keyed(df: DataFrame, prefix: str, id_col: str, *columns: str) -> DataFrame:
    """key "<prefix>:<id>" before the named columns."""
    return df.select(F.concat(F.lit(f"{prefix}:"), F.col(id_col).cast("string")).alias("key"), *columns)

"""Reads of the versions relation: as of a timestamp, in ranges, and under locks.

All are plain aggregates and joins on the key, so Spark pre-aggregates before its one shuffle, prunes
columns, and pushes key and timestamp bounds to the scan. Ranges are half-open, in byte order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.keys import in_range
from tidemark.model import KeyLocked


def upserted(versions: DataFrame) -> DataFrame:
    """One row per (key, ts): of several, the one written last."""
    newest = F.max_by(F.struct("live", "value"), "seq").alias("m")
    return versions.groupBy("key", "ts").agg(newest).select("key", "ts", "m.live", "m.value")


def newest_versions(versions: DataFrame, at: int | None = None) -> DataFrame:
    """key, value, live, commit_ts of each key's newest version at or before `at`, tombstones too."""
    seen = versions if at is None else versions.where(F.col("ts") <= at)
    order = F.struct("ts", "seq") if "seq" in versions.columns else F.col("ts")
    newest = seen.groupBy("key").agg(F.max_by(F.struct("value", "live"), order).alias("m"), F.max("ts").alias("commit_ts"))
    return newest.select("key", "m.value", "m.live", "commit_ts")


def scan(versions: DataFrame, start=None, end=None, at: int | None = None, ordered: bool = False) -> DataFrame:
    """key, value, commit_ts of the live keys of [start, end) as of `at`."""
    found = newest_versions(versions.where(in_range(F.col("key"), start, end)), at).where("live").select("key", "value", "commit_ts")
    return found.orderBy("key") if ordered else found


def get(versions: DataFrame, key, at: int | None = None) -> DataFrame:
    """At most one row: the value of a key as of `at`."""
    return newest_versions(versions.where(F.col("key") == F.lit(key)), at).where("live").select("key", "value", "commit_ts")


def history(versions: DataFrame) -> DataFrame:
    """Each version with the timestamps [ts, until) at which it is the newest one."""
    after = F.lead("ts").over(Window.partitionBy("key").orderBy("ts"))
    return upserted(versions).withColumn("until", after).select("key", "ts", "until", "live", "value")


def collectable(versions: DataFrame, watermark: int) -> DataFrame:
    """Versions that no reader at or after the watermark can see: superseded by it, or deletions."""
    rows = history(versions)
    return rows.where((F.col("until") <= watermark) | (~F.col("live") & F.col("until").isNull() & (F.col("ts") <= watermark))).select("key", "ts", "live")


def newest_writes(write_records: DataFrame) -> DataFrame:
    """Each key's newest commit and the transaction it came from."""
    return write_records.groupBy("key").agg(F.max_by("start_ts", "commit_ts").alias("start_ts"), F.max("commit_ts").alias("commit_ts"))


def newest_locks(locks: DataFrame) -> DataFrame:
    """Each key's lock with the largest start_ts."""
    rest = [c for c in locks.columns if c not in ("key", "start_ts")]
    found = locks.groupBy("key").agg(F.max_by(F.struct(*rest), "start_ts").alias("m"), F.max("start_ts").alias("start_ts"))
    return found.select("key", "start_ts", *[F.col(f"m.{c}") for c in rest])


def blocking_locks(locks: DataFrame, start=None, end=None, at: int | None = None) -> DataFrame:
    """Locks of the range that a reader at `at` (None: at the newest) has to wait for."""
    found = locks.where(in_range(F.col("key"), start, end) & (F.col("status") == "LOCKED"))
    return found if at is None else found.where(F.col("start_ts") < at)


def read_with_locks(versions: DataFrame, locks: DataFrame, at: int, start=None, end=None) -> DataFrame:
    """key, value, commit_ts and state of every key a reader at `at` meets: own (its own intent, version
    0), blocked (an older lock), or committed. Every lock counts, not the newest alone."""
    held = locks.where(in_range(F.col("key"), start, end) & (F.col("status") == "LOCKED") & (F.col("start_ts") <= at))
    intents = held.groupBy("key").agg(F.max(F.col("start_ts") < at).alias("blocked"), F.max_by("value", F.when(F.col("start_ts") == at, F.col("start_ts"))).alias("intent"), F.max(F.col("start_ts") == at).alias("own"))
    rows = scan(versions, start, end, at).join(intents, "key", "full_outer")
    state = F.when(F.col("blocked"), "blocked").when(F.col("own"), "own").otherwise("committed")
    value = F.when(state == "own", F.col("intent")).when(state == "committed", F.col("value"))
    return rows.select("key", value.alias("value"), F.when(state == "committed", F.col("commit_ts")).otherwise(F.lit(0)).cast("long").alias("commit_ts"), state.alias("state"))


def scan_or_refuse(versions: DataFrame, locks: DataFrame, start=None, end=None, at: int | None = None) -> DataFrame:
    """The range's rows, or KeyLocked: an empty result always means an empty range."""
    blocked = blocking_locks(locks, start, end, at).select("key").orderBy("key").head(1)
    if blocked:
        key = blocked[0].key
        raise KeyLocked(bytes(key) if not isinstance(key, str) else key.encode())
    if at is None:
        return scan(versions, start, end, ordered=True)
    return read_with_locks(versions, locks, at, start, end).where("value is not null").select("key", "value", "commit_ts").orderBy("key")

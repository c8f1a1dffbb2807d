"""Two-phase commit over sets of keys.

Each operator judges a whole batch by joins on the key and returns one row per request with a result
code, so a batch is one job whatever its size. A batch must not name a (key, start_ts) twice; logs
whose commands depend on each other go through `operators.log`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import model as M
from tidemark.functions.keys import in_range
from tidemark.operators.read import newest_locks, newest_versions, newest_writes


def code(*cases: tuple[Column, int]) -> Column:
    found = F.lit(None).cast("int")
    for condition, value in reversed(cases):
        found = F.when(condition, F.lit(value)).otherwise(found)
    return F.coalesce(found, F.lit(M.OK)).alias("code")


def prewrite_codes(writes: DataFrame, locks: DataFrame, write_records: DataFrame, versions: DataFrame) -> DataFrame:
    """key, start_ts, code of each wanted lock: 101 where the key's newest lock is held, 102 where a
    newer commit or version (a deletion too) exists."""
    keys = writes.select("key").distinct()
    of_keys = lambda rows: rows.join(keys, "key", "left_semi")  # noqa: E731  before the aggregates, which then see the batch's keys only
    held = newest_locks(of_keys(locks)).select("key", (F.col("status") == "LOCKED").alias("held"))
    committed = newest_writes(of_keys(write_records)).select("key", F.col("commit_ts").alias("written"))
    version = newest_versions(of_keys(versions)).select("key", F.col("commit_ts").alias("version"))
    rows = writes.join(held, "key", "left").join(committed, "key", "left").join(version, "key", "left")
    newer = F.coalesce(F.greatest("written", "version") > F.col("start_ts"), F.lit(False))
    first = F.coalesce(F.col("first") == F.col("start_ts"), F.lit(True)) if "first" in writes.columns else F.lit(True)
    return rows.select("key", "start_ts", code((F.coalesce("held", F.lit(False)), M.LOCKED), (newer, M.WRITE_CONFLICT), (~first, M.LOCKED)))


def first_of_key(writes: DataFrame) -> DataFrame:
    """The batch's writes with the oldest transaction that wants each key; the others find it locked."""
    return writes.select("key", "start_ts").join(writes.groupBy("key").agg(F.min("start_ts").alias("first")), "key")


def all_granted(codes: DataFrame) -> DataFrame:
    """Per transaction, whether each of its locks was granted."""
    return codes.groupBy("start_ts").agg(F.every(F.col("code") == M.OK).alias("granted"))


def commit_codes(commits: DataFrame, locks: DataFrame) -> DataFrame:
    """key, start_ts, commit_ts, code: 201 where the key has no lock, 202 where only others have, 203
    where the lock isn't held."""
    locks = locks.join(commits.select("key").distinct(), "key", "left_semi")
    own = locks.select("key", "start_ts", "status", F.lit(True).alias("own"))
    any_lock = locks.groupBy("key").agg(F.lit(True).alias("any"))
    rows = commits.join(own, ["key", "start_ts"], "left").join(any_lock, "key", "left")
    return rows.select("key", "start_ts", "commit_ts", code((F.col("own") & (F.col("status") != "LOCKED"), M.LOCK_STATUS_INVALID), (F.col("own"), M.OK), (F.col("any"), M.TIMESTAMP_MISMATCH), (F.lit(True), M.NO_LOCK)))


def committed(commits: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New versions, new write records, and the locks that stay, of the commits that succeed."""
    good = commit_codes(commits, locks).where(F.col("code") == M.OK).select("key", "start_ts", "commit_ts")
    rows = locks.join(good, ["key", "start_ts"])
    live = F.col("live") if "live" in locks.columns else F.lit(True)
    versions = rows.select("key", F.col("commit_ts").alias("ts"), live.alias("live"), "value")
    return versions, good.select("key", "commit_ts", "start_ts"), locks.join(good.select("key", "start_ts"), ["key", "start_ts"], "left_anti")


def rollback_codes(rollbacks: DataFrame, locks: DataFrame) -> DataFrame:
    """key, start_ts, code: success without any lock on the key, 202 where only others have one."""
    locks = locks.join(rollbacks.select("key").distinct(), "key", "left_semi")
    own = locks.select("key", "start_ts", F.lit(True).alias("own"))
    any_lock = locks.groupBy("key").agg(F.lit(True).alias("any"))
    rows = rollbacks.join(own, ["key", "start_ts"], "left").join(any_lock, "key", "left")
    return rows.select("key", "start_ts", code((F.col("own"), M.OK), (F.col("any"), M.TIMESTAMP_MISMATCH)))


def rolled_back(locks: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """The locks left."""
    return locks.join(rollbacks.select("key", "start_ts").distinct(), ["key", "start_ts"], "left_anti")


def cleaned(locks: DataFrame, requests: DataFrame) -> DataFrame:
    """Locks left after each request removed its key's newest lock: whichever it is, or only that of
    the named start_ts (null: any)."""
    newest = locks.join(requests.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("start_ts").alias("start_ts"))
    gone = newest.join(requests.select("key", F.col("start_ts").alias("named")), "key").where("named is null or named = start_ts")
    return rolled_back(locks, gone)


def stale_reads(reads: DataFrame, write_records: DataFrame) -> DataFrame:
    """Reads (start_ts, key) whose key was committed by somebody after the reader's start."""
    newest = write_records.join(reads.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))
    return reads.join(newest, "key").where(F.col("commit_ts") > F.col("start_ts")).select("start_ts", "key", "commit_ts")


def write_skew(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Pairs of overlapping transactions (start_ts < other's commit_ts, both ways) of which each wrote a
    key that the other read: other_ts is the later start."""
    r = reads.select("key", F.col("start_ts").alias("reader"), F.col("commit_ts").alias("reader_end"))
    w = writes.select("key", F.col("start_ts").alias("writer"), F.col("commit_ts").alias("writer_end"))
    over = r.join(w, "key").where("reader <> writer and reader < writer_end and writer < reader_end").select("reader", "writer").distinct()
    back = over.select(F.col("writer").alias("reader"), F.col("reader").alias("writer"))
    return over.intersect(back).where("reader < writer").select(F.col("reader").alias("start_ts"), F.col("writer").alias("other_ts"))


def lock_fates(locks: DataFrame, write_records: DataFrame, now: float, ttl: float = 5.0) -> DataFrame:
    """key, start_ts, status and commit_ts: COMMITTED where the primary key has a write record of the
    transaction (any, not the newest alone), PENDING while the primary's lock is within its time to
    live, else ABORTED."""
    primary = write_records.select(F.col("key").alias("primary_key"), "start_ts", "commit_ts")
    alive = locks.where((F.col("key") == F.col("primary_key")) & (F.col("status") == "LOCKED") & (F.lit(float(now)) - F.col("lock_time") < ttl)).select("primary_key", "start_ts", F.lit(True).alias("alive"))
    rows = locks.where(F.col("status") == "LOCKED").join(primary, ["primary_key", "start_ts"], "left").join(alive, ["primary_key", "start_ts"], "left")
    status = F.when(F.col("commit_ts").isNotNull(), "COMMITTED").when(F.col("alive"), "PENDING").otherwise("ABORTED")
    return rows.select("key", "start_ts", status.alias("status"), "commit_ts")


def resolved(locks: DataFrame, write_records: DataFrame, now: float, ttl: float = 5.0, start=None, end=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Locks of [start, end) of committed transactions rolled forward, of dead ones cleared: new versions,
    new write records, locks left."""
    fates = lock_fates(locks, write_records, now, ttl).where(in_range(F.col("key"), start, end))
    versions, records, _ = committed(fates.where("status = 'COMMITTED'").select("key", "start_ts", "commit_ts"), locks)
    return versions, records, rolled_back(locks, fates.where("status <> 'PENDING'"))


def expired_locks(locks: DataFrame, now: float, ttl: float = 5.0) -> DataFrame:
    """Held locks whose time to live is over at `now`."""
    return locks.where((F.col("status") == "LOCKED") & (F.lit(float(now)) - F.col("lock_time") >= ttl))


def allocated(requests: DataFrame, start: int = 0) -> DataFrame:
    """request, first_ts, last_ts: consecutive runs of timestamps in order of the requests' numbers.

    Prefix sums in two levels: runs within ranges of requests, and offsets of the ranges.
    """
    width = 1 << 16
    part = (F.col("request") / width).cast("long")
    rows = requests.select("request", "batch", F.floor(part).alias("part"))
    within = rows.withColumn("upto", F.sum("batch").over(Window.partitionBy("part").orderBy("request")))
    totals = rows.groupBy("part").agg(F.sum("batch").alias("total"))
    offsets = totals.withColumn("before", F.sum("total").over(Window.orderBy("part")) - F.col("total")).select("part", "before")
    upto = F.col("before") + F.col("upto") + start
    return within.join(offsets, "part").select("request", (upto - F.col("batch") + 1).alias("first_ts"), upto.alias("last_ts"))

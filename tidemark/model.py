"""The four relations, result codes and refusals."""

from __future__ import annotations

from pyspark.sql import types as T

VERSIONS = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("ts", T.LongType()), T.StructField("live", T.BooleanType()),
    T.StructField("value", T.BinaryType()), T.StructField("seq", T.LongType()),
])
WRITE_RECORDS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("commit_ts", T.LongType()), T.StructField("start_ts", T.LongType())])
LOCKS = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("start_ts", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("primary_key", T.BinaryType()), T.StructField("lock_time", T.DoubleType()), T.StructField("value", T.BinaryType()), T.StructField("live", T.BooleanType()),
])
SHARDS = T.StructType([
    T.StructField("shard_id", T.IntegerType()), T.StructField("start_key", T.BinaryType()), T.StructField("end_key", T.BinaryType()),
    T.StructField("nodes", T.ArrayType(T.IntegerType())), T.StructField("addresses", T.MapType(T.IntegerType(), T.StringType())),
    T.StructField("leader_id", T.IntegerType()), T.StructField("leader_term", T.LongType()),
])

# Result codes; fixed values.
OK = 0
UNKNOWN = 1
APPLY_ERROR = 2
LOCKED = 101
WRITE_CONFLICT = 102
NO_LOCK = 201
TIMESTAMP_MISMATCH = 202
LOCK_STATUS_INVALID = 203
NOT_LEADER = 301
LEADERSHIP_LOST = 302
TIMEOUT = 303
ENTRY_OVERWRITTEN = 304
SPLIT_IN_PROGRESS = 305
MIGRATING = 306
ROUTES_EXIST, NO_SHARD, NODE_NOT_SERVING, STALE_LEADER = 3, 4, 5, 6
SPLIT_NO_SHARD, SPLIT_OUTSIDE, SPLIT_ID_TAKEN, SPLIT_OTHER_NODES, SPLIT_OVERLAP = 7, 8, 9, 10, 11
MOVE_NO_SHARD, MOVE_BAD_NODES, MOVE_STALE, MOVE_OVERLAP, MOVE_OTHER_ADDRESSES = 12, 13, 14, 15, 16


class Refused(RuntimeError):
    """An operation that would have to guess; code says why, key names what is in the way."""

    def __init__(self, code: int, message: str, key: bytes | None = None):
        super().__init__(message)
        self.code, self.key = code, key


class KeyLocked(Refused):
    def __init__(self, key: bytes):
        super().__init__(LOCKED, f"{key!r} is locked by another transaction", key)


class Conflict(Refused):
    """A transaction that lost: start over with a newer timestamp."""

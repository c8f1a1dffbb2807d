"""Applying a log of commands.

A log of plain writes is an aggregate. A log with locks and commits depends on order, but a command
reads and writes its own key alone, so each key's commands are folded by themselves in log order; one
key's commands are streamed in sorted batches and only its state is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark import model as M

COMMANDS = "idx long, type string, key binary, value binary, timestamp long, start_ts long, commit_ts long, primary_key binary, lock_time double"
RESULTS = "kind string, key binary, ts long, start_ts long, live boolean, value binary, status string, primary_key binary, lock_time double, idx long, code int"


#: Commands that write what no lock holds yet; a shard that is split or moved refuses them.
DATA_COMMANDS = ("SET", "DELETE", "PREWRITE")


def writes_new_data(type_: Column) -> Column:
    """Whether a command is one of these; one whose type can't be read counts as one."""
    return F.coalesce(type_.isin(*DATA_COMMANDS), F.lit(True))


def to_lines(log: DataFrame) -> DataFrame:
    """Commands as lines of JSON, their bytes in base64, in a column value (of text sinks)."""
    return log.select(F.to_json(F.struct(*[F.base64(f.name).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f.name) for f in log.schema])).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Commands of such lines; of one that isn't a command all fields are null."""
    plain = COMMANDS.replace("binary", "string")
    rows = lines.select(F.from_json("value", plain).alias("c")).select("c.*")
    return rows.select(*[F.unbase64(n).alias(n) if kind == "binary" else F.col(n) for n, kind in (field.strip().split(" ") for field in COMMANDS.split(","))])


def apply_writes(log: DataFrame) -> DataFrame:
    """Versions after a log of SET and DELETE commands (idx, type, key, value, timestamp): of several at
    one (key, timestamp) the last one holds."""
    writes = log.where(F.col("type").isin("SET", "DELETE")).select("key", F.col("timestamp").alias("ts"), (F.col("type") == "SET").alias("live"), F.when(F.col("type") == "SET", F.col("value")).alias("value"), "idx")
    return writes.groupBy("key", "ts").agg(F.max_by(F.struct("live", "value"), "idx").alias("m")).select("key", "ts", "m.live", "m.value")


class KeyState:
    """Versions, write records and locks of one key."""

    def __init__(self) -> None:
        self.versions: dict[int, tuple[bool, bytes | None]] = {}
        self.writes: dict[int, int] = {}
        self.locks: dict[int, dict] = {}

    def apply(self, c: dict) -> int:
        kind, start = c["type"], c["start_ts"]
        if kind in ("SET", "DELETE"):
            self.versions[c["timestamp"]] = (kind == "SET", c["value"] if kind == "SET" else None)
            if kind == "SET" and start is not None:
                self.writes[c["timestamp"]] = start
            return M.OK
        newest = max(self.locks, default=None)
        if kind == "PREWRITE":
            if newest is not None and self.locks[newest]["status"] == "LOCKED":
                return M.LOCKED
            if max(self.writes, default=-1) > start or max(self.versions, default=-1) > start:
                return M.WRITE_CONFLICT
            self.locks[start] = {"status": "LOCKED", "value": c["value"], "primary_key": c["primary_key"], "lock_time": c["lock_time"]}
            return M.OK
        if kind == "COMMIT":
            if not self.locks:
                return M.NO_LOCK
            if start not in self.locks:
                return M.TIMESTAMP_MISMATCH
            if self.locks[start]["status"] != "LOCKED":
                return M.LOCK_STATUS_INVALID
            lock = self.locks.pop(start)
            self.versions[c["commit_ts"]] = (lock["value"] is not None, lock["value"])
            self.writes[c["commit_ts"]] = start
            return M.OK
        if kind == "ROLLBACK":
            if self.locks and start not in self.locks:
                return M.TIMESTAMP_MISMATCH
            self.locks.pop(start, None)
            return M.OK
        if kind == "CLEAN_LOCK":
            if newest is not None and start in (None, newest):
                del self.locks[newest]
            return M.OK
        return M.UNKNOWN


_ARROW = pa.schema([
    ("kind", pa.string()), ("key", pa.binary()), ("ts", pa.int64()), ("start_ts", pa.int64()), ("live", pa.bool_()), ("value", pa.binary()),
    ("status", pa.string()), ("primary_key", pa.binary()), ("lock_time", pa.float64()), ("idx", pa.int64()), ("code", pa.int32()),
])


def _left(key, state: KeyState) -> list[dict]:
    rows = [{"kind": "version", "key": key, "ts": t, "live": live, "value": v} for t, (live, v) in state.versions.items()]
    rows += [{"kind": "write", "key": key, "ts": t, "start_ts": s} for t, s in state.writes.items()]
    return rows + [{"kind": "lock", "key": key, "start_ts": s} | lock for s, lock in state.locks.items()]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Commands by key and log order; the state of one key is held at a time."""
    state, key = KeyState(), None
    for batch in batches:
        rows = []
        for c in batch.to_pylist():
            if c["key"] != key:
                rows += _left(key, state)
                state, key = KeyState(), c["key"]
            rows.append({"kind": "result", "key": key, "idx": c["idx"], "code": state.apply(c)})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    yield pa.RecordBatch.from_pylist(_left(key, state), schema=_ARROW)


def apply_log(log: DataFrame) -> DataFrame:
    """Outcome of a whole log: a row per command (kind result, with idx and code), and the versions,
    write records and locks it leaves (kinds version, write, lock)."""
    return log.repartition("key").sortWithinPartitions("key", "idx").mapInArrow(_fold, RESULTS)

"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that the session was given; only in a local session without
    either, as in tests, a folder of our own. Executors elsewhere could not read such a one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(df: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """df written to and read from the shared folder: its lineage is cut, so a lost executor costs a
    read and not what came before. onto: a table made here, which df is added to."""
    spark = df.sparkSession
    path = _paths[onto] if onto is not None else f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    # the codec of Spark's default works in direct buffers, which pile up beside the heap until it is collected
    df.write.mode("append").option("compression", "zstd").parquet(path)
    if onto is None:
        _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made here that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            dropped(table.sparkSession, path)
            _made[:] = [m for m in _made if m[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        dropped(spark, path)

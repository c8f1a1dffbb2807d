"""Whole-relation writes: upserts, deletions, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.keys import in_range


def last_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the largest by `order`, which must tell any two rows apart."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m"))
    return found.select(*keys, *[F.col(f"m.{c}") for c in rest])


def without_keys(df: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    """Physical deletion of a set of keys."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def without_range(df: DataFrame, start, end, key: str = "key") -> DataFrame:
    """Physical deletion of [start, end)."""
    return df.where(~in_range(F.col(key), start, end))

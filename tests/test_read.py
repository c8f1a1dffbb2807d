"""Snapshot reads, ranges and locks on literal rows."""

import pytest

from tidemark.functions import keys as K
from tidemark.model import KeyLocked
from tidemark.operators import read as R

V = "key string, ts long, live boolean, value string, seq long"
L = "key string, start_ts long, status string, primary_key string, lock_time double, value string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def versions(spark, *given):
    return spark.createDataFrame([(k, t, v is not None, v, i) for i, (k, t, v) in enumerate(given)], V)


def test_point_reads_as_of_each_timestamp(spark):
    v = versions(spark, ("key", 1, "v1"), ("key", 2, "v2"), ("key", 3, "v3"))
    for at, want in ((0, []), (1, ["v1"]), (2, ["v2"]), (3, ["v3"]), (10, ["v3"])):
        assert [r.value for r in R.get(v, "key", at).collect()] == want
    assert rows(R.newest_versions(v)) == [("key", "v3", True, 3)]


def test_a_tombstone_hides_older_versions_and_is_no_row(spark):
    v = versions(spark, ("key", 1, "value"), ("key", 3, None))
    assert [r.value for r in R.get(v, "key", 2).collect()] == ["value"]
    assert R.get(v, "key", 3).collect() == R.scan(v, "a", "z", 10).collect() == []
    assert rows(R.newest_versions(v)) == [("key", None, False, 3)]


def test_ranges_are_half_open_and_ordered(spark):
    v = versions(spark, *[(k, i + 1, str(i + 1)) for i, k in enumerate("abcd")])
    assert [tuple(r) for r in R.scan(v, "a", "c", 4, ordered=True).collect()] == [("a", "1", 1), ("b", "2", 2)]
    assert rows(R.scan(v, "a", "c", 1)) == [("a", "1", 1)]
    assert R.scan(v, "z", None).collect() == []


def test_snapshots_of_a_range(spark):
    v = versions(spark, ("scan_a", 100, "a1"), ("scan_a", 200, "a2"), ("scan_b", 200, "b1"), ("scan_c", 300, "c1"))
    for at, want in ((99, []), (199, ["a1"]), (200, ["a2", "b1"]), (299, ["a2", "b1"]), (300, ["a2", "b1", "c1"]), (None, ["a2", "b1", "c1"])):
        assert [r.value for r in R.scan(v, "scan_", "scanz", at, ordered=True).collect()] == want


def test_the_last_writer_of_a_version_wins(spark):
    v = versions(spark, ("k", 5, "old"), ("k", 5, "new"))
    assert rows(R.upserted(v)) == [("k", 5, True, "new")]
    assert rows(R.scan(v)) == [("k", "new", 5)]


def test_byte_order_of_binary_keys(spark):
    given = [b"b", b"a", b"c", b"a\x01", b"\xfe", b"a\xff"]
    df = spark.createDataFrame([(bytearray(k), 1, True, bytearray(b""), 0) for k in given], "key binary, ts long, live boolean, value binary, seq long")
    assert [bytes(r.key) for r in R.scan(df, ordered=True).collect()] == sorted(given)
    assert [bytes(r.key) for r in R.scan(df, b"a", b"c", ordered=True).collect()] == [b"a", b"a\x01", b"a\xff", b"b"]
    assert {bytes(r.value) for r in R.scan(df).collect()} == {b""}


def lock(spark, *given):
    return spark.createDataFrame([(k, t, "LOCKED", k, 0.0, v) for k, t, v in given], L)


def test_locks_block_or_show_their_own_value(spark):
    v = versions(spark, ("k1", 10, "v1"), ("k2", 10, "v2"))
    locks = lock(spark, ("k1", 20, "v3"))
    for at in (25, None):
        with pytest.raises(KeyLocked) as e:
            R.scan_or_refuse(v, locks, "k", "l", at)
        assert e.value.key == b"k1"
    assert [r.value for r in R.scan_or_refuse(v, locks, "k", "l", 15).collect()] == ["v1", "v2"]
    assert [(r.value, r.commit_ts) for r in R.scan_or_refuse(v, locks, "k", "l", 20).collect()] == [("v3", 0), ("v2", 10)]


def test_every_lock_of_a_key_counts(spark):
    v = versions(spark, ("k", 1, "v"))
    locks = lock(spark, ("k", 5, "a"), ("k", 9, "b"))
    assert rows(R.read_with_locks(v, locks, 9)) == [("k", None, 0, "blocked")]
    assert rows(R.read_with_locks(v, locks, 3)) == [("k", "v", 1, "committed")]


def test_history_and_garbage(spark):
    v = versions(spark, ("a", 1, "x"), ("a", 4, "y"), ("b", 2, "z"), ("b", 3, None))
    assert rows(R.history(v)) == [("a", 1, 4, True, "x"), ("a", 4, None, True, "y"), ("b", 2, 3, True, "z"), ("b", 3, None, False, None)]
    assert rows(R.collectable(v, 4)) == [("a", 1, True), ("b", 2, True), ("b", 3, False)]
    assert rows(R.collectable(v, 3)) == [("b", 2, True), ("b", 3, False)]


def test_empty_relations(spark):
    v, locks = versions(spark).limit(0), lock(spark).limit(0)
    assert R.scan(v).collect() == R.history(v).collect() == R.newest_locks(locks).collect() == R.read_with_locks(v, locks, 5).collect() == []


def test_keys():
    assert K.successor(b"abc") == b"abd" and K.successor(b"a\xff") == b"b" and K.successor(b"\xff") is None
    for bad, error in ((b"a\x00b", ValueError), ("text", TypeError)):
        with pytest.raises(error):
            K.check_key(bad)
    assert K.clip(b"", None, b"c", b"f") == (b"c", b"f") and K.clip(b"d", b"e", b"c", None) == (b"d", b"e")


def test_checked_keys_and_row_fields(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"a"),)], "key binary")
    assert df.select(K.checked(F.col("key"))).first()[0] == b"a"
    with pytest.raises(Exception, match="zero byte"):
        spark.createDataFrame([(bytearray(b"a\x00b"),)], "key binary").select(K.checked(F.col("key"))).collect()
    rows_ = spark.createDataFrame([(bytearray(b'{"name": "x", "id": 7}'),), (bytearray(b"plain"),)], "value binary")
    got = [tuple(r) for r in rows_.select(K.row_field(F.col("value"), "name"), K.row_field(F.col("value"), "id")).collect()]
    assert got == [("x", "7"), (None, "plain")]


def test_range_bounds_reach_the_scan(spark, tmp_path):
    versions(spark, ("a", 1, "x"), ("b", 2, "y")).write.parquet(str(tmp_path / "v"))
    plan = R.scan(spark.read.parquet(str(tmp_path / "v")), "a", "b", 5)._jdf.queryExecution().executedPlan().toString()
    for bound in ("GreaterThanOrEqual(key,a)", "LessThan(key,b)", "LessThanOrEqual(ts,5)"):
        assert bound in plan

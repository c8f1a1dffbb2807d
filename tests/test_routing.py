"""Ranges of keys and changes of their table."""

import random

from tidemark.operators import routing as S


def expected(key, ranges):
    return next((i for i, (a, b) in sorted(ranges.items(), key=lambda r: r[1][0]) if a <= key and (b is None or key < b)), 0)


def test_default_ranges():
    assert S.default_range_map(1) == {0: (b"", b"\xff")}
    assert S.default_range_map(2) == {0: (b"\x00", b"\x80"), 1: (b"\x80", b"\xff")}


def test_every_way_to_locate_agrees(spark):
    pick = random.Random(20)
    keys = [b"", b"\x00", b"\x01\x00", b"harbour:7", b"~", b"\x7f\xff", b"\x80", b"\x80harbour:8", b"\xc3\xa9", b"\xfe\xff", b"\xff"] + [bytes(pick.randrange(256) for _ in range(pick.randint(1, 8))) for _ in range(100)]
    df = spark.createDataFrame([(bytearray(k),) for k in dict.fromkeys(keys)], "key binary")
    for n in (1, 2, 7, 100):
        ranges = S.default_range_map(n)
        want = {k: expected(k, ranges) for k in keys}
        assert {bytes(r.key): r.shard_id for r in S.locate(df, S.shard_rows(spark, ranges)).collect()} == want
    most, S.MOST_RANGES = S.MOST_RANGES, 65
    try:
        assert {bytes(r.key): r.shard_id for r in S.locate(df, S.shard_rows(spark, S.default_range_map(100))).collect()} == want
    finally:
        S.MOST_RANGES = most


def test_keys_outside_every_range_go_to_shard_zero(spark):
    df = spark.createDataFrame([("zz",), ("b",), ("n",)], "key string")
    shards = spark.createDataFrame([(5, "a", "n"), (6, "n", "z")], "shard_id int, start_key string, end_key string")
    assert {r.key: r.shard_id for r in S.locate(df, shards).collect()} == {"zz": 0, "b": 5, "n": 6}


def test_coverage_and_split(spark):
    shards = spark.createDataFrame([(0, "", "g"), (1, "g", None)], "shard_id int, start_key string, end_key string")
    assert S.coverage_gaps(shards.where("shard_id = 0"), "", "z").collect()[0].asDict() == {"gap_start": "g", "gap_end": "z"}
    rows = spark.createDataFrame([("a", 0), ("f", 0), ("h", 1)], "key string, shard_id int")
    assert {r.key: r.shard_id for r in S.split_rows(rows, 0, "c", 2).collect()} == {"a": 0, "f": 2, "h": 1}
    assert S.missing_rows(spark.createDataFrame([("a", 1), ("a", 2)], "key string, ts long"), spark.createDataFrame([("a", 1)], "key string, ts long")).collect()[0].ts == 2

"""Two-phase commit in sets, and the same rules command by command."""

import random

from tidemark import model as M
from tidemark.operators import log as L, transactions as T

LOCKS = "key string, start_ts long, status string, primary_key string, lock_time double, value string"
WRITES = "key string, commit_ts long, start_ts long"
V = "key string, ts long, live boolean, value string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_prewrite_conflicts(spark):
    locks = spark.createDataFrame([("locked", 100, "LOCKED", "locked", 0.0, "x"), ("done", 90, "COMMITTED", "done", 0.0, "x")], LOCKS)
    writes = spark.createDataFrame([("committed", 200, 150)], WRITES)
    versions = spark.createDataFrame([("newer", 200, True, "x"), ("deleted", 200, False, None), ("older", 50, True, "x")], V)
    asked = spark.createDataFrame([(k, 150) for k in ("locked", "done", "committed", "newer", "deleted", "older", "free")], "key string, start_ts long")
    got = {r.key: r.code for r in T.prewrite_codes(asked, locks, writes, versions).collect()}
    assert got == {"locked": M.LOCKED, "done": 0, "committed": M.WRITE_CONFLICT, "newer": M.WRITE_CONFLICT, "deleted": M.WRITE_CONFLICT, "older": 0, "free": 0}


def test_commit_and_rollback_codes(spark):
    locks = spark.createDataFrame([("a", 1, "LOCKED", "a", 0.0, "x"), ("b", 1, "COMMITTED", "a", 0.0, "x"), ("c", 2, "LOCKED", "c", 0.0, "x")], LOCKS)
    commits = spark.createDataFrame([("a", 1, 9), ("b", 1, 9), ("c", 1, 9), ("d", 1, 9)], "key string, start_ts long, commit_ts long")
    assert {r.key: r.code for r in T.commit_codes(commits, locks).collect()} == {"a": 0, "b": 203, "c": 202, "d": 201}
    versions, records, left = T.committed(commits, locks)
    assert rows(versions) == [("a", 9, True, "x")] and rows(records) == [("a", 9, 1)]
    assert {r.key for r in left.collect()} == {"b", "c"}
    assert {r.key: r.code for r in T.rollback_codes(commits, locks).collect()} == {"a": 0, "b": 0, "c": 202, "d": 0}


def test_fate_of_a_lock_is_its_primarys(spark):
    locks = spark.createDataFrame([("s1", 10, "LOCKED", "p1", 0.0, "x"), ("s2", 11, "LOCKED", "p2", 0.0, "x"), ("p2", 11, "LOCKED", "p2", 99.0, "x"), ("s3", 12, "LOCKED", "p3", 0.0, "x")], LOCKS)
    # p1 was written again after the transaction at 10 had committed it
    writes = spark.createDataFrame([("p1", 20, 10), ("p1", 30, 25)], WRITES)
    got = {r.key: (r.status, r.commit_ts) for r in T.lock_fates(locks, writes, now=100.0).collect()}
    assert got == {"s1": ("COMMITTED", 20), "s2": ("PENDING", None), "p2": ("PENDING", None), "s3": ("ABORTED", None)}
    versions, _, left = T.resolved(locks, writes, now=100.0)
    assert rows(versions) == [("s1", 20, True, "x")] and {r.key for r in left.collect()} == {"s2", "p2"}
    assert {r.key for r in T.expired_locks(locks, 100.0).collect()} == {"s1", "s2", "s3"}


def test_write_skew_is_seen_and_unrelated_reads_are_not(spark):
    schema = "key string, start_ts long, commit_ts long"
    reads = spark.createDataFrame([(k, t, 10) for k in ("k0", "k1") for t in (1, 2)] + [("k9", 3, 10)], schema)
    writes = spark.createDataFrame([("k0", 1, 10), ("k1", 2, 10), ("k9", 4, 10)], schema)
    assert rows(T.write_skew(reads, writes)) == [(1, 2)]


def test_timestamps_are_consecutive(spark):
    asked = spark.range(1000).selectExpr("id * 777 as request", "id % 5 + 1 as batch")
    got = sorted(T.allocated(asked).collect(), key=lambda r: r.request)
    assert got[0].first_ts == 1 and all(a.last_ts + 1 == b.first_ts for a, b in zip(got, got[1:]))


def model(commands):
    state, codes = {}, {}
    for c in commands:
        codes[c["idx"]] = state.setdefault(c["key"], L.KeyState()).apply(c)
    return state, codes


def random_log(seed, n=400):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        kind = pick.choice(["SET", "DELETE", "PREWRITE", "PREWRITE", "COMMIT", "COMMIT", "ROLLBACK", "CLEAN_LOCK"])
        start = pick.randint(1, 30)
        out.append({"idx": i, "type": kind, "key": pick.choice([b"a", b"b", b"c"]), "value": bytes([65 + i % 26]), "timestamp": start, "start_ts": None if kind in ("SET", "DELETE") else start, "commit_ts": start + pick.randint(1, 5), "primary_key": b"a", "lock_time": 0.0})
    return out


def test_a_log_folds_as_its_commands_do_one_by_one(spark):
    for seed in range(3):
        commands = random_log(seed)
        state, codes = model(commands)
        names = [c.split()[0] for c in L.COMMANDS.split(", ")]
        shuffled = random.Random(seed).sample(commands, len(commands))
        got = L.apply_log(spark.createDataFrame([tuple(c[n] for n in names) for c in shuffled], L.COMMANDS)).collect()
        assert {r.idx: r.code for r in got if r.kind == "result"} == codes
        assert {(bytes(r.key), r.ts): (r.live, r.value and bytes(r.value)) for r in got if r.kind == "version"} == {(k, t): v for k, s in state.items() for t, v in s.versions.items()}
        assert {(bytes(r.key), r.start_ts) for r in got if r.kind == "lock"} == {(k, t) for k, s in state.items() for t in s.locks}
        assert {(bytes(r.key), r.ts, r.start_ts) for r in got if r.kind == "write"} == {(k, t, w) for k, s in state.items() for t, w in s.writes.items()}


def test_a_log_of_plain_writes_is_an_aggregate(spark):
    commands = [c for c in random_log(9) if c["type"] in ("SET", "DELETE")]
    names = [c.split()[0] for c in L.COMMANDS.split(", ")]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in commands], L.COMMANDS)
    state, _ = model(commands)
    got = {(bytes(r.key), r.ts): (r.live, r.value and bytes(r.value)) for r in L.apply_writes(df).collect()}
    assert got == {(k, t): v for k, s in state.items() for t, v in s.versions.items()}


def test_commands_as_lines(spark):
    log = spark.createDataFrame([(1, "SET", bytearray(b"\xffk"), bytearray(b""), 5, None, None, None, None), (2, "COMMIT", bytearray(b"k"), None, None, 5, 6, bytearray(b"k"), None), (3, None, None, None, None, None, None, None, None)], L.COMMANDS)
    assert sorted(map(str, L.from_lines(L.to_lines(log)).collect())) == sorted(map(str, log.collect()))
    assert L.from_lines(spark.createDataFrame([("broken",)], "value string")).first().type is None
    assert [r[0] for r in log.orderBy("idx").select(L.writes_new_data(log.type)).collect()] == [True, False, True]

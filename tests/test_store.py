"""The store, its transactions, statements, shell and stream."""

import pytest
from pyspark.sql import functions as F

from tidemark import model as M
from tidemark.__main__ import main
from tidemark.sql import SQL, Unsupported, parse
from tidemark.store import Database, Store, TimestampClient
from tidemark.streaming import apply as stream


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_get_set_delete_scan_clear(db):
    for k in (b"a", b"b", b"c"):
        db.set(k, k.upper())
    db.delete(b"b")
    assert db.get(b"a") == b"A" and db.get(b"b") is None and db.get(b"missing") is None
    assert pairs(db.scan(b"a", b"z")) == [(b"a", b"A"), (b"c", b"C")]
    assert db.get(b"b", at=2) == b"B"
    db.clear()
    assert pairs(db.scan(b"", None)) == []


def test_odd_values_round_trip(db):
    for value in (b"", b"\x00\n\t", b"x" * 100_000):
        db.set(b"\x80odd", value)
        assert db.get(b"\x80odd") == value
    with pytest.raises(ValueError):
        db.set(b"a\x00b", b"")


def test_transactions_read_their_writes_and_see_one_snapshot(db):
    db.set(b"k", b"old")
    t = db.begin()
    db.set(b"k", b"new")
    assert t.get(b"k") == b"old"
    t.set(b"other", b"mine")
    assert t.get(b"other") == b"mine" and db.get(b"other") is None
    assert pairs(db.scan(b"", None, txn=t)) == [(b"k", b"old")]
    t.commit()
    assert db.get(b"other") == b"mine"
    with pytest.raises(RuntimeError):
        t.set(b"k", b"late")
    r = db.begin()
    r.set(b"k", b"never")
    r.rollback()
    assert db.get(b"k") == b"new"
    empty = db.begin()
    assert empty.commit() == empty.start_ts


def test_the_second_writer_loses(db):
    a, b = db.begin(), db.begin()
    a.set(b"k", b"a")
    b.set(b"k", b"b")
    a.commit()
    with pytest.raises(M.Conflict) as e:
        b.commit()
    assert e.value.code == M.WRITE_CONFLICT and db.get(b"k") == b"a"


def skew(db, serializable):
    db.set(b"x", b"on")
    db.set(b"y", b"on")
    a, b = db.begin(serializable), db.begin(serializable)
    for t, key in ((a, b"x"), (b, b"y")):
        assert t.get(b"x") == t.get(b"y") == b"on"
        t.set(key, b"off")
    a.commit()
    b.commit()


def test_write_skew_needs_read_validation(db):
    skew(db, serializable=False)  # the control: without validation both commit
    assert db.get(b"x") == db.get(b"y") == b"off"
    with pytest.raises(M.Conflict):
        skew(db, serializable=True)


def test_run_tries_again(db):
    db.set(b"n", b"1")
    tries = []

    def work(t):
        n = int(t.get(b"n"))
        if not tries:
            db.set(b"n", b"5")
        tries.append(n)
        t.set(b"n", str(n + 1).encode())

    db.run(work)
    assert tries == [1, 5] and db.get(b"n") == b"6"


def test_snapshot_restore_time_travel_and_garbage(db, tmp_path):
    db.set(b"k", b"1")
    pinned = db.store.manifest()
    db.set(b"k", b"2")
    db.store.snapshot(str(tmp_path / "snap"))
    db.delete(b"k")
    assert db.get(b"k") is None
    assert db.store.relation("versions", pinned).count() == 1 and db.store.manifest(version=1) == pinned
    db.store.collect_garbage(10)
    assert db.store.relation("versions").count() == 0
    db.store.restore(str(tmp_path / "snap"))
    assert db.get(b"k") == b"2" and db.get(b"k", at=1) == b"1"
    with pytest.raises(ValueError):
        db.get(b"k", consistency="sometimes")


def test_two_publishers_of_one_version(db):
    base = db.store.manifest()
    db.store.publish(base, clock=1)
    with pytest.raises(M.Conflict):
        Store(db.store.spark, str(db.store.root)).publish(base, clock=2)


def test_transfers_keep_the_total(db):
    names = [f"account_{c}".encode() for c in "abc"]
    db.load(db.store.spark.createDataFrame([(bytearray(n), bytearray(b"1000")) for n in names], "key binary, value binary"))
    for i in range(4):
        a, b = names[i % 3], names[(i + 1) % 3]

        def move(t, a=a, b=b):
            t.set(a, str(int(t.get(a)) - 10).encode())
            t.set(b, str(int(t.get(b)) + 10).encode())

        db.run(move)
    assert sum(int(v) for _, v in pairs(db.scan(b"account_", b"account`"))) == 3000


def test_parse():
    s = parse("SELECT * FROM users WHERE id = '1'")
    assert (s.table, s.columns, s.where) == ("users", ("*",), (("id", "=", "1"),))
    i = parse("INSERT INTO users (name, age) VALUES ('Alice, B', 30)")
    assert i.columns == ("name", "age") and i.rows == (("Alice, B", 30),)
    assert parse("insert into users (name, age) values ('Alice', 30)", compat=True).rows == (("ALICE", 30),)
    assert parse("SELECT a, b FROM t WHERE a >= -1.5 AND b <> 2;".replace("<> 2", "< 'it''s'")).where == (("a", ">=", -1.5), ("b", "<", "it's"))
    assert parse('INSERT INTO t (a, b) VALUES (1, NULL), ("x y", bare) ;').rows == ((1, None), ("x y", "bare"))
    for bad in ("SELECT * FROM a, b", "SELECT * FROM t WHERE a = 1 OR b = 2", "SELECT * FROM t WHERE a <> 1", "DELETE FROM t", "INSERT INTO t (a, b) VALUES (1)", "SELECT count(*) FROM t", "SELECT * FROM t WHERE", "SELECT * FROM t; SELECT * FROM u", "SELECT FROM t", "INSERT INTO t (a) VALUES ('open)", ""):
        with pytest.raises(Unsupported):
            parse(bad)


def test_statements(db):
    sql = SQL(db)
    for i, name in ((1, "Ann"), (2, "Bob"), (10, "Cy"), (20, "Di")):
        sql.execute(f"INSERT INTO users (id, name) VALUES ({i}, '{name}')")
    sql.execute("INSERT INTO users (id, name) VALUES (2, 'Bea')")
    names = lambda q: [r.name for r in sql.execute(q).collect()]
    assert names("SELECT name FROM users") == ["Ann", "Cy", "Bea", "Di"]
    assert names("SELECT name FROM users WHERE id = 2") == ["Bea"]
    assert names("SELECT name FROM users WHERE id > '2'") == ["Di"]
    assert names("SELECT name FROM users WHERE id <= '2'") == ["Ann", "Cy", "Bea"]
    assert names("SELECT name FROM users WHERE name >= 'Bob'") == ["Cy", "Di"]
    assert sql.execute("SELECT * FROM users WHERE id = 1").collect()[0].asDict() == {"id": "1", "name": "Ann"}
    old = SQL(db, compat=True)
    assert [r.name for r in old.execute("SELECT name FROM users WHERE id > '2'").collect()] == []


def test_statements_meet_locks_and_ranges(db):
    sql = SQL(db, columns={"users": ["id", "name"]})
    assert sql.execute("INSERT INTO users (id, name) VALUES (1, 'Ann'), (2, 'Bob'), (3, NULL)") == 3
    got = lambda q: [tuple(r) for r in sql.execute(q).collect()]
    assert got("SELECT * FROM users WHERE id > 1 AND id <= 3 AND name = 'Bob'") == [("2", "Bob")]
    assert got("SELECT * FROM users WHERE id > 3 AND id < 2") == []
    t = db.two_phase()
    t.add_write(b"users:2", b"{}")
    t.prewrite()
    with pytest.raises(M.KeyLocked):
        got("SELECT name FROM users")
    assert got("SELECT name FROM users WHERE id = 1") == [("Ann",)]
    t.rollback()
    assert len(got("SELECT name FROM users")) == 3


def two(db, ttl=5.0, **options):
    t = db.two_phase(ttl=ttl, **options)
    t.add_write(b"primary", b"p2")
    t.add_write(b"\x80second", b"s2")
    return t


@pytest.fixture
def pair(db):
    db.set(b"primary", b"p1")
    db.set(b"\x80second", b"s1")
    return db


def test_two_phases(pair):
    t = two(pair)
    assert t.primary == b"primary" and t.read(b"primary") == b"p1"
    t.prewrite()
    other = two(pair)
    with pytest.raises(M.Conflict) as e:
        other.prewrite()
    assert e.value.code == M.LOCKED and pair.store.relation("locks").count() == 2
    t.commit()
    assert pair.get(b"primary") == b"p2" and pair.get(b"\x80second") == b"s2" and pair.store.relation("locks").count() == 0
    late = two(pair)
    pair.set(b"primary", b"p3")
    with pytest.raises(M.Conflict) as e:
        late.prewrite()
    assert e.value.code == M.WRITE_CONFLICT and pair.store.relation("locks").count() == 0
    gone = two(pair)
    gone.add_write(b"primary", None)
    gone.commit()
    assert pair.get(b"primary") is None
    back = two(pair)
    back.prewrite()
    back.rollback()
    assert pair.get(b"\x80second") == b"s2" and pair.store.relation("locks").count() == 0
    none = pair.two_phase()
    assert none.commit() == none.start_ts


def test_a_stranded_lock_is_rolled_forward(pair):
    two(pair).commit(secondaries=False)
    with pytest.raises(M.KeyLocked):
        pair.get(b"\x80second")
    assert pair.get(b"\x80second", wait=30) == b"s2"
    assert pair.store.relation("locks").count() == 0 and pair.store.relation("write_records").where("start_ts > 2").count() == 2


def test_a_dead_lock_is_cleared_and_a_live_one_waited_for(pair):
    two(pair).prewrite(now=0.0)
    assert pair.get(b"\x80second", wait=30) == b"s1" and [bytes(r.key) for r in pair.store.relation("locks").collect()] == [b"primary"]
    pair.store.resolve()
    two(pair).prewrite()
    with pytest.raises(M.KeyLocked):
        pair.scan(b"", None, wait=0.2, ttl=600.0)
    assert pair.get(b"primary", at=1) == b"p1"
    assert [bytes(r.value) for r in pair.scan(b"", None, wait=60, ttl=0.0).collect()] == [b"p1", b"s1"]


def test_write_skew_by_locks(pair):
    def skew(serializable):
        a, b = (pair.two_phase(serializable) for _ in range(2))
        for t, key in ((a, b"primary"), (b, b"\x80second")):
            t.read(b"primary"), t.read(b"\x80second")
            t.add_write(key, b"off")
        a.commit()
        b.commit()

    skew(False)
    with pytest.raises(M.Conflict):
        skew(True)


def test_batches_of_locks(pair):
    spark, store = pair.store.spark, pair.store
    rows = [(b"a", 10, b"a", b"1"), (b"b", 10, b"a", b"1"), (b"b", 11, b"b", b"2"), (b"c", 11, b"b", b"2"), (b"d", 12, b"d", None)]
    writes = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], "key binary, start_ts long, primary_key binary, value binary")
    assert sorted((bytes(r.key), r.start_ts, r.code) for r in store.prewrite(writes, 1.0).collect()) == [(b"a", 10, 0), (b"b", 10, 0), (b"b", 11, 101), (b"c", 11, 0), (b"d", 12, 0)]
    assert sorted(bytes(r.key) for r in store.relation("locks").collect()) == [b"a", b"b", b"d"]
    commits = writes.where("start_ts <> 12").select("key", "start_ts", (F.col("start_ts") + 100).alias("commit_ts"))
    assert sorted((bytes(r.key), r.start_ts, r.code) for r in store.commit(commits).collect()) == [(b"a", 10, 0), (b"b", 10, 0), (b"b", 11, 202), (b"c", 11, 201)]
    store.clean_lock(spark.createDataFrame([(bytearray(b"d"), 12)], "key binary, start_ts long"))
    assert store.relation("locks").count() == 0 and store.manifest().clock == 111 and list(store.timestamps(3)) == [112, 113, 114]
    client = TimestampClient(store, 2)
    assert [client.next() for _ in range(3)] == [115, 116, 117] and client.run(2) == [119, 120]


def test_intents(db):
    store = db.store
    assert store.set_intent(b"k", 5, b"v", now=0.0) == M.OK and store.set_intent(b"k", 6, b"w") == M.LOCKED
    assert store.intent(b"k") == b"v" and store.intent(b"none") is None and [r.start_ts for r in store.locks_of(b"k").collect()] == [5]
    store.remove_intent(b"k", 6)
    assert store.intent(b"k") == b"v"
    store.remove_intent(b"k")
    assert store.intent(b"k") is None
    store.flush()
    store.close()


def test_the_table_of_shards(db):
    store = db.store
    assert store.init_routes({0: (b"", b"m"), 1: (b"m", None)}) == M.OK and store.init_routes({0: (b"", None)}) == M.ROUTES_EXIST
    assert store.set_shard_nodes(0, [1, 2], {1: "a", 2: "b"}) == M.OK and store.set_shard_nodes(7, [1], {}) == M.NO_SHARD
    assert [store.report_leader(0, *x) for x in ((3, 1), (1, 4), (2, 4), (2, 5))] == [M.NODE_NOT_SERVING, M.OK, M.STALE_LEADER, M.OK]
    assert store.set_shard_nodes(0, [1, 3], {1: "a", 3: "c"}) == M.OK  # the leader is none of these
    row = store.shards().where("shard_id = 0").first()
    assert (row.nodes, row.leader_id, row.leader_term, row.addresses) == ([1, 3], None, 0, {1: "a", 3: "c"})
    assert (store.shard_for(b"l"), store.shard_for(b"m"), store.shard_for(b"\xff\xff")) == (0, 1, 1)


def test_a_split_keeps_all_versions_and_waits_for_locks(db):
    store = db.store
    for key, value in ((b"a", b"1"), (b"p", b"2"), (b"p", b"3"), (b"z", b"4")):
        db.set(key, value)
    store.init_routes({0: (b"", b"s"), 1: (b"s", None)})
    before = sorted(map(str, store.relation("versions").collect()))
    t = db.two_phase()
    t.add_write(b"q", b"new")
    t.prewrite()
    assert store.split_shard(0, b"n", 2) == M.LOCKED and store.manifest().notes == {} and len(store.ranges()) == 2
    t.rollback()
    version = store.manifest().routes_version
    assert store.split_shard(0, b"n", 2) == M.OK and store.manifest().routes_version == version + 1
    assert [store.split_shard(*x) for x in ((0, b"n", 2), (9, b"n", 5), (0, b"n", 5), (0, b"f", 1))] == [M.OK, M.SPLIT_NO_SHARD, M.SPLIT_OUTSIDE, M.SPLIT_ID_TAKEN]
    assert sorted(map(str, store.relation("versions").collect())) == before and db.get(b"p", at=2) == b"2"
    assert [(i, [bytes(r.key) for r in rows.collect()]) for i, rows in db.scan_pieces(b"", None)] == [(0, [b"a"]), (2, [b"p"]), (1, [b"z"])]
    assert [i for i, _ in db.scan_pieces(b"o", b"r")] == [2] and pairs(db.scan(b"o", b"s")) == [(b"p", b"3")]


def test_a_shard_under_way_refuses_new_writes_and_recovers(db):
    store = db.store
    store.init_routes({0: (b"", b"m"), 1: (b"m", None)})
    store.set_shard_nodes(0, [1, 2], {1: "a", 2: "b"})
    t = db.two_phase()
    t.add_write(b"b", b"before")
    t.prewrite()
    store.note(0, {"kind": "split", "key": b"c".hex(), "to": 5})  # as a crash would leave it
    for write in (lambda: db.set(b"a", b"x"), lambda: db.load(store.spark.createDataFrame([(bytearray(b"a"), bytearray(b"x"))], "key binary, value binary"))):
        with pytest.raises(M.Refused) as e:
            write()
        assert e.value.code == M.SPLIT_IN_PROGRESS
    with pytest.raises(M.Refused):
        store.move_shard(0, [1, 2], [3], {3: "c"})
    db.set(b"n", b"other shard")
    t.commit()  # a lock from before goes on
    assert store.recover() == {0: M.OK} and [r[0] for r in sorted(store.ranges())] == [0, 1, 5] and store.recover() == {}
    db.set(b"a", b"x")
    assert store.move_shard(0, [1, 2], [3, 4], {3: "c", 4: "d"}) == M.OK and store.move_shard(0, [1, 2], [3, 4], {3: "c", 4: "d"}) == M.OK
    assert [store.move_shard(*x) for x in ((0, [1], [7], {7: "g"}), (8, [1], [2], {2: "b"}), (0, [3, 4], [4], {4: "d"}))] == [M.MOVE_STALE, M.MOVE_NO_SHARD, M.MOVE_OVERLAP]
    assert store.shards().where("shard_id = 0").first().nodes == [3, 4] and db.get(b"b") == b"before"


def test_segments_are_pruned_merged_and_vacuumed(db, monkeypatch):
    from tidemark import store as module

    monkeypatch.setattr(module, "MOST_SEGMENTS", 6)
    for i in range(9):
        db.set(b"k%d" % i, b"v%d" % i)
    segments = db.store.manifest().segments
    assert len(segments["versions"]) < 9 and len(pairs(db.scan(b"", None))) == 9
    db.store.compact()
    assert {n: len(x) for n, x in db.store.manifest().segments.items()} == {"versions": 1, "write_records": 1, "locks": 0}
    db.set(b"z", b"last")
    m = db.store.manifest()
    assert db.store.relation("versions", m, b"y").count() == 1 and db.store.relation("versions", m, None, b"l").count() == 9
    assert db.store.vacuum() > 0 and len(list((db.store.root / "manifests").glob("*.json"))) == 1
    assert len(pairs(db.scan(b"", None))) == 10 and Store(db.store.spark, str(db.store.root)).manifest() == m


def test_shell(spark, tmp_path, capsys):
    folder = ["--data-dir", str(tmp_path / "cli")]
    assert main([*folder, "set", "k", "v"], spark) == main([*folder, "get", "k"], spark) == main([*folder, "scan", "a", "z"], spark) == main([*folder, "delete", "k"], spark) == 0
    assert main([*folder, "get", "k"], spark) == 1
    assert capsys.readouterr().out.split("\n") == ["OK", "v", "k: v", "OK", "Key not found", ""]


def test_a_stream_of_changes(spark, tmp_path):
    log = spark.createDataFrame([(i, "DELETE" if i == 3 else "SET", bytearray(b"k%d" % (i % 2)), bytearray(b"v%d" % i), i + 1) for i in range(4)], stream.CHANGES)
    log.where("idx < 2").write.parquet(str(tmp_path / "log"))
    store = Store(spark, str(tmp_path / "db"))
    for more in (False, True):
        if more:
            log.where("idx >= 2").write.mode("append").parquet(str(tmp_path / "log"))
        q = stream.apply_changes(stream.read_changes(spark, str(tmp_path / "log")), store, str(tmp_path / "check"))
        q.awaitTermination(60)
    db = Database(spark, str(tmp_path / "db"))
    assert db.get(b"k0") == b"v2" and db.get(b"k1") is None and db.get(b"k1", at=2) == b"v1"
    assert store.relation("versions").agg(F.max("ts")).first()[0] == 4

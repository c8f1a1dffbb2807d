"""Queries of the engine's own operators over ordinary tables, with the SQL that says what each must
return. Keys are text here, which sorts as its bytes do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import keys as K
from tidemark.operators import log as L, read as R, routing as S, transactions as T, write as W
from tidemark.sources.ingest import event_versions, keyed, micros, table, versions_of

AT = 1_705_276_800_000_000
NOW = AT / 1e6
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

V = "(SELECT 'users:' || user_id AS key, epoch_us(ts) AS ts, event_type <> 'error' AS live, value::VARCHAR AS value, event_id AS seq FROM events)"
NEWEST = "(SELECT key, arg_max_null(value, ts) AS value, arg_max(live, ts) AS live, max(ts) AS commit_ts FROM {v} WHERE {where} GROUP BY key)"
LOCKS = f"""(SELECT 'users:' || user_id AS key, epoch_us(ts) AS start_ts, CASE WHEN event_id % 5 = 0 THEN 'COMMITTED' ELSE 'LOCKED' END AS status,
  'users:' || (user_id - user_id % 2) AS primary_key, epoch_us(ts) / 1e6 AS lock_time, value::VARCHAR AS value FROM events WHERE event_type = 'purchase')"""
WRITES = """(SELECT 'customer:' || o_custkey AS key, (epoch_us(o_orderdate) // 86400000000) * 1000000 + o_orderkey AS commit_ts,
  (epoch_us(o_orderdate) // 86400000000) * 1000000 + o_orderkey - 40000000 * (1 + o_orderkey % 3) AS start_ts, o_orderkey AS txn FROM orders)"""
RANGES = [(0, "orders:", "orders:3"), (1, "orders:3", "orders:60"), (2, "orders:60", "orders:9"), (3, "orders:95", None)]
SHARD_SQL = "(VALUES (0, 'orders:', 'orders:3'), (1, 'orders:3', 'orders:60'), (2, 'orders:60', 'orders:9'), (3, 'orders:95', NULL)) AS s(shard_id, start_key, end_key)"
ORDER_KEYS = "(SELECT 'orders:' || o_orderkey AS key, o_totalprice FROM orders)"


def query(sql: str | None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def locks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    ts, user = micros(F.col("ts")), F.col("user_id")
    name = lambda c: F.concat(F.lit("users:"), c.cast("string"))
    return e.select(name(user).alias("key"), ts.alias("start_ts"), F.when(F.col("event_id") % 5 == 0, "COMMITTED").otherwise("LOCKED").alias("status"), name(user - user % 2).alias("primary_key"), (ts / F.lit(1e6)).alias("lock_time"), F.col("value").cast("string").alias("value"))


def write_records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    commit = F.floor(micros(F.col("o_orderdate")) / 86_400_000_000).cast("long") * 1_000_000 + F.col("o_orderkey")
    return o.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("key"), commit.alias("commit_ts"), (commit - 40_000_000 * (1 + F.col("o_orderkey") % 3)).alias("start_ts"), F.col("o_orderkey").alias("txn"))


def order_keys(spark: SparkSession, d: str) -> DataFrame:
    return keyed(table(spark, d, "orders"), "orders", "o_orderkey", "o_totalprice")


def customer_rows(spark: SparkSession, d: str) -> DataFrame:
    return keyed(table(spark, d, "customer"), "customer", "c_custkey", "c_name")


def shards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "shard_id int, start_key string, end_key string")


# storage


@query(f"SELECT key, o_totalprice FROM {ORDER_KEYS} WHERE key = 'orders:77'")
def kv_point_get(spark, d):
    return order_keys(spark, d).where(F.col("key") == "orders:77")


@query("SELECT * FROM (SELECT 'customer:' || c_custkey AS key, c_name FROM customer) WHERE key >= 'customer:10' AND key < 'customer:50'")
def kv_scan_half_open(spark, d):
    return customer_rows(spark, d).where(K.in_range(F.col("key"), "customer:10", "customer:50"))


@query("""SELECT l_orderkey, l_linenumber, m.l_partkey AS l_partkey, m.l_suppkey AS l_suppkey, m.l_quantity AS l_quantity, m.l_extendedprice AS l_extendedprice
  FROM (SELECT l_orderkey, l_linenumber, max(struct_pack(l_shipdate, l_extendedprice, l_quantity, l_partkey, l_suppkey)) AS m FROM lineitem GROUP BY 1, 2)""")
def kv_put_last_wins(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey")
    return W.last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey"]).drop("l_shipdate")


@query("SELECT 'part:' || p_partkey AS key, p_name FROM part WHERE p_partkey % 7 <> 0")
def kv_delete_batch(spark, d):
    rows = keyed(table(spark, d, "part"), "part", "p_partkey", "p_name", "p_partkey")
    return W.without_keys(rows, rows.where("p_partkey % 7 = 0")).select("key", "p_name")


@query("SELECT * FROM (SELECT 'part:' || p_partkey AS key, p_name FROM part) WHERE NOT (key >= 'part:2' AND key < 'part:7')")
def kv_delete_range(spark, d):
    return W.without_range(keyed(table(spark, d, "part"), "part", "p_partkey", "p_name"), "part:2", "part:7")


# versions


@query(f"SELECT key, value, commit_ts FROM {NEWEST.format(v=V, where=f'key = $$users:17$$ AND ts <= {AT}')} WHERE live")
def mvcc_get_as_of(spark, d):
    return R.get(event_versions(spark, d), "users:17", AT)


_SCAN = NEWEST.format(v=V, where=f"key >= 'users:1' AND key < 'users:5' AND ts <= {AT}")


@query(f"SELECT key, value, commit_ts FROM {_SCAN} WHERE live")
def mvcc_scan_as_of(spark, d):
    return R.scan(event_versions(spark, d), "users:1", "users:5", AT)


@query(f"SELECT key, value, commit_ts FROM {NEWEST.format(v=V, where='true')} WHERE live")
def mvcc_scan_versions(spark, d):
    return R.scan(event_versions(spark, d))


@query(f"SELECT * FROM {NEWEST.format(v=V, where='true')}")
def mvcc_latest_version(spark, d):
    return R.newest_versions(event_versions(spark, d))


@query(f"SELECT key, commit_ts FROM {NEWEST.format(v=V, where=f'ts <= {AT}')} WHERE NOT live")
def mvcc_tombstones_at(spark, d):
    return R.newest_versions(event_versions(spark, d), AT).where("not live").select("key", "commit_ts")


@query(f"SELECT key, ts, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS until, live, value FROM {V}")
def mvcc_history(spark, d):
    return R.history(event_versions(spark, d))


@query(f"""SELECT key, ts, live FROM (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS until FROM {V})
  WHERE until <= {AT} OR (NOT live AND until IS NULL AND ts <= {AT})""")
def mvcc_gc_candidates(spark, d):
    return R.collectable(event_versions(spark, d), AT)


@query(f"SELECT max(ts)::BIGINT AS last_applied FROM {V}")
def mvcc_last_applied(spark, d):
    return event_versions(spark, d).agg(F.max("ts").alias("last_applied"))


@query(f"SELECT key, arg_max(start_ts, commit_ts) AS start_ts, max(commit_ts) AS commit_ts FROM {WRITES} GROUP BY key")
def wr_latest(spark, d):
    return R.newest_writes(write_records(spark, d))


# locks


@query(f"SELECT key, max(start_ts) AS start_ts, arg_max(status, start_ts) AS status, arg_max(primary_key, start_ts) AS primary_key, arg_max_null(value, start_ts) AS value FROM {LOCKS} GROUP BY key")
def lock_newest(spark, d):
    return R.newest_locks(locks(spark, d)).drop("lock_time")


@query(f"SELECT key, start_ts, status FROM {LOCKS} ORDER BY key, start_ts")
def lock_list(spark, d):
    return locks(spark, d).select("key", "start_ts", "status").orderBy("key", "start_ts")


@query(f"""WITH i AS (SELECT key, bool_or(start_ts < {AT}) AS blocked FROM {LOCKS} WHERE status = 'LOCKED' AND start_ts <= {AT} AND key >= 'users:1' AND key < 'users:5' GROUP BY key)
  SELECT key, CASE WHEN blocked THEN NULL ELSE value END AS value, CASE WHEN blocked THEN 0 ELSE commit_ts END AS commit_ts, CASE WHEN blocked THEN 'blocked' ELSE 'committed' END AS state
  FROM (SELECT key, value, commit_ts FROM {_SCAN} WHERE live) FULL JOIN i USING (key)""")
def read_with_locks(spark, d):
    return R.read_with_locks(event_versions(spark, d), locks(spark, d), AT, "users:1", "users:5")


@query(f"SELECT key, start_ts FROM {LOCKS} WHERE status = 'LOCKED' AND start_ts < {AT} AND key >= 'users:1' AND key < 'users:5'")
def scan_blocking_locks(spark, d):
    return R.blocking_locks(locks(spark, d), "users:1", "users:5", AT).select("key", "start_ts")


@query(f"SELECT key, start_ts FROM {LOCKS} WHERE status = 'LOCKED' AND {NOW} - lock_time >= 5.0")
def locks_expired(spark, d):
    return T.expired_locks(locks(spark, d), NOW).select("key", "start_ts")


def _own_writes(spark, d):
    """Locks' own transactions as write records: every third purchase committed a second later."""
    e = table(spark, d, "events").where("event_type = 'purchase' and event_id % 3 = 0")
    user = F.col("user_id")
    return e.select(F.concat(F.lit("users:"), (user - user % 2).cast("string")).alias("key"), (micros(F.col("ts")) + 1_000_000).alias("commit_ts"), micros(F.col("ts")).alias("start_ts"))


_OWN_WRITES = "(SELECT 'users:' || (user_id - user_id % 2) AS key, epoch_us(ts) + 1000000 AS commit_ts, epoch_us(ts) AS start_ts FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0)"


@query(f"""SELECT l.key AS key, l.start_ts AS start_ts, CASE WHEN w.commit_ts IS NOT NULL THEN 'COMMITTED' WHEN p.key IS NOT NULL THEN 'PENDING' ELSE 'ABORTED' END AS status, w.commit_ts AS commit_ts
  FROM {LOCKS} l LEFT JOIN {_OWN_WRITES} w ON w.key = l.primary_key AND w.start_ts = l.start_ts
  LEFT JOIN (SELECT * FROM {LOCKS} WHERE key = primary_key AND status = 'LOCKED' AND {NOW} - lock_time < 600000.0) p ON p.key = l.primary_key AND p.start_ts = l.start_ts
  WHERE l.status = 'LOCKED'""")
def lock_fate(spark, d):
    return T.lock_fates(locks(spark, d), _own_writes(spark, d), NOW, 600_000.0)


# transactions


def _wanted(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'")
    return e.groupBy(F.concat(F.lit("users:"), F.col("user_id").cast("string")).alias("key")).agg(F.max(micros(F.col("ts"))).alias("start_ts"))


_WANTED = "(SELECT 'users:' || user_id AS key, max(epoch_us(ts)) AS start_ts FROM events WHERE event_type = 'signup' GROUP BY 1)"
_CLICKS = V.replace("FROM events", "FROM events WHERE event_type = 'click'")
_CODES = f"""(SELECT w.key AS key, w.start_ts AS start_ts, CASE WHEN l.status = 'LOCKED' THEN 101 WHEN r.commit_ts > w.start_ts OR v.ts > w.start_ts THEN 102 ELSE 0 END AS code
  FROM {_WANTED} w LEFT JOIN (SELECT key, arg_max(status, start_ts) AS status FROM {LOCKS} WHERE start_ts < {AT} GROUP BY key) l ON l.key = w.key
  LEFT JOIN (SELECT key, max(commit_ts) AS commit_ts FROM {_OWN_WRITES} GROUP BY key) r ON r.key = w.key
  LEFT JOIN (SELECT key, max(ts) AS ts FROM {_CLICKS} GROUP BY key) v ON v.key = w.key)"""


def _codes(spark, d):
    clicks = versions_of(table(spark, d, "events").where("event_type = 'click'"), F.concat(F.lit("users:"), F.col("user_id").cast("string")), micros(F.col("ts")), F.col("value").cast("string"))
    return T.prewrite_codes(_wanted(spark, d), locks(spark, d).where(F.col("start_ts") < AT), _own_writes(spark, d), clicks)


@query(f"SELECT * FROM {_CODES}")
def txn_prewrite_codes(spark, d):
    return _codes(spark, d)


@query(f"SELECT start_ts, bool_and(code = 0) AS granted FROM {_CODES} GROUP BY start_ts")
def txn_all_granted(spark, d):
    return T.all_granted(_codes(spark, d))


def _commits(spark, d):
    """Commits of the locks, some under a wrong timestamp, and some for keys without a lock."""
    held = locks(spark, d).select("key", (F.col("start_ts") + F.when(F.col("start_ts") % 4 == 0, 1).otherwise(0)).alias("start_ts"), (F.col("start_ts") + 10).alias("commit_ts"))
    return held.union(_wanted(spark, d).select(F.concat("key", F.lit("?")).alias("key"), "start_ts", (F.col("start_ts") + 10).alias("commit_ts")))


_COMMITS = f"""(SELECT key, start_ts + CASE WHEN start_ts % 4 = 0 THEN 1 ELSE 0 END AS start_ts, start_ts + 10 AS commit_ts FROM {LOCKS}
  UNION ALL SELECT key || '?', start_ts, start_ts + 10 FROM {_WANTED})"""
_COMMIT_CODES = f"""(SELECT c.key AS key, c.start_ts AS start_ts, c.commit_ts AS commit_ts, CASE WHEN o.status <> 'LOCKED' THEN 203 WHEN o.key IS NOT NULL THEN 0 WHEN a.key IS NOT NULL THEN 202 ELSE 201 END AS code
  FROM {_COMMITS} c LEFT JOIN {LOCKS} o ON o.key = c.key AND o.start_ts = c.start_ts LEFT JOIN (SELECT DISTINCT key FROM {LOCKS}) a ON a.key = c.key)"""


@query(f"SELECT * FROM {_COMMIT_CODES}")
def txn_commit_codes(spark, d):
    return T.commit_codes(_commits(spark, d), locks(spark, d))


@query(f"SELECT c.key AS key, c.commit_ts AS ts, true AS live, l.value AS value FROM {_COMMIT_CODES} c JOIN {LOCKS} l ON l.key = c.key AND l.start_ts = c.start_ts WHERE c.code = 0")
def txn_commit_apply(spark, d):
    return T.committed(_commits(spark, d), locks(spark, d))[0]


@query(f"SELECT l.key AS key, l.start_ts AS start_ts FROM {LOCKS} l ANTI JOIN (SELECT * FROM {_COMMIT_CODES} WHERE code = 0) c ON l.key = c.key AND l.start_ts = c.start_ts")
def txn_locks_left(spark, d):
    return T.committed(_commits(spark, d), locks(spark, d))[2].select("key", "start_ts")


@query(f"SELECT l.key AS key, l.start_ts AS start_ts FROM {LOCKS} l ANTI JOIN {_COMMITS} c ON l.key = c.key AND l.start_ts = c.start_ts")
def txn_rollback(spark, d):
    return T.rolled_back(locks(spark, d), _commits(spark, d)).select("key", "start_ts")


@query(f"""SELECT c.key AS key, c.start_ts AS start_ts, CASE WHEN o.key IS NOT NULL THEN 0 WHEN a.key IS NOT NULL THEN 202 ELSE 0 END AS code
  FROM {_COMMITS} c LEFT JOIN {LOCKS} o ON o.key = c.key AND o.start_ts = c.start_ts LEFT JOIN (SELECT DISTINCT key FROM {LOCKS}) a ON a.key = c.key""")
def txn_rollback_codes(spark, d):
    return T.rollback_codes(_commits(spark, d), locks(spark, d))


@query(f"""SELECT l.key AS key, l.start_ts AS start_ts FROM {LOCKS} l JOIN (SELECT key, max(start_ts) AS newest FROM {LOCKS} GROUP BY key) n ON n.key = l.key
  LEFT JOIN {_WANTED} w ON w.key = l.key WHERE w.key IS NULL OR l.start_ts <> n.newest""")
def txn_clean_lock(spark, d):
    requests = _wanted(spark, d).select("key", F.lit(None).cast("long").alias("start_ts"))
    return T.cleaned(locks(spark, d), requests).select("key", "start_ts")


@query(f"""SELECT r.start_ts AS start_ts, r.key AS key, w.commit_ts AS commit_ts FROM {WRITES} r JOIN (SELECT key, max(commit_ts) AS commit_ts FROM {WRITES} GROUP BY key) w ON w.key = r.key WHERE w.commit_ts > r.start_ts""")
def txn_validate_reads(spark, d):
    w = write_records(spark, d)
    return T.stale_reads(w.select("start_ts", "key"), w)


_PAIRED = "(SELECT o_orderkey AS txn, (o_orderkey // 2) % 4999 AS pair, o_orderkey % 2 AS side, o_orderkey // 2 * 100 + o_orderkey % 2 AS start_ts, o_orderkey // 2 * 100 + 50 + o_orderkey % 2 AS commit_ts FROM orders)"
_WRITTEN = f"(SELECT 'item:' || pair || ':' || side AS key, start_ts, commit_ts FROM {_PAIRED})"
_READ = f"(SELECT 'item:' || pair || ':' || (CASE WHEN txn % 3 = 0 THEN side ELSE 1 - side END) AS key, start_ts, commit_ts FROM {_PAIRED})"


@query(f"""WITH o AS (SELECT DISTINCT r.start_ts AS reader, w.start_ts AS writer FROM {_READ} r JOIN {_WRITTEN} w ON r.key = w.key AND r.start_ts <> w.start_ts AND r.start_ts < w.commit_ts AND w.start_ts < r.commit_ts)
  SELECT a.reader AS start_ts, a.writer AS other_ts FROM o a JOIN o b ON a.reader = b.writer AND a.writer = b.reader WHERE a.reader < a.writer""")
def write_skew_pairs(spark, d):
    """Orders two by two as transactions at one time: each writes its side and, but for every third one,
    reads the other's."""
    n = F.col("o_orderkey")
    pair, side = F.floor(n / 2), n % 2
    t = table(spark, d, "orders").select(n.alias("txn"), (pair % 4999).alias("pair"), side.alias("side"), (pair * 100 + side).cast("long").alias("start_ts"), (pair * 100 + 50 + side).cast("long").alias("commit_ts"))
    item = lambda c: F.concat_ws(":", F.lit("item"), F.col("pair").cast("string"), c.cast("string"))
    return T.write_skew(t.withColumn("key", item(F.when(F.col("txn") % 3 == 0, F.col("side")).otherwise(1 - F.col("side")))), t.withColumn("key", item(F.col("side"))))


@query("SELECT event_id AS request, sum(user_id % 9 + 1) OVER (ORDER BY event_id)::BIGINT - user_id % 9 AS first_ts, sum(user_id % 9 + 1) OVER (ORDER BY event_id)::BIGINT AS last_ts FROM events")
def tso_batches(spark, d):
    return T.allocated(table(spark, d, "events").select(F.col("event_id").alias("request"), (F.col("user_id") % 9 + 1).alias("batch")))


@query(f"SELECT key, ts, live, CASE WHEN live THEN value END AS value FROM {V}")
def log_apply_set_delete(spark, d):
    v = event_versions(spark, d)
    return L.apply_writes(v.select(F.col("seq").alias("idx"), F.when(F.col("live"), "SET").otherwise("DELETE").alias("type"), "key", "value", F.col("ts").alias("timestamp")))


@query("""SELECT sum(a)::BIGINT AS accounts, sum(round(100 * (start + coalesce(delta, 0))))::BIGINT AS total_cents FROM
  (SELECT c_custkey, 1 AS a, 1000 AS start FROM customer) LEFT JOIN
  (SELECT account, sum(amount) AS delta FROM (SELECT o_custkey AS account, -(o_orderkey % 50) AS amount FROM orders UNION ALL
   SELECT (o_custkey + o_orderkey) % (SELECT count(*) FROM customer), o_orderkey % 50 FROM orders) GROUP BY account) ON account = c_custkey""")
def bank_total_invariant(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    n = customers.agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").crossJoin(F.broadcast(n))
    moved = o.select(F.explode(F.array(F.struct(F.col("o_custkey").alias("account"), (-(F.col("o_orderkey") % 50)).alias("amount")), F.struct(((F.col("o_custkey") + F.col("o_orderkey")) % F.col("n")).alias("account"), (F.col("o_orderkey") % 50).alias("amount")))).alias("m")).select("m.*")
    deltas = moved.groupBy("account").agg(F.sum("amount").alias("delta"))
    left = customers.join(deltas, F.col("account") == F.col("c_custkey"), "left")
    return left.agg(F.count("*").alias("accounts"), F.sum((1000 + F.coalesce("delta", F.lit(0))) * 100).cast("long").alias("total_cents"))


# tables as key prefixes


def _customer_versions(spark, d):
    return versions_of(customer_rows(spark, d), F.col("key"), F.lit(1), F.col("c_name"))


def _range(op: str, compat: bool = False):
    def run(spark, d):
        from tidemark.sql import key_range

        start, end = key_range("customer", op, "2", compat)
        text = lambda b: b.decode() if b is not None else None
        return R.scan(_customer_versions(spark, d), text(start), text(end)).select("key", "value")

    return run


_ROWS = "SELECT key, value FROM (SELECT 'customer:' || c_custkey AS key, c_name AS value FROM customer) WHERE key >= 'customer:' AND key < 'customer;' AND "
for _name, _op, _compat, _where in (
    ("sql_point", "=", False, "key = 'customer:2'"), ("sql_gt", ">", False, "key > 'customer:2'"), ("sql_ge", ">=", False, "key >= 'customer:2'"),
    ("sql_lt", "<", False, "key < 'customer:2'"), ("sql_le", "<=", False, "key <= 'customer:2'"),
    ("sql_range_prefix_compat", ">", True, "key >= 'customer:3'"), ("sql_le_prefix_compat", "<=", True, "key < 'customer:3'"), ("sql_full", None, False, "true"),
):
    _QUERIES[_name] = _range(_op, _compat)
    _SQL[_name] = _ROWS + _where


@query("SELECT key, CASE WHEN id % 3 = 0 THEN 'new ' || name ELSE name END AS value FROM (SELECT 'nation:' || n_nationkey AS key, n_nationkey AS id, n_name AS name FROM nation) UNION ALL SELECT 'nation:' || (n_nationkey + 1000), 'added ' || n_name FROM nation WHERE n_nationkey < 5")
def sql_insert_upsert(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    row = lambda df, i, value, ts: versions_of(df, F.concat(F.lit("nation:"), i.cast("string")), F.lit(ts), value)
    rows = row(n, F.col("id"), F.col("name"), 1).union(row(n.where("id % 3 = 0"), F.col("id"), F.concat(F.lit("new "), "name"), 2)).union(row(n.where("id < 5"), F.col("id") + 1000, F.concat(F.lit("added "), "name"), 2))
    return R.scan(rows, "nation:", "nation;").select("key", "value")


@query("SELECT (o_orderkey)::VARCHAR AS id, o_orderpriority AS priority, o_totalprice::VARCHAR AS price FROM orders")
def sql_projection(spark, d):
    o = table(spark, d, "orders")
    packed = keyed(o, "orders", "o_orderkey", F.encode(F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("string").alias("price"))), "UTF-8").alias("value"))
    return K.row_fields(packed, "value", ["priority", "price"]).select(K.row_id(F.col("key")).alias("id"), "priority", "price")


# shards


@query(f"SELECT key, coalesce(shard_id, 0) AS shard_id FROM {ORDER_KEYS} k LEFT JOIN {SHARD_SQL} ON k.key >= start_key AND (end_key IS NULL OR k.key < end_key)")
def route_locate(spark, d):
    return S.locate(order_keys(spark, d).select("key"), shards(spark))


@query("SELECT i::INT AS shard_id, CASE WHEN i = 0 THEN '00' ELSE hex(i * 64) END AS start_hex, CASE WHEN i = 3 THEN 'FF' ELSE hex((i + 1) * 64) END AS end_hex FROM range(4) t(i)")
def route_default_map(spark, d):
    return S.shard_rows(spark, S.default_range_map(4)).select("shard_id", F.hex("start_key").alias("start_hex"), F.hex("end_key").alias("end_hex"))


@query(f"SELECT key, o_totalprice FROM {ORDER_KEYS} WHERE key >= 'orders:31' AND key < 'orders:70'")
def route_scan_pruned(spark, d):
    located = S.locate(order_keys(spark, d), shards(spark))
    return S.pruned(located, RANGES, "orders:31", "orders:70").select("key", "o_totalprice")


@query(f"SELECT shard_id, count(*) AS n FROM (SELECT coalesce(shard_id, 0) AS shard_id FROM {ORDER_KEYS} k LEFT JOIN {SHARD_SQL} ON k.key >= start_key AND (end_key IS NULL OR k.key < end_key)) GROUP BY shard_id")
def route_keys_by_shard(spark, d):
    return S.locate(order_keys(spark, d), shards(spark)).groupBy("shard_id").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('nation:', 'nation:1'), ('nation:18', 'nation:2'), ('nation:8', 'nation;')) t(gap_start, gap_end)")
def route_coverage_gaps(spark, d):
    owned = spark.createDataFrame([(1, "nation:1", "nation:15"), (2, "nation:15", "nation:18"), (3, "nation:2", "nation:8")], "shard_id int, start_key string, end_key string")
    return S.coverage_gaps(owned, "nation:", "nation;")


@query("SELECT key, CASE WHEN key >= 'orders:45' AND key >= 'orders:3' AND key < 'orders:60' THEN 9 ELSE shard_id END AS shard_id FROM (SELECT key, coalesce(shard_id, 0) AS shard_id FROM " + ORDER_KEYS + " k LEFT JOIN " + SHARD_SQL + " ON k.key >= start_key AND (end_key IS NULL OR k.key < end_key))")
def shard_split(spark, d):
    return S.split_rows(S.locate(order_keys(spark, d).select("key"), shards(spark)), 1, "orders:45", 9)


@query(f"SELECT key, ts FROM {V} WHERE seq % 3 = 0")
def shard_copy_missing(spark, d):
    v = event_versions(spark, d)
    return S.missing_rows(v, v.where("seq % 3 <> 0")).select("key", "ts")


@query("SELECT l_suppkey % 16 AS shard_id, arg_max(l_linenumber, struct_pack(a := l_orderkey, b := -l_partkey * 10000000 - l_linenumber)) AS leader_id, max(l_orderkey) AS leader_term FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey, l_linenumber FROM lineitem) GROUP BY 1")
def leader_report_max_term(spark, d):
    reports = table(spark, d, "lineitem").select((F.col("l_suppkey") % 16).alias("shard_id"), F.col("l_linenumber").alias("node_id"), F.col("l_orderkey").alias("term"), (F.col("l_partkey") * 10_000_000 + F.col("l_linenumber")).alias("seq"))
    return S.newest_leaders(reports)


# Shards derived from nations: 25 ranges of item keys, three replicas each, some without a leader.
_TABLE_SQL = """(SELECT n_nationkey AS shard_id, 'item:' || lpad((4 * n_nationkey)::VARCHAR, 3, '0') AS start_key, 'item:' || lpad((4 * n_nationkey + CASE WHEN n_nationkey % 7 = 3 THEN 3 ELSE 4 END)::VARCHAR, 3, '0') AS end_key,
  n_nationkey % 3 AS zone, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 3 * 10 + n_regionkey % 3 END AS leader_id, (n_regionkey + 1)::BIGINT AS leader_term FROM nation)"""


def _item(n) -> F.Column:
    return F.concat(F.lit("item:"), F.lpad(n.cast("string"), 3, "0"))


def _replicas(zone) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (zone * 10 + i).cast("int"))


def _homes(nodes) -> F.Column:
    return F.map_from_arrays(nodes, F.transform(nodes, lambda n: F.concat(F.lit("host"), n.cast("string"))))


def _table_of_shards(spark, d):
    n = F.col("n_nationkey")
    zone = (n % 3).cast("int")
    return table(spark, d, "nation").select(
        n.cast("int").alias("shard_id"), _item(4 * n).alias("start_key"), _item(4 * n + F.when(n % 7 == 3, 3).otherwise(4)).alias("end_key"), _replicas(zone).alias("nodes"), _homes(_replicas(zone)).alias("addresses"),
        F.when(n % 5 != 0, zone * 10 + F.col("n_regionkey") % 3).cast("int").alias("leader_id"), (F.col("n_regionkey") + 1).cast("long").alias("leader_term"),
    )


@query(f"""WITH t AS {_TABLE_SQL}, p AS (SELECT o_orderkey AS proposal, o_custkey % 28 AS shard_id, 'item:' || lpad((4 * (o_custkey % 28) + o_orderkey % 6 - 1)::VARCHAR, 3, '0') AS split_key,
    o_orderkey % 40 AS new_id, o_orderkey % 3 AS zone FROM orders WHERE o_custkey % 28 > 0)
  SELECT proposal, CASE WHEN n.shard_id IS NOT NULL AND coalesce(o.end_key = split_key AND n.start_key = split_key, false) THEN CASE WHEN n.zone = p.zone THEN 0 ELSE 10 END
    WHEN n.shard_id IS NOT NULL THEN 9 WHEN o.shard_id IS NULL THEN 7 WHEN NOT (o.start_key < split_key AND split_key < o.end_key) THEN 8 ELSE 0 END::INT AS code
  FROM p LEFT JOIN t o ON o.shard_id = p.shard_id LEFT JOIN t n ON n.shard_id = p.new_id""")
def split_validate(spark, d):
    shard, order = F.col("o_custkey") % 28, F.col("o_orderkey")
    proposals = table(spark, d, "orders").where(shard > 0).select(order.alias("proposal"), shard.cast("int").alias("shard_id"), _item(4 * shard + order % 6 - 1).alias("split_key"), (order % 40).cast("int").alias("new_id"), _replicas((order % 3).cast("int")).alias("nodes"))
    return S.split_codes(proposals, _table_of_shards(spark, d))


@query(f"""WITH t AS {_TABLE_SQL}, p AS (SELECT o_orderkey AS proposal, o_custkey % 28 AS shard_id, o_orderkey % 3 AS source, o_orderkey // 3 % 4 AS target, o_orderkey % 11 = 0 AS twice, o_orderkey % 13 = 0 AS unlisted, o_orderkey % 5 = 0 AS elsewhere FROM orders)
  SELECT proposal, CASE WHEN t.shard_id IS NULL THEN 12 WHEN twice OR unlisted THEN 13 WHEN t.zone = target THEN CASE WHEN elsewhere THEN 16 ELSE 0 END WHEN t.zone <> source THEN 14 WHEN source = target THEN 15 ELSE 0 END::INT AS code
  FROM p LEFT JOIN t ON t.shard_id = p.shard_id""")
def move_validate(spark, d):
    order = F.col("o_orderkey")
    nodes = _replicas((F.floor(order / 3) % 4).cast("int"))
    wanted = F.when(order % 11 == 0, F.concat(F.slice(nodes, 1, 2), F.slice(nodes, 1, 1))).otherwise(nodes)
    homes = F.when(order % 13 == 0, _homes(F.slice(nodes, 2, 2))).when(order % 5 == 0, F.map_from_arrays(nodes, F.transform(nodes, lambda n: F.concat(F.lit("other"), n.cast("string"))))).otherwise(_homes(nodes))
    homes = F.when((order % 11 == 0) & (order % 13 != 0) & (order % 5 != 0), _homes(nodes)).otherwise(homes)
    proposals = table(spark, d, "orders").select(order.alias("proposal"), (F.col("o_custkey") % 28).cast("int").alias("shard_id"), _replicas((order % 3).cast("int")).alias("from_nodes"), wanted.alias("nodes"), homes.alias("addresses"))
    return S.move_codes(proposals, _table_of_shards(spark, d))


@query(f"""SELECT l_orderkey AS report, l_suppkey % 28 AS shard_id, CASE WHEN t.shard_id IS NULL THEN 4 WHEN l_partkey % 30 NOT BETWEEN t.zone * 10 AND t.zone * 10 + 2 THEN 5 WHEN leader_id IS NOT NULL AND l_linenumber <= leader_term THEN 6 ELSE 0 END::INT AS code
  FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, l_linenumber FROM lineitem) LEFT JOIN {_TABLE_SQL} t ON t.shard_id = l_suppkey % 28""")
def leader_codes(spark, d):
    reports = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber").distinct()
    reports = reports.select(F.col("l_orderkey").alias("report"), (F.col("l_suppkey") % 28).cast("int").alias("shard_id"), (F.col("l_partkey") % 30).cast("int").alias("node_id"), F.col("l_linenumber").cast("long").alias("term"))
    return S.leader_codes(reports, _table_of_shards(spark, d), "report").select("report", F.col("shard_id").cast("long").alias("shard_id"), "code")


@query(f"""SELECT coalesce(before, 'item:') AS gap_start, start_key AS gap_end FROM (SELECT start_key, lag(end_key) OVER (ORDER BY start_key) AS before FROM {_TABLE_SQL}) WHERE start_key > coalesce(before, 'item:')
  UNION ALL SELECT max(end_key), 'item;' FROM {_TABLE_SQL}""")
def route_coverage_gaps(spark, d):
    return S.coverage_gaps(_table_of_shards(spark, d), "item:", "item;")


@query(f"SELECT shard_id FROM {_TABLE_SQL} WHERE leader_id IS NULL")
def route_leaderless(spark, d):
    return S.leaderless(_table_of_shards(spark, d)).select(F.col("shard_id").cast("long").alias("shard_id"))


@query("""SELECT shard_id, min(match_index) AS quorum FROM (SELECT s_nationkey AS shard_id, s_suppkey * 7 % 1009 AS match_index, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 7 % 1009 DESC) AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
  WHERE place <= n // 2 + 1 GROUP BY shard_id""")
def log_quorum_index(spark, d):
    return S.quorum_index(table(spark, d, "supplier").select(F.col("s_nationkey").alias("shard_id"), F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") * 7 % 1009).alias("match_index")))


# a log with locks, and the store


_CASES = """(SELECT event_id AS e, event_id % 7 AS kind, epoch_us(ts) AS t, 'event:' || event_id AS key, value::VARCHAR AS value FROM events)"""


def _log(spark, d):
    """Commands of each event's key by one of seven scripts: a write; a lock committed, rolled back, met
    by another, too old, committed under another start; a commit without a lock."""
    e = table(spark, d, "events").select(F.col("event_id").alias("e"), (F.col("event_id") % 7).cast("int").alias("kind"), micros(F.col("ts")).alias("t"), F.concat(F.lit("event:"), F.col("event_id").cast("string")).cast("binary").alias("key"), F.col("value").cast("string").cast("binary").alias("value"))
    none = F.lit(None).cast("long")

    def step(number, kind, type_, timestamp=none, start=none, commit=none):
        has = type_ in ("SET", "PREWRITE")
        return e.where(F.col("kind") == kind).select((F.col("e") * 4 + number).alias("idx"), F.lit(type_).alias("type"), "key", (F.col("value") if has else F.lit(None).cast("binary")).alias("value"), timestamp.alias("timestamp"), start.alias("start_ts"), commit.alias("commit_ts"), F.col("key").alias("primary_key"), F.lit(0.0).alias("lock_time"))

    t = F.col("t")
    steps = [
        step(0, 0, "SET", t), step(0, 1, "PREWRITE", start=t), step(1, 1, "COMMIT", start=t, commit=t + 5), step(0, 2, "PREWRITE", start=t), step(1, 2, "ROLLBACK", start=t),
        step(0, 3, "PREWRITE", start=t), step(1, 3, "PREWRITE", start=t + 1), step(0, 4, "SET", t + 10), step(1, 4, "PREWRITE", start=t), step(0, 5, "PREWRITE", start=t), step(1, 5, "COMMIT", start=t + 1, commit=t + 5), step(2, 5, "CLEAN_LOCK"),
        step(0, 6, "COMMIT", start=t, commit=t + 5), step(1, 6, "DELETE", t + 7),
    ]
    log = steps[0]
    for more in steps[1:]:
        log = log.unionByName(more)
    return log


@query(f"""WITH c AS {_CASES},
  r AS (SELECT e * 4 + s AS idx, key, CASE WHEN kind = 3 AND s = 1 THEN 101 WHEN kind = 4 AND s = 1 THEN 102 WHEN kind = 5 AND s = 1 THEN 202 WHEN kind = 6 AND s = 0 THEN 201 ELSE 0 END::INT AS code FROM c, range(3) g(s) WHERE s < CASE kind WHEN 0 THEN 1 WHEN 5 THEN 3 ELSE 2 END)
  SELECT 'result' AS kind, key, NULL::BIGINT AS ts, NULL::BIGINT AS start_ts, NULL::VARCHAR AS value, idx, code FROM r
  UNION ALL SELECT 'version', key, CASE kind WHEN 0 THEN t WHEN 1 THEN t + 5 WHEN 4 THEN t + 10 ELSE t + 7 END, NULL, CASE WHEN kind < 6 THEN value END, NULL, NULL FROM c WHERE kind IN (0, 1, 4, 6)
  UNION ALL SELECT 'write', key, t + 5, t, NULL, NULL, NULL FROM c WHERE kind = 1
  UNION ALL SELECT 'lock', key, NULL, t, value, NULL, NULL FROM c WHERE kind = 3""")
def apply_log(spark, d):
    return L.apply_log(_log(spark, d)).select("kind", F.col("key").cast("string").alias("key"), "ts", "start_ts", F.col("value").cast("string").alias("value"), "idx", "code")


_FATES = f"""(SELECT l.key AS key, l.start_ts AS start_ts, l.value AS value, w.commit_ts AS commit_ts, CASE WHEN w.commit_ts IS NOT NULL THEN 'COMMITTED' WHEN p.key IS NOT NULL THEN 'PENDING' ELSE 'ABORTED' END AS fate
  FROM {LOCKS} l LEFT JOIN {_OWN_WRITES} w ON w.key = l.primary_key AND w.start_ts = l.start_ts
  LEFT JOIN (SELECT * FROM {LOCKS} WHERE key = primary_key AND status = 'LOCKED' AND {NOW} - lock_time < 600000.0) p ON p.key = l.primary_key AND p.start_ts = l.start_ts WHERE l.status = 'LOCKED')"""


@query(f"""SELECT 'version' AS kind, key, commit_ts AS ts, value FROM {_FATES} WHERE fate = 'COMMITTED' UNION ALL SELECT 'write', key, commit_ts, NULL FROM {_FATES} WHERE fate = 'COMMITTED'
  UNION ALL SELECT 'lock', key, start_ts, value FROM {_FATES} WHERE fate = 'PENDING' UNION ALL SELECT 'lock', key, start_ts, value FROM {LOCKS} WHERE status <> 'LOCKED'""")
def lock_resolve(spark, d):
    versions, records, left = T.resolved(locks(spark, d), _own_writes(spark, d), NOW, 600_000.0)
    rows = lambda kind, df, ts, value: df.select(F.lit(kind).alias("kind"), "key", F.col(ts).alias("ts"), value.alias("value"))
    none = F.lit(None).cast("string")
    return rows("version", versions, "ts", F.col("value")).union(rows("write", records, "commit_ts", none)).union(rows("lock", left, "start_ts", F.col("value")))


def _database(spark, rows):
    """A database of its own with (key, value) rows."""
    from tidemark.store import Database
    from tidemark.workspace import shared_folder

    db = Database(spark, shared_folder(spark, "store"))
    db.load(rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")))
    return db


@query("""SELECT name, region FROM (SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey = 7 THEN 'O''Land' ELSE n_name END AS name, CASE WHEN n_nationkey = 7 THEN '9' ELSE n_regionkey::VARCHAR END AS region FROM nation UNION ALL SELECT '99', 'Atlantis', '2')
  WHERE id >= '1' AND id < '99x' AND region::INT >= 1""")
def sql_statement(spark, d):
    from tidemark.sql import SQL

    n = table(spark, d, "nation")
    value = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")))
    sql = SQL(_database(spark, n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), value.alias("value"))))
    sql.execute("INSERT INTO nation (id, name, region) VALUES (7, 'O''Land', 9), (99, 'Atlantis', 2)")
    return sql.execute("SELECT name, region FROM nation WHERE id >= '1' AND id < '99x' AND region >= 1;")


def _sharded(spark, d):
    db = _database(spark, order_keys(spark, d).select("key", F.col("o_totalprice").cast("string").alias("value")))
    store = db.store
    store.init_routes({0: (b"", b"orders:3"), 1: (b"orders:3", b"orders:60"), 2: (b"orders:60", None)})
    for shard in range(3):
        store.set_shard_nodes(shard, [1, 2, 3], {1: "a", 2: "b", 3: "c"})
        store.report_leader(shard, shard + 1, 4)
    return db


@query(f"SELECT key, CASE WHEN key < 'orders:3' THEN 0 WHEN key < 'orders:45' THEN 1 WHEN key < 'orders:60' THEN 9 ELSE 2 END::INT AS shard_id FROM {ORDER_KEYS}")
def split_shard(spark, d):
    db = _sharded(spark, d)
    if db.store.split_shard(1, b"orders:45", 9) or db.store.split_shard(1, b"orders:45", 9):  # the second time it is done already
        raise RuntimeError("the split was refused")
    pieces = [rows.select(F.col("key").cast("string").alias("key"), F.lit(shard).alias("shard_id")) for shard, rows in db.scan_pieces(b"", None)]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.union(piece)
    return out


@query(f"""SELECT s.shard_id AS shard_id, s.nodes AS nodes, s.leader_id AS leader_id, count(key) AS n FROM (VALUES (0, '1,2,3', 1), (1, '4,5,6', NULL), (2, '1,2,3', 3)) s(shard_id, nodes, leader_id)
  LEFT JOIN (SELECT key, CASE WHEN key < 'orders:3' THEN 0 WHEN key < 'orders:60' THEN 1 ELSE 2 END AS shard FROM {ORDER_KEYS}) ON shard = s.shard_id GROUP BY ALL""")
def move_shard(spark, d):
    db = _sharded(spark, d)
    if db.store.move_shard(1, [1, 2, 3], [4, 5, 6], {4: "d", 5: "e", 6: "f"}):
        raise RuntimeError("the move was refused")
    located = S.locate(db.scan(b"", None).select("key"), db.store.shards())
    counts = located.groupBy("shard_id").agg(F.count("*").alias("n"))
    return db.store.shards().join(F.broadcast(counts), "shard_id", "left").select("shard_id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), "leader_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT 'users:' || user_id AS key, epoch_us(ts) AS ts, count(*) AS n FROM events WHERE user_id % 10 = 3 GROUP BY ALL")
def version_keys(spark, d):
    v = event_versions(spark, d).select(K.version_key(F.col("key"), F.col("ts")).alias("versioned")).groupBy("versioned").agg(F.count("*").alias("n"))
    key, ts = K.split_version_key(F.col("versioned"))
    return v.select(key.cast("string").alias("key"), ts.alias("ts"), "n").where(F.substring("key", -1, 1) == "3")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

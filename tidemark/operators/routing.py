"""Key ranges: which shard a key belongs to, and changes of the table of shards.

A shards table has shard_id, start_key, end_key (null: no upper bound). It is small by nature (one row
per range); `locate` broadcasts it after counting its rows, and where there are more broadcasts a bounded
number of coarse ranges and joins keys with the ranges inside theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark import model as M
from tidemark.functions.keys import TOP
from tidemark.operators.transactions import code

#: A table of more ranges than this isn't turned into one expression or broadcast.
MOST_RANGES = 10_000


def default_range_map(shards: int) -> dict[int, tuple[bytes, bytes]]:
    """Equal ranges of first bytes; a single shard begins at the empty key."""
    if shards <= 1:
        return {0: (b"", TOP)}
    width = 256 // shards
    starts = [bytes([i * width]) for i in range(shards)] + [TOP]
    return {i: (starts[i], starts[i + 1]) for i in range(shards)}


def shard_rows(spark: SparkSession, ranges: dict[int, tuple]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in sorted(ranges.items())], "shard_id int, start_key binary, end_key binary")


def shard_of(key: Column, ranges: list[tuple[int, object, object]]) -> Column:
    """The shard of a key as one expression: the first range that holds it, else shard 0. A chain of
    comparisons stays inside generated code and needs no join."""
    found = F.lit(0)
    for shard_id, start, end in sorted(ranges, key=lambda r: r[1], reverse=True):
        inside = key >= F.lit(start)
        if end is not None:
            inside = inside & (key < F.lit(end))
        found = F.when(inside, F.lit(shard_id)).otherwise(found)
    return found


def locate(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """keys with their shard_id."""
    rows = shards.select("shard_id", "start_key", "end_key").orderBy("start_key").limit(MOST_RANGES + 1).collect()
    if len(rows) <= 64:
        return keys.withColumn("shard_id", shard_of(F.col("key"), [tuple(r) for r in rows]))
    inside = (F.col("key") >= F.col("start_key")) & (F.col("end_key").isNull() | (F.col("key") < F.col("end_key")))
    ranges = shards.select("shard_id", "start_key", "end_key")
    if len(rows) <= MOST_RANGES:
        ranges = F.broadcast(ranges)
        return keys.join(ranges, inside, "left").drop("start_key", "end_key").withColumn("shard_id", F.coalesce("shard_id", F.lit(0)))
    # many ranges: a bounded number of coarse ranges, each the ranges from one start to another, is
    # broadcast, and a key meets the ranges of its coarse one
    starts = [r.key for r in shards.select(F.col("start_key").alias("key")).where(F.pmod(F.xxhash64("key"), F.lit(_sampled(shards))) == 0).distinct().limit(MOST_RANGES - 1).orderBy("key").collect()]
    edges = [None, *starts, None]
    coarse = F.broadcast(keys.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))], T.StructType([T.StructField("_coarse", T.IntegerType()), T.StructField("_from", shards.schema["start_key"].dataType), T.StructField("_to", shards.schema["start_key"].dataType)])))
    below = lambda c, end: end.isNull() | (c < end)
    spread = ranges.join(coarse, below(F.col("start_key"), F.col("_to")) & (F.col("_from").isNull() | F.col("end_key").isNull() | (F.col("end_key") > F.col("_from")))).select("_coarse", "shard_id", "start_key", "end_key")
    placed = keys.join(coarse, (F.col("_from").isNull() | (F.col("key") >= F.col("_from"))) & below(F.col("key"), F.col("_to"))).drop("_from", "_to")
    return placed.join(spread.withColumnRenamed("_coarse", "_of"), (F.col("_coarse") == F.col("_of")) & inside, "left").select(*keys.columns, F.coalesce("shard_id", F.lit(0)).alias("shard_id"))


def _sampled(shards: DataFrame) -> int:
    """One of how many starts is the edge of a coarse range."""
    return 2 * shards.count() // MOST_RANGES + 1


def pruned(located: DataFrame, shards: list[tuple[int, object, object]], start, end) -> DataFrame:
    """A range scan over rows that carry their shard_id: only overlapping shards are read."""
    wanted = [i for i, a, b in shards if (end is None or a < end) and (b is None or start is None or start < b)]
    rows = located.where(F.col("shard_id").isin(wanted)) if wanted else located.where(F.lit(False))
    if start is not None:
        rows = rows.where(F.col("key") >= F.lit(start))
    return rows if end is None else rows.where(F.col("key") < F.lit(end))


def coverage_gaps(shards: DataFrame, low, high) -> DataFrame:
    """Stretches of [low, high) that no shard owns."""
    order = Window.orderBy("start_key")
    edges = shards.select("start_key", "end_key").withColumn("covered", F.coalesce(F.max("end_key").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(low)))
    gaps = edges.where(F.col("start_key") > F.col("covered")).select(F.col("covered").alias("gap_start"), F.col("start_key").alias("gap_end"))
    last = shards.agg(F.coalesce(F.max("end_key"), F.lit(low)).alias("gap_start")).where(F.col("gap_start") < F.lit(high)).withColumn("gap_end", F.lit(high))
    return gaps.union(last.select("gap_start", "gap_end"))


def leaderless(shards: DataFrame) -> DataFrame:
    """Shards without a leader."""
    return shards.where("leader_id is null").select("shard_id")


def quorum_index(matches: DataFrame) -> DataFrame:
    """shard_id, quorum: the largest log index that a majority of each shard's replicas (shard_id,
    node_id, match_index) holds."""
    held = F.sort_array(F.collect_list("match_index"), asc=False)
    return matches.groupBy("shard_id").agg(F.element_at(held, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("quorum"))


def newest_leaders(reports: DataFrame) -> DataFrame:
    """shard_id, leader_id, leader_term: the report of the newest term, of equals the first."""
    order = F.struct(F.col("term"), -F.col("seq"))
    return reports.groupBy("shard_id").agg(F.max_by("node_id", order).alias("leader_id"), F.max("term").alias("leader_term"))


def leader_codes(reports: DataFrame, shards: DataFrame, *more: str) -> DataFrame:
    """shard_id, node_id, term, code (and more columns of the reports): 4 unknown shard, 5 not a replica,
    6 not a newer term."""
    rows = reports.join(F.broadcast(shards.withColumn("known", F.lit(True))), "shard_id", "left")
    outside = (F.size("nodes") > 0) & ~F.array_contains("nodes", F.col("node_id"))
    return rows.select(*more, "shard_id", "node_id", "term", code((F.col("known").isNull(), M.NO_SHARD), (F.coalesce(outside, F.lit(False)), M.NODE_NOT_SERVING), (F.col("leader_id").isNotNull() & (F.col("term") <= F.col("leader_term")), M.STALE_LEADER)))


def split_codes(proposals: DataFrame, shards: DataFrame) -> DataFrame:
    """proposal, code: each proposal (shard_id, split_key, new_id, nodes) judged against the table alone."""
    own = shards.select("shard_id", F.col("start_key").alias("a"), F.col("end_key").alias("b"))
    taken = shards.select(F.col("shard_id").alias("new_id"), F.col("start_key").alias("ta"), F.col("end_key").alias("tb"), F.col("nodes").alias("tnodes"))
    rows = proposals.join(F.broadcast(own), "shard_id", "left").join(F.broadcast(taken), "new_id", "left")
    others = shards.select(F.col("shard_id").alias("other"), F.col("start_key").alias("oa"), F.col("end_key").alias("ob"))
    over = rows.join(F.broadcast(others), (F.col("other") != F.col("shard_id")) & (F.col("oa") < F.col("b")) & (F.col("a") < F.col("ob")) & (F.col("other") != F.col("new_id"))).select("proposal").distinct().withColumn("overlaps", F.lit(True))
    again = F.col("ta").isNotNull() & (F.col("b") == F.col("split_key")) & (F.col("ta") == F.col("split_key"))
    inside = (F.col("a") < F.col("split_key")) & (F.col("split_key") < F.col("b"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.join(over, "proposal", "left").select("proposal", code(
        (yes(again & (F.col("tnodes") == F.col("nodes"))), M.OK), (yes(again), M.SPLIT_OTHER_NODES), (F.col("ta").isNotNull(), M.SPLIT_ID_TAKEN),
        (F.col("a").isNull(), M.SPLIT_NO_SHARD), (~yes(inside), M.SPLIT_OUTSIDE), (F.col("overlaps").isNotNull(), M.SPLIT_OVERLAP),
    ))


def move_codes(proposals: DataFrame, shards: DataFrame) -> DataFrame:
    """proposal, code: each proposal (shard_id, from_nodes, nodes, addresses) judged against the table."""
    own = shards.select("shard_id", F.col("nodes").alias("held"), F.col("addresses").alias("held_at"))
    rows = proposals.join(F.broadcast(own.withColumn("known", F.lit(True))), "shard_id", "left")
    listed = F.transform("nodes", lambda n: F.element_at("addresses", n))
    bad = (F.size("nodes") == 0) | (F.size(F.array_distinct("nodes")) != F.size("nodes")) | F.exists(listed, lambda a: a.isNull())
    entries = lambda c: F.array_sort(F.transform(F.map_keys(c), lambda k: F.concat_ws("=", k.cast("string"), F.element_at(c, k))))
    same = F.col("held") == F.col("nodes")
    return rows.select("proposal", code(
        (F.col("known").isNull(), M.MOVE_NO_SHARD), (bad, M.MOVE_BAD_NODES), (same & (entries("addresses") == entries("held_at")), M.OK), (same, M.MOVE_OTHER_ADDRESSES),
        (F.col("held") != F.col("from_nodes"), M.MOVE_STALE), (F.arrays_overlap("nodes", "from_nodes"), M.MOVE_OVERLAP),
    ))


def split_rows(rows: DataFrame, shard_id: int, split_key, new_id: int) -> DataFrame:
    """Rows with their shard_id after a split; all versions go with their key."""
    moves = (F.col("shard_id") == shard_id) & (F.col("key") >= F.lit(split_key))
    return rows.withColumn("shard_id", F.when(moves, F.lit(new_id)).otherwise(F.col("shard_id")))


def missing_rows(source: DataFrame, target: DataFrame) -> DataFrame:
    """Versions (key, ts) that the target of a copy lacks."""
    return source.join(target.select("key", "ts"), ["key", "ts"], "left_anti")

"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Pivots are chosen, far from each other,
from a bounded sample; every vector is indexed, once, and the index is written to the shared folder.
Each shard (a run of vectors of bounded size) posts its vectors in inverted files, one per pivot, with
the pivot's place in the vector's order. A query opens only the files of its own `opened` nearest
pivots, adds up the footrule distances of the places there, and reranks the best share of the shard on
the original vectors in double precision; shards' best are merged.

Queries go out in blocks of at most about `block_queries`, one after the other: each is broadcast, read
against the stored index, and leaves its k best of each shard in the shared folder, so neither the plan
nor what is held grows with the queries. The number of passes over the index does, by one in
`block_queries` queries, each of which is some thousands of times more work than reading the vectors. A
join of queries and vectors on pivots was measured too: in the test tables' 64 dimensions a recall of
0.9 takes vectors posted by 8 pivots and queries by 16, that is copies of 39 % of all vectors a query.
Ties in the footrule distance are never cut, so equal vectors, however many, compete by their id.

Defined results: vectors that are null or zero, or hold a null or a non-finite component, take no
part, nor do those of another dimension than most of the sample; a query never finds rows with its
own id; a query that stands on several rows is one, and queries of one id with unlike vectors have k
results each; fewer candidates than k give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._scratch import scratch

SHARD_ROWS = 16_384


def usable(vector: Column) -> Column:
    """Whether a vector takes part in searches."""
    vector = vector.cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots by farthest-first traversal from the vector nearest to the mean."""
    chosen = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


@dataclass(frozen=True)
class PermutationIndex:
    pivots: np.ndarray
    prefix: int  # how many pivots of an order are kept
    opened: int  # how many files a query opens
    share: float  # share of a shard that is reranked
    least: int  # and at least so many rows

    def orders(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first, ties to the smaller pivot."""
        gaps = (self.pivots**2).sum(axis=1) - 2 * vectors @ self.pivots.T
        return np.argsort(gaps, axis=1, kind="stable")[:, : self.prefix]

    def add_orders(self, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """id, vector and order of every usable vector."""
        index = self

        def run(batches):
            for batch in batches:
                v = _matrix(batch.column(1))
                order = index.orders(v) if len(v) else np.empty((0, index.prefix), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order.astype(np.int16).tolist(), pa.list_(pa.int16()))], names=["id", "vector", "order"])

        rows = vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) == self.pivots.shape[1]) & F.col(id_col).isNotNull())
        return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(run, "id long, vector array<double>, order array<short>")

    def stored_index(self, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """The vectors with their orders, written to the shared folder once."""
        return scratch(self.add_orders(vectors, id_col, vector_col))

    def _search_shard(self, ids, vectors, orders, queries, k):
        """Best k of a shard for each query."""
        sort = np.argsort(ids, kind="stable")
        ids, vectors, orders = ids[sort], vectors[sort], orders[sort]
        n, m, length, opened = len(ids), len(self.pivots), orders.shape[1], min(self.opened, orders.shape[1])
        pivot, row, place = orders.ravel(), np.repeat(np.arange(n), length), np.tile(np.arange(length), n)
        by = np.argsort(pivot, kind="stable")
        row, place = row[by], place[by]
        file = np.searchsorted(pivot[by], np.arange(m + 1))
        want = min(n, max(self.least, math.ceil(self.share * n)))
        missing = opened * length - opened * (opened - 1) // 2  # of a vector that is in none of the files
        for query, vector, order in zip(*queries):
            order = order[:opened]
            rows = np.concatenate([row[file[p] : file[p + 1]] for p in order])
            change = np.concatenate([np.abs(place[file[p] : file[p + 1]] - i) - (length - i) for i, p in enumerate(order)])
            footrule = missing + np.bincount(rows, weights=change, minlength=n)
            footrule[ids == query] = np.inf
            best = np.flatnonzero(footrule <= np.partition(footrule, want - 1)[want - 1])
            best = best[np.isfinite(footrule[best])]
            distance = np.sqrt(((vectors[best] - vector) ** 2).sum(axis=1))
            top = np.lexsort((ids[best], distance))[:k]
            yield query, ids[best][top], distance[top]

    def search(self, indexed: DataFrame, queries: DataFrame, k: int = 10, block_queries: int = 4096) -> DataFrame:
        """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest found.
        indexed, and queries out of it, should be stored (`stored_index`): each block reads them."""
        count = queries.count()
        blocks = max(1, math.ceil(count / block_queries))
        spark, index, found = indexed.sparkSession, self, None
        for block in range(blocks):
            rows = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
            got = rows.select("id", "vector", "order").orderBy("id", "vector").collect()
            got = list({(r.id, tuple(r.vector)): r for r in got}.values())
            if not got and blocks > 1:
                continue
            shared = spark.sparkContext.broadcast(([r.id for r in got], np.array([r.vector for r in got]), np.array([r.order for r in got], np.int64)))

            def run(batches, shared=shared):
                held, size = [], 0

                def flush():
                    ids = np.concatenate([h[0] for h in held])
                    found = list(index._search_shard(ids, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), shared.value, k))
                    sizes = [len(f[1]) for f in found]
                    who, number = np.repeat([f[0] for f in found], sizes).astype(np.int64), np.repeat(np.arange(len(found)), sizes)
                    what = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
                    how = np.concatenate([f[2] for f in found]) if found else np.empty(0)
                    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(number, pa.int64()), pa.array(what, pa.int64()), pa.array(how, pa.float64())], names=["query_id", "number", "vec_id", "score"])

                for batch in batches:
                    if not batch.num_rows:
                        continue
                    held.append((batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)))
                    size += batch.num_rows
                    if size >= SHARD_ROWS:
                        yield flush()
                        held, size = [], 0
                if held:
                    yield flush()

            best = indexed.mapInArrow(run, "query_id long, number long, vec_id long, score double").withColumn("block", F.lit(block))
            if blocks == 1:
                found = best
            else:
                found = scratch(best, found)
                shared.unpersist()
        order = Window.partitionBy("query_id", "block", "number").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 256, prefix: int = 96, opened: int = 32, share: float = 0.1, least: int = 256, sample_rows: int = 4096) -> PermutationIndex:
    """Pivots from at most `sample_rows` usable vectors, those with the smallest hash of their id."""
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    sizes = [len(r.v) for r in rows]
    size = max(sorted(set(sizes)), key=sizes.count) if sizes else 1
    sample = np.array([r.v for r in rows if len(r.v) == size]).reshape(-1, size)
    chosen = _spread(sample, pivots) if len(sample) else np.zeros((1, size))
    return PermutationIndex(chosen, min(prefix, len(chosen)), opened, share, least)

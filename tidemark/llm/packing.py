"""Token-ID output: texts packed into rows of an id matrix by best-fit decreasing.

Texts are encoded (segments of `pieces`, by the sentencepiece library), documents longer than a row are split into row-sized pieces without
losing an id, and the pieces of a group of documents are placed longest first, each in the row with
the least room that still holds it. A segment tree over the possible amounts of room finds that row
in logarithmic time. A group is a run of whole documents with about `group_tokens` ids, so a task's
memory is bounded; rows of different groups are never mixed.

Each output row is one matrix row: the ids (little-endian unsigned 16- or 32-bit, padded to the row's
width), the cumulative segment lengths, where positions start again, and whose segments they are.
Nothing is shuffled; a task that runs again packs the same rows.

Defined results: null and empty texts are the begin and end ids alone; each row of the table is a
document of its own, even if ids repeat; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _text as X
from .pieces import MODEL_BYTES_MOST, codec_of, default_model_path


class RoomTree:
    """Segment tree over amounts of room: which amount, at least so large, some row has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.some = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = self.size + room
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room >= need, taken out, and its room."""
        some = self.some
        node = self.size + need
        if need >= len(self.rows):
            return None
        if not some[node]:
            while node > 1 and (node & 1 or not some[node + 1]):  # up, until a right neighbour has rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if some[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node:
                if node < self.size and (some[2 * node] or some[2 * node + 1]):
                    break
                some[node] = 0
                node >>= 1
        return row, room


def best_fit_decreasing(sizes: np.ndarray, width: int) -> np.ndarray:
    """The row of each piece; rows are numbered as they are opened. Sizes are 1 to width."""
    out = np.empty(len(sizes), np.int64)
    tree, rows = RoomTree(width), 0
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        found = tree.take(size)
        if found is None:
            row, room = rows, width
            rows += 1
        else:
            row, room = found
        out[i] = row
        if room > size:
            tree.add(row, room - size)
    return out


def _rows_of(ids, tokens: np.ndarray, stop: np.ndarray, width: int, pad: int, number: int, dtype: str):
    """The packed rows of a group of documents."""
    size = np.diff(np.r_[0, stop])
    parts = np.maximum(1, -(-size // width))
    doc = np.repeat(np.arange(len(size)), parts)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(stop - size, parts) + part * width
    length = np.minimum(width, np.repeat(size, parts) - part * width)
    row = best_fit_decreasing(length, width)
    order = np.lexsort((part, doc, row))
    doc, part, begin, length, row = (x[order] for x in (doc, part, begin, length, row))
    rows = int(row[-1]) + 1 if len(row) else 0
    first = np.searchsorted(row, np.arange(rows + 1))
    put = np.cumsum(length) - length
    into = row * width + put - put[first[row]]
    matrix = np.full(rows * width, pad, dtype)
    within = np.arange(length.sum()) - np.repeat(put, length)
    matrix[np.repeat(into, length) + within] = tokens[np.repeat(begin, length) + within]
    ends = np.r_[0, np.cumsum(length)]
    offsets = pa.array(first.astype(np.int32))
    cumulative = np.empty(len(length) + rows, np.int32)
    at = np.arange(len(length)) + row + 1
    cumulative[first[:-1] + np.arange(rows)] = 0
    cumulative[at] = ends[1:] - ends[first[row]]
    where = pa.array((first + np.arange(rows + 1)).astype(np.int32))
    resets = (into - row * width).astype(np.int32)
    matrix_bytes = pa.py_buffer(matrix)
    cut = np.arange(rows + 1, dtype=np.int32) * (width * matrix.itemsize)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, number)), pa.array(np.arange(rows, dtype=np.int32)), pa.array((ends[first[1:]] - ends[first[:-1]]).astype(np.int32)),
        pa.ListArray.from_arrays(where, pa.array(cumulative)), pa.ListArray.from_arrays(offsets, pa.array(resets)),
        pa.ListArray.from_arrays(offsets, ids.take(pa.array(doc))), pa.ListArray.from_arrays(offsets, pa.array(part.astype(np.int32))),
        pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(cut), matrix_bytes]),
    ], names=["group_id", "row", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "parts", "ids"])


SCHEMA = "group_id long, row int, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, parts array<int>, ids binary"


def pack_tokens(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, group_tokens: int = 2_000_000, pad: int = 0, cache_segments: int = 600_000) -> DataFrame:
    """group_id (a hash of the group's first document and its place), row, n_tokens without padding,
    cu_seqlens (from 0), position_resets, doc_ids and parts (piece numbers of a split document) of
    each segment, and ids: `width` ids of 2 bytes (4, where the vocabulary needs them)."""
    with open(model_path or default_model_path(), "rb") as f:
        model = f.read()
    if len(model) > MODEL_BYTES_MOST:
        raise ValueError(f"the model has {len(model)} bytes; at most {MODEL_BYTES_MOST} are sent to executors")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codec = codec_of(shared.value, cache_segments, True)
        dtype = "<u2" if len(codec.surface_size) <= 1 << 16 else "<u4"
        held, tokens = [], 0

        def flush():
            ids = pa.concat_arrays([h[0] for h in held])
            stops, base = [], 0
            for h in held:
                stops.append(h[2] + base)
                base += len(h[1])
            first = np.array([ids[0].as_py() or 0, len(ids)], np.int64).view(np.uint64)
            number = int(X.mix(X.mix(first[:1]) + first[1:] + X.mix(held[0][1][:64].astype(np.uint64)).sum())[0] >> np.uint64(1))
            return _rows_of(ids, np.concatenate([h[1] for h in held]), np.concatenate(stops), width, pad, number, dtype)

        for batch in batches:
            for first, data, offsets in X.slices(batch.column(1)):
                ids, stop = codec.encode_slice(data, offsets)
                held.append((batch.column(0).slice(first, len(stop)).cast(pa.int64()), ids.astype(dtype), stop))
                tokens += len(ids)
                if tokens >= group_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return X.bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def positions(resets: Column, n_tokens: Column) -> Column:
    """Position of each id of a row within its segment."""
    ends = F.concat(F.slice(resets, 2, F.size(resets)), F.array(n_tokens))
    return F.flatten(F.zip_with(resets, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files: fixed-width id rows as binary, beside their segment lists."""
    packed.write.parquet(path)

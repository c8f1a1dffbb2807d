"""Vectorised text plumbing shared by the operators of this subpackage.

Texts arrive as Arrow string columns; everything here works on their UTF-8 bytes with numpy, in
slices of bounded size, so that memory does not depend on how many rows an Arrow batch holds.

Words that are looked up are told apart by their bytes (`distinct`), not by a hash. Where something has to
stand for a word or a run of words beyond a slice, it is a keyed, chained hash (`word_hashes`, `chained`:
no polynomials, so that no texts collide by their structure). A difference of prefix sums (polynomial, modulo 2**64) is the
hash of a span in constant time; structured texts can collide in it, so it may nominate, not decide.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NULL_ID = np.iinfo(np.int64).max

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim(0)
except (OSError, AttributeError):  # another C library
    _libc = None

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers, _inverses = made
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() takes substring hashes."""
    powers, _ = _tables(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return sums


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal contents give equal hashes wherever they lie."""
    _, inverses = _tables(len(sums))
    return mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))


def span_all(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all spans of one length, by start."""
    n = len(sums) - length
    if n <= 0:
        return np.empty(0, np.uint64)
    _, inverses = _tables(len(sums))
    return mix((sums[length:] - sums[:n]) * inverses[:n] + np.uint64(length))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of whole texts of about `most` bytes together."""
    data, offsets = text_buffer(column)
    rows = len(offsets) - 1
    at = 0
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(rows, max(to, at + 1))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    del data
    give_back()


def bounded_batches(df):
    """df, after its session's Arrow batches are bounded, where it leaves them at Spark's defaults: 10,000
    long texts at once would be held several times over, by the executor and by its worker."""
    conf = df.sparkSession.conf
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")):
        if conf.get(key, None) == default:
            conf.set(key, value)
    return df


def numbered(df):
    """df with columns c0, c1 and so on: mapInArrow takes no names with dots."""
    return bounded_batches(df).toDF(*[f"c{i}" for i in range(len(df.columns))])


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, beside those of the next
    stage."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def ids_of(column) -> np.ndarray:
    """An integer column as int64; null as NULL_ID, which sorts last."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def ids_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def byte_class(*members) -> np.ndarray:
    """A table of 256 booleans, true for the bytes given singly or as (first, last)."""
    table = np.zeros(256, bool)
    for m in members:
        first, last = m if isinstance(m, tuple) else (m, m)
        table[first : last + 1] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes, texts kept apart, and the n + 1 offsets of
    each text's words."""
    inside = in_word[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.empty(len(data) + 1, bool)
    if len(data):
        stops[:-1] = ~inside
        stops[firsts] = True
    stops[-1] = True
    ends_all = np.flatnonzero(stops)
    ends = ends_all[np.searchsorted(ends_all, starts, side="right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which of the distinct spans each span is, and those spans as binary. Spans must ascend and not
    overlap; they are compared byte by byte."""
    size = ends - starts
    total = int(size.sum())
    if total != len(data):
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[size > 0]] += 1
        np.subtract.at(edge, ends[size > 0], 1)
        data = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    wide = total >= 1 << 31
    spans = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(size), [None, pa.py_buffer(at if wide else at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    found = spans.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """Keyed 64-bit hashes of spans: of their lengths and eight bytes after eight, chained; of very long
    ones BLAKE2."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) + mix(np.array([key], np.uint64)))
    long = np.flatnonzero(size > 256)
    at, left, row = starts, size, np.arange(len(size))
    if len(long):
        row = np.flatnonzero((size > 0) & (size <= 256))
        at, left = starts[row], size[row]
    while len(row):
        block = eight[at]
        part = left < 8
        block[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        before = h[row]
        h[row] = mix((before ^ block) * _ODD + (before >> np.uint64(32)))
        more = left > 8
        at, left, row = at[more] + 8, left[more] - 8, row[more]
    secret = key.to_bytes(8, "little")
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return h


def chained(columns, seed: int) -> np.ndarray:
    """Hash of each row of the given columns of 64-bit numbers, one after the other."""
    h = mix(np.full(1, seed, np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for column in columns:
        h = mix((h ^ column) * _ODD + (h >> np.uint64(32)))
    return h


def as_numbers(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes or 64-bit numbers as columns of 64-bit numbers, padded with zeros."""
    if rows.dtype == np.uint64:
        return rows.T
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(np.uint64).T


def equal_rows(rows: np.ndarray) -> np.ndarray:
    """A number for each row; equal rows, and only they, have the same."""
    if not len(rows):
        return np.empty(0, np.int64)
    _, first, group = np.unique(chained(as_numbers(rows), 3), return_index=True, return_inverse=True)
    for at in range(0, len(rows), 1 << 14):
        if not np.array_equal(rows[at : at + (1 << 14)], rows[first[group[at : at + (1 << 14)]]]):
            return np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    return group


def place_of(columns: list[str], name: str) -> int:
    """Where a column stands; names are told apart as Spark does by default, whatever their case."""
    return [c.lower() for c in columns].index(name.lower())


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that columns have already."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def rows_of(table: pa.Table, column: str, dtype) -> np.ndarray:
    """The records of all packed blobs of a column, as one array."""
    blobs = [b.as_buffer() for b in table.column(column) if b.is_valid]
    blobs = [b for b in blobs if b is not None and b.size]
    if not blobs:
        return np.empty(0, dtype)
    return np.concatenate([np.frombuffer(b, dtype) for b in blobs])


def by_key(keys: np.ndarray, records: np.ndarray):
    """(key, records of that key) for each key; records keep their order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, records = keys[order], records[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for part, at in zip(np.split(records, cuts), np.r_[0, cuts]):
        yield int(keys[at]), part

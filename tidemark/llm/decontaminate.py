"""Benchmark decontamination: an FM-index per shard of the training text, asked for test phrases.

A shard is a run of whole documents of bounded size. Its words become numbers of the benchmark's
vocabulary, by their bytes; a word outside it can be in no test phrase and ends a stretch. The
stretches long enough for a phrase are indexed: suffix array, Burrows-Wheeler transform, wavelet
matrix for ranks, and the suffix positions that are multiples of `_SAMPLE`. All phrases step backwards
through the ranks together; those with rows left are located by walking to the next sampled position,
and their words are marked and merged into removal spans.

The benchmark is cut into blocks of at most about `block_bytes` of text by a hash of its item, after its
size has been measured. A block goes to the executors as the numbers of its words and the places where
its distinct phrases begin, some eight bytes a word. Between two blocks the documents with the hits so
far are written to the shared folder, so one block is out at a time whatever the benchmark's size.
Documents are never shuffled, and for a benchmark of one block not written either.

Defined results: null or word-free texts and items have no words and no hits (and a null text stays
null); items without an id are left out unless asked for; an item id that stands on several rows is one
item; rows keep all their columns, whose names must differ from those added (`names` renames these).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text as X
from ._scratch import drop, scratch

IN_WORD = ~X.byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHARD_BYTES = 1 << 19
_SAMPLE = 8


def lowered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words: which of the distinct ones each is, these, starts, ends, and each text's
    first word."""
    data = LOWER[data]
    starts, ends, at = X.words(data, offsets, IN_WORD)
    which, words = X.distinct(data, starts, ends)
    return which, words, starts, ends, at


def _window_names(symbols: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of `length` symbols; equal runs have the same (names of runs twice as long
    are made of pairs)."""
    names, depth = symbols.astype(np.int64), 1
    while depth < length:
        step = min(depth, length - depth)
        names = np.unique(names[:-step] << 32 | names[step:], return_inverse=True)[1]
        depth += step
    return names


class Phrases:
    """The distinct windows of a block of benchmark items: numbers of words over the block's own
    vocabulary (from 1), where each phrase begins in them, its length, and its items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        data, offsets = X.text_buffer(pa.array([t for _, t in items], pa.string()))
        which, self.vocabulary, _, _, at = lowered_words(data, offsets)
        self.window, self.words = window, which.astype(np.int32) + 1
        size = np.diff(at)
        of_item, starts, names = [], [], []
        long = np.flatnonzero(size >= window)
        if len(long):
            count = size[long] - window + 1
            starts.append(np.repeat(at[long] - (np.cumsum(count) - count), count) + np.arange(count.sum()))
            of_item.append(np.repeat(long, count))
            names.append(_window_names(self.words, window)[starts[0]])
        short = np.flatnonzero((size > 0) & (size < window))
        if len(short):
            seen: dict[bytes, int] = {}
            first = int(names[0].max()) + 1 if names else 0
            starts.append(at[short])
            of_item.append(short)
            names.append(np.array([first + seen.setdefault(self.words[at[i] : at[i + 1]].tobytes(), len(seen)) for i in short.tolist()]))
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (of_item, starts, names)]
        of_item, starts, names = joined
        _, one, phrase = np.unique(names, return_index=True, return_inverse=True)
        self.starts, self.lengths = starts[one], np.minimum(size[of_item[one]], window)
        self.shortest = int(self.lengths.min()) if len(one) else 0
        # the named items of each phrase, one after the other
        known = sorted({n for n, _ in items if n is not None})
        number = {n: i for i, n in enumerate(known)}
        item = np.array([-1 if n is None else number[n] for n, _ in items], np.int64)[of_item]
        pairs = np.unique(phrase[item >= 0] << 32 | item[item >= 0])
        self.names, self.items = known, pairs & 0xFFFFFFFF
        self.items_at = np.searchsorted(pairs >> 32, np.arange(len(one) + 1))

    def symbol(self, phrase: np.ndarray, step: int) -> np.ndarray:
        """The word that is `step` words before the end of each phrase (1: its last)."""
        return self.words[self.starts[phrase] + self.lengths[phrase] - step].astype(np.int64)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; symbol 0 ends a stretch, and each end is unlike the others."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + n
    ends = np.flatnonzero(symbols == 0)
    rank[ends] = np.arange(len(ends))
    _, rank = np.unique(rank, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        tied = np.r_[False, sorted_rank[1:] == sorted_rank[:-1]]
        if not tied.any():
            return order
        # only suffixes that still tie are sorted again
        group = tied | np.r_[tied[1:], False]
        rows = np.flatnonzero(group)
        which = order[rows]
        later = np.where(which + step < n, rank[np.minimum(which + step, n - 1)] + 1, 0)
        again = np.lexsort((later, rank[which]))
        order[rows] = which[again]
        first, second = rank[which][again], later[again]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        # a rank is the place of the first of its equals
        rank = rank.copy()
        place = np.zeros(len(rows), np.int64)
        place[new] = rows[new]
        rank[order] = np.where(group, 0, np.arange(n))
        rank[order[rows]] = np.maximum.accumulate(place)
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        """symbols: numbers from 1, and 0 after each stretch."""
        n = len(symbols)
        self.size = n
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.bits = max(1, int(symbols.max()).bit_length()) if n else 1
        self.levels, level = [], last
        for bit in range(self.bits - 1, -1, -1):
            ones = (level >> bit) & 1
            counts = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((counts, n - int(counts[-1])))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        self.first = np.zeros((1 << self.bits) + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=1 << self.bits), out=self.first[1:])
        self.last = last
        self.sampled = (order % _SAMPLE == 0) | (last == 0)  # no step crosses the end of a stretch
        self.sample_rank = np.r_[0, np.cumsum(self.sampled)]
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of the first `row` symbols of the transform are `symbol`."""
        low = np.zeros_like(row)
        for bit, (counts, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            one = (symbol >> bit) & 1 == 1
            ones_row, ones_low = counts[row], counts[low]
            row = np.where(one, zeros + ones_row, row - ones_row)
            low = np.where(one, zeros + ones_low, low - ones_low)
        return row - low

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and their rows [from, to)."""
        alive = np.arange(len(phrases.lengths))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.size, np.int64)
        done: list[tuple] = []
        for step in range(1, phrases.window + 1):
            symbol = phrases.symbol(alive, step)
            known = symbol < (1 << self.bits)
            alive, low, high, symbol = alive[known], low[known], high[known], symbol[known]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
            left = high > low
            alive, low, high = alive[left], low[left], high[left]
            over = phrases.lengths[alive] == step
            done.append((alive[over], low[over], high[over]))
            alive, low, high = alive[~over], low[~over], high[~over]
            if not len(alive):
                break
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps back to a sampled one."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        open_ = np.flatnonzero(~self.sampled[row])
        while len(open_):
            r = row[open_]
            symbol = self.last[r]
            row[open_] = self.first[symbol] + self.rank(symbol, r)
            steps[open_] += 1
            open_ = open_[~self.sampled[row[open_]]]
        return self.samples[self.sample_rank[row]] + steps


def occurrences(phrases: Phrases, which: np.ndarray, words: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, phrase) of each place of the shard's words where a phrase begins."""
    none = np.empty(0, np.int64)
    if not len(phrases.lengths) or not len(which):
        return none, none
    number = pc.fill_null(pc.index_in(words, value_set=phrases.vocabulary), -1).to_numpy().astype(np.int64)[which] + 1
    inside = number > 0
    breaks = np.ones(len(number), bool)
    breaks[1:] = ~inside[:-1]
    breaks[at[:-1][at[:-1] < len(number)]] = True
    start = np.flatnonzero(inside & breaks)
    stop = np.flatnonzero(inside & np.r_[~inside[1:] | breaks[1:], True]) + 1
    long_enough = stop - start >= phrases.shortest
    start, stop = start[long_enough], stop[long_enough]
    if not len(start):
        return none, none
    size = stop - start + 1
    put = np.cumsum(size) - size
    places = np.arange(size.sum()) - np.repeat(put - start, size)  # the word at each symbol
    symbols = number[np.minimum(places, len(number) - 1)]
    symbols[put + size - 1] = 0
    index = FMIndex(symbols)
    found, low, high = index.search(phrases)
    if not len(found):
        return none, none
    count = high - low
    row = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return places[index.locate(row)], np.repeat(found, count)


_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ADDED = ("n_words", "n_hit", "hit_spans", "items", "kept")


def _earlier_hits(edge: np.ndarray, spans: pa.Array, at: np.ndarray) -> None:
    """Adds the spans found by blocks before."""
    number = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy())
    flat = spans.flatten()
    np.add.at(edge, at[number] + flat.field("start").to_numpy(), 1)
    np.add.at(edge, at[number] + flat.field("end").to_numpy(), -1)


def _without(data: np.ndarray, offsets: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, text: pa.Array) -> pa.Array:
    """The texts without the bytes from each first up to its last; null stays null."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[firsts] += 1
    edge[lasts] -= 1
    stay = np.cumsum(edge[:-1], dtype=np.int8) == 0
    left = np.r_[0, np.cumsum(stay)][offsets]
    made = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[stay])).cast(pa.string())
    return pc.if_else(text.is_valid(), made, pa.scalar(None, pa.string())) if text.null_count else made


def _scan(phrases: Phrases, at_text: int, again: bool, cut: bool, names: list[str], columns: list[str]):
    """Adds the hits of a block of phrases; again: to those of blocks before, in the last columns. cut:
    adds the text without its hit words too; what stands between two of them in one span goes with
    them."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in X.slices(batch.column(at_text), SHARD_BYTES):
                rows = len(offsets) - 1
                own = batch.slice(first, rows)
                which, words, starts, ends, at = lowered_words(data, offsets)
                word, phrase = occurrences(phrases, which, words, at)
                edge = np.zeros(len(which) + 1, np.int64)
                np.add.at(edge, word, 1)
                np.add.at(edge, word + phrases.lengths[phrase], -1)
                found: list[set] = [set() for _ in range(rows)]
                doc = np.searchsorted(at, word, side="right") - 1
                for pair in np.unique((doc << 32) | phrase).tolist():
                    p = pair & 0xFFFFFFFF
                    found[pair >> 32].update(phrases.names[i] for i in phrases.items[phrases.items_at[p] : phrases.items_at[p + 1]].tolist())
                carried = own.columns
                if again:
                    _earlier_hits(edge, carried[-2], at)
                    for r, before in enumerate(carried[-1].to_pylist()):
                        found[r].update(before)
                    carried = carried[:-4]
                hit = np.cumsum(edge[:-1]) > 0
                total = np.r_[0, np.cumsum(hit)]
                # a span begins at a hit word that none of its text comes before
                before, after = np.r_[False, hit[:-1]], np.r_[hit[1:], False]
                before[at[:-1][at[:-1] < len(hit)]] = False
                after[at[1:][at[1:] > 0] - 1] = False
                begin, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
                of = np.searchsorted(at, begin, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array(begin - at[of]), pa.array(end - at[of])], ["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, at).astype(np.int32)), spans).cast(_SPAN_LIST)
                added = [pa.array(np.diff(at), pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), spans, pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                if cut:
                    added.append(_without(data, offsets, starts[begin], ends[end - 1], own.column(at_text)))
                yield pa.RecordBatch.from_arrays([*carried, *added], names=[*columns, *names[: len(added)]])

    return run


def with_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, with_text: bool = False, block_bytes: int = 4 << 20, unnamed: bool = False, names: tuple[str, ...] = _ADDED) -> DataFrame:
    """The rows of docs with all their columns and n_words, n_hit, hit_spans (of words, end exclusive,
    merged), items (ids as strings of the items with occurring windows, sorted) and, with_text, kept:
    the text without the hit spans. names: other names for these five. With unnamed, items without an id
    mark hits too and add nothing to items."""
    names = list(names)
    taken = {n.lower() for n in names} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"docs has columns {sorted(taken)}; rename them")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    if not unnamed:
        items = items.where("item is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    at = X.place_of(docs.columns, text_col)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    types = [T.LongType(), T.LongType(), T.ArrayType(span), T.ArrayType(T.StringType()), T.StringType()]
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(n, t) for n, t in zip(names, types)]
    spark, columns, out, before = docs.sparkSession, docs.columns, docs, None
    for block in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64(F.coalesce("item", "text")), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Phrases([tuple(r) for r in rows.collect()], window))
        last = block == blocks - 1
        cut = with_text and last
        run = lambda batches, shared=shared, again=block > 0, cut=cut: _scan(shared.value, at, again, cut, names, columns)(batches)
        out = X.numbered(out).mapInArrow(run, T.StructType(fields if cut else fields[:-1]))
        if not last:
            out = scratch(out)
            shared.unpersist()
            if before is not None:
                drop(before)
            before = out
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """id_col and what with_contamination adds."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return with_contamination(source, benchmark, "_text", with_text=with_text, **options).drop("_text")

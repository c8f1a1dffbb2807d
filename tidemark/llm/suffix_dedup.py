"""Suffix-array dedup: cut every byte that a 50-byte string of an earlier document covers.

Prefix-free parsing after a rolling hash: triggers cut each text into overlapping phrases
(`repeats`), equal phrases become one dictionary entry that carries the smallest document of its
occurrences, and a suffix array of the dictionary, sorted to the depth of a window, puts the windows
of phrases that differ as a whole into corpus order, where equal windows are neighbours. The parse
itself stays with the documents: each occurrence knows its entry, so a window's verdict is that of
its dictionary suffix. Phrases found once in the corpus never leave their document's chunk. No suffix array
of the parse is needed or built: a window never reaches beyond the phrase around its trigger.

Defined results: a null text counts as empty; texts under `min_bytes` keep everything; a null id
sorts after all others; rows with the same id are no repeats of each other; columns besides the id
and the text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._text import NULL_ID
from .repeats import Rule, _group_starts, remove_repeats


def window_ranks(texts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes of the rows of `texts` (bytes), compared to the depth `length`: a suffix
    array by prefix doubling, from eight packed bytes up. One row per text, one column per start."""
    wide = texts.astype(np.uint64)
    depth, keys = 1, wide
    while depth < 8 and 2 * depth <= length:  # packing needs no sort
        keys = (keys[:, :-depth] << np.uint64(8 * depth)) | keys[:, depth:]
        depth *= 2
    rank = np.unique(keys, return_inverse=True)[1].reshape(keys.shape).astype(np.uint64)
    while depth < length:
        step = min(depth, length - depth)
        keys = (rank[:, :-step] << np.uint64(32)) | rank[:, step:]
        rank = np.unique(keys, return_inverse=True)[1].reshape(keys.shape).astype(np.uint64)
        depth += step
    return rank


def _suffix_array(rule: Rule, phrases: np.ndarray, least: np.ndarray, total: np.ndarray):
    """Smallest document, and number of occurrences, of each window of each dictionary phrase."""
    offsets = np.arange(rule.context - rule.length + 1)
    valid = (offsets >= phrases["lo"][:, None]) & (offsets <= phrases["hi"][:, None])
    lows, totals = np.full(valid.shape, NULL_ID), np.zeros(valid.shape, np.int64)
    # phrases of one trigger stay together, as only they can share a window
    fps = phrases["fp"]
    order = np.argsort(fps, kind="stable")
    cuts = np.r_[_group_starts(fps[order]), len(order)]
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + max(1, 1_500_000 // rule.context), side="right")) - 1)
        rows = order[cuts[at] : cuts[to]]
        rank = window_ranks(phrases["text"][rows], rule.length)
        r, o = np.nonzero(valid[rows])
        key = rank[r, o]
        sort = np.argsort(key, kind="stable")
        starts = _group_starts(key[sort])
        size = np.diff(np.r_[starts, len(sort)])
        r, o = rows[r[sort]], o[sort]
        lows[r, o] = np.repeat(np.minimum.reduceat(least[r], starts), size)
        totals[r, o] = np.repeat(np.add.reduceat(total[r], starts), size)
        at = to
    return lows, totals


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50, chunks: int | None = None, **sizes) -> DataFrame:
    """id_col, n_bytes, n_removed, removed_spans (bytes, end exclusive, maximal) and kept (binary).

    Removed is each byte covered by a string of `min_bytes` bytes that also starts in a row with a
    smaller id, judged on the input.
    """
    gram = max(1, min(20, min_bytes - 8))
    out = remove_repeats(docs, Rule(min_bytes, gram, words=False, earlier=True), _suffix_array, id_col, text_col, chunks, **sizes)
    return out.select(F.col("id").alias(id_col), F.col("units").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("removed_spans"), "kept")

"""Substring dedup: cut every word covered by a run of 35 words that stands anywhere else too.

The reference shards are the buckets of `repeats`: each holds, once, the phrases around its share of
the repeated triggers. A shard's suffix automaton is built over those phrases with the number of
their occurrences; the phrases of the documents are streamed through it for matching statistics, and
windows whose automaton state occurs more than once are removed. Sending every document past every
shard would be quadratic in the corpus; dealing shards out by trigger means a phrase meets the one
shard that can hold its match. Phrases equal as a whole need no automaton and are settled by count.

Defined results: null and blank texts have no words; words are runs of anything but ASCII white
space; a window repeated within one text counts; rows with the same id are different documents;
columns besides the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .repeats import Rule, _group_starts, remove_repeats

#: Stands for a phrase's trigger, so that a match cannot shift against it.
_TRIGGER = -1


class SuffixAutomaton:
    """Generalised suffix automaton with the (weighted) number of occurrences of each state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]
        self.last = 0

    def add(self, sequence, weight: int) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for symbol in sequence:
            if symbol in nexts[last]:
                q = nexts[last][symbol]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, symbol)
                count[last] += weight
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p >= 0 and symbol not in nexts[p]:
                nexts[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
            last = new

    def _clone(self, p: int, q: int, symbol) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.count.append(0)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def finish(self) -> None:
        """Counts of longer states go to the states of their suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def statistics(self, sequence, window: int) -> list[int]:
        """For each end of a window in the sequence: how often that window occurs (0: it's no match)."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        out = []
        for i, symbol in enumerate(sequence):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i + 1 >= window:
                out.append(count[state] if matched >= window else 0)
        return out


def _automata(rule: Rule, phrases: np.ndarray, least: np.ndarray, total: np.ndarray):
    offsets = rule.context - rule.length + 1
    totals = np.zeros((len(phrases), offsets), np.int64)
    order = np.argsort(phrases["fp"], kind="stable")
    cuts = np.r_[_group_starts(phrases["fp"][order]), len(order)]
    centre = rule.length - rule.gram
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = order[a:b]
        names = np.unique(phrases["text"][rows], return_inverse=True)[1].reshape(len(rows), -1)
        # a symbol that only one phrase has cannot be part of a match
        names[:, centre] = _TRIGGER
        lo, hi = phrases["lo"][rows].tolist(), phrases["hi"][rows].tolist()
        sequences = [s[x : y + rule.length] for s, x, y in zip(names.tolist(), lo, hi)]
        shard = SuffixAutomaton()
        for s, w in zip(sequences, total[rows].tolist()):
            shard.add(s, w)
        shard.finish()
        for r, s, x in zip(rows.tolist(), sequences, lo):
            found = shard.statistics(s, rule.length)
            totals[r, x : x + len(found)] = found
    return np.zeros_like(totals), totals


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35, chunks: int | None = None, **sizes) -> DataFrame:
    """id_col, n_words, n_removed, removed_spans (of words, end exclusive, maximal) and kept (the
    remaining words joined by one space).

    Removed is each word covered by a window of `min_words` words whose sequence also starts
    anywhere else, judged on the input.
    """
    gram = max(1, min(12, min_words // 2))
    out = remove_repeats(docs, Rule(min_words, gram, words=True, earlier=False), _automata, id_col, text_col, chunks, **sizes)
    return out.select(F.col("id").alias(id_col), F.col("units").alias("n_words"), F.col("removed").alias("n_removed"), F.col("spans").alias("removed_spans"), F.decode("kept", "UTF-8").alias("kept"))

"""Suffix-array and substring dedup against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import repeats
from tidemark.llm.substring_dedup import SuffixAutomaton, substring_dedup
from tidemark.llm.suffix_dedup import suffix_array_dedup, window_ranks

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3):
    pick = random.Random(seed)
    vocabulary = ["the", "été", "of", "日本", "a"] + ["".join(pick.choices("abcdefgh", k=pick.randint(2, 7))) for _ in range(150)]
    text = lambda n: " ".join(pick.choices(vocabulary, k=n))
    shared = [text(n) for n in (60, 45, 36, 35, 34, 12)]
    docs = [text(pick.randint(0, 90)) for _ in range(60)]
    for s in shared:
        for i in pick.sample(range(60), 4):
            docs[i] = docs[i][: len(docs[i]) // 2] + " " + s + " " + docs[i][len(docs[i]) // 2 :]
    docs += [docs[1], docs[5], docs[5] + " tail", "x" * 200, "x" * 120, "ab" * 80, "", " ", "short", text(3) + " " + shared[0] + " " + shared[0]]
    return [(i, t) for i, t in enumerate(docs)] + [(1000, None), (1001, "  \n " + shared[2] + "\t")]


def removed_bytes(rows, length):
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        out[i] = (len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g), len(re.findall(b"\1+", bytes(gone))))
    return out


def removed_words(rows, length):
    words = {i: SPACE.findall(t or "") for i, t in rows}
    seen = Counter(tuple(w[j : j + length]) for w in words.values() for j in range(len(w) - length + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.fixture(params=[200, 2])
def hot(request, monkeypatch):
    """Also with nearly every trigger dealt out by window."""
    monkeypatch.setattr(repeats, "HOT_TRIGGER", request.param)


@pytest.mark.parametrize("length", [50, 20])
def test_bytes_covered_by_an_earlier_document(spark, hot, length):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept), len(r.removed_spans)) for r in suffix_array_dedup(df, min_bytes=length, chunks=7).collect()}
    assert got == removed_bytes(rows, length)


@pytest.mark.parametrize("length", [35, 10])
def test_words_covered_by_a_repeated_window(spark, hot, length):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(df, min_words=length, chunks=5).collect()}
    assert got == removed_words(rows, length)


@pytest.mark.parametrize("length", [255, 256, 257, 300, 1000])
def test_long_windows(spark, hot, length):
    pick = random.Random(length)
    text = lambda n: "".join(pick.choices("abcdefgh ", k=n))
    shared = [text(n) for n in (length - 1, length, length + 1, length + 40, 2 * length + 7)]
    rows = [(i, text(pick.randint(0, 60)) + s + text(pick.randint(0, 60))) for i, s in enumerate(shared + shared[1:] + [shared[3][:length] + "!" + shared[4][5:]])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept), len(r.removed_spans)) for r in suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=length, chunks=3).collect()}
    assert got == removed_bytes(rows, length)
    rows = [(i, " ".join(t)) for i, t in rows]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=length, chunks=3).collect()}
    assert got == removed_words(rows, length)


@pytest.mark.parametrize("k", [10, 11, 12])
def test_texts_built_to_collide(spark, hot, k):
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    say = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"{say} {a} {say}"), (2, f"{say} {b} {say}"), (3, f"{a} {b}"), (4, " ".join(a)), (5, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(df).collect()} == removed_words(rows, 35)
    for length in (50, 2**k):
        got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept), len(r.removed_spans)) for r in suffix_array_dedup(df, min_bytes=length).collect()}
        assert got == removed_bytes(rows, length)


def test_null_and_equal_ids(spark):
    same = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, same), (5, same), (5, same), (9, "other")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in suffix_array_dedup(df).collect())
    n = len(same.encode())
    assert got == [(False, 5, 0), (False, 5, 0), (False, 9, 0), (True, None, n)]
    assert sorted(r.n_removed for r in substring_dedup(df).collect()) == [0, 40, 40, 40]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(df).collect() == substring_dedup(df).collect() == []


def test_a_very_long_text(spark):
    text = "".join(random.Random(1).choices("abcdefghijklmnop ", k=2_500_000))
    df = spark.createDataFrame([(1, text), (2, "new|" + text[1_000_000:1_000_300] + "|end")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_array_dedup(df).collect()} == {1: 0, 2: 300}


def test_many_copies_and_a_common_line(spark):
    line = "this licence line stands in very many documents of the corpus, word for word"
    rows = [(i, f"{i} unlike {i * 7919} {line} {i * 31337} others {i}") for i in range(700)] + [(1000 + i, "copy " * 30) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept), len(r.removed_spans)) for r in suffix_array_dedup(df).collect()}
    assert got == removed_bytes(rows, 50)


def test_suffix_ranks_order_as_bytes_do():
    pick = np.random.default_rng(0)
    for length in (1, 3, 8, 13, 50):
        texts = pick.integers(97, 100, (20, length + 9), dtype=np.uint8)
        rank = window_ranks(texts, length)
        flat = sorted((texts[i, o : o + length].tobytes(), rank[i, o]) for i in range(20) for o in range(10))
        assert all((a[0] < b[0]) == (a[1] < b[1]) for a, b in zip(flat, flat[1:]))


def test_the_automaton_counts_occurrences():
    pick = random.Random(5)
    for _ in range(60):
        texts = [[pick.randint(0, 2) for _ in range(pick.randint(1, 14))] for _ in range(4)]
        shard = SuffixAutomaton()
        for t in texts:
            shard.add(t, 1)
        shard.finish()
        for window in (1, 2, 4):
            seen = Counter(tuple(t[j : j + window]) for t in texts for j in range(len(t) - window + 1))
            for t in texts:
                assert shard.statistics(t, window) == [seen[tuple(t[j : j + window])] for j in range(len(t) - window + 1)]

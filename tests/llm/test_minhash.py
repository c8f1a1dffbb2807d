"""Near-duplicate classes against brute force."""

import random
import re

import numpy as np

from pyspark.sql import functions as F

from tidemark.llm.minhash import DartMinHash, components, near_duplicates, one_of_each

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def classes(rows, threshold=0.8):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited(pick, words, changes):
    words = list(words)
    for _ in range(changes):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return words


def test_signatures_agree_as_often_as_sets_are_similar():
    pick = np.random.default_rng(0)
    hasher = DartMinHash(2048)
    a = pick.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.r_[a[:240], pick.integers(0, 2**63, 60, dtype=np.uint64)]
    s = hasher.signatures(np.r_[a, b], np.ones(600), np.array([0, 300, 600]))
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.04
    w, v = pick.random(300) * 4, pick.random(300) * 4
    s = hasher.signatures(np.r_[a, a], np.r_[w, v], np.array([0, 300, 600]))
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04
    one = hasher.signatures(a[:1], np.ones(1), np.array([0, 1]))
    assert len(np.unique(one)) == 2048


def test_signatures_do_not_depend_on_neighbours():
    pick = np.random.default_rng(1)
    e = pick.integers(0, 2**63, 50, dtype=np.uint64)
    hasher = DartMinHash(64)
    alone = hasher.signatures(e, np.ones(50), np.array([0, 50]))
    beside = hasher.signatures(np.r_[e[:3], e], np.ones(53), np.array([0, 3, 53]))
    assert (alone[0] == beside[1]).all()


def test_classes_of_copies_near_copies_and_chains(spark):
    pick = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = pick.choices(vocabulary, k=200)
        rows += [" ".join(base)] * 3
        chain = base
        for _ in range(5):  # each near the last one, the ends far apart
            chain = edited(pick, chain, 3)
            rows.append(" ".join(chain))
        rows.append(" ".join(edited(pick, base, 40)))
    rows += [" ".join(pick.choices(vocabulary, k=n)) for n in (1, 2, 4, 5, 6, 2000)] + ["", None, "  ", "Same, five words right here!", "same five WORDS right here"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(pick.sample(rows, len(rows)))]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, class_id int")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == classes(rows)


def test_a_large_group_of_near_copies(spark):
    pick = random.Random(3)
    base = [f"w{pick.randrange(1000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(pick, base, 3))) for i in range(300)] + [(1000 + i, " ".join(f"u{pick.randrange(9999)}" for _ in range(60))) for i in range(50)]
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == classes(rows)


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id)) for r in near_duplicates(df).collect()) == [("3", "3"), ("None", "3"), ("None", "None")]


def test_rows_that_share_an_id_but_not_a_text(spark):
    pick = random.Random(4)
    a, b, c = ([f"{x}{i}" for i in range(80)] for x in "abc")
    near = lambda w: " ".join(edited(pick, w, 1))
    rows = [(1, " ".join(a)), (7, near(a)), (2, " ".join(b)), (7, near(b)), (None, near(c)), (None, " ".join(a)), (9, " ".join(c)), (None, "alone by itself here now"), (7, ""), (7, None), (2, " ".join(b))]
    want = sorted(map(str, [(1, 1), (7, 1), (2, 2), (7, 2), (None, 9), (None, 1), (9, 9), (None, None), (7, 7), (7, 7), (2, 2)]))
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(str((r.doc_id, r.class_id)) for r in near_duplicates(df).collect()) == want
        left = one_of_each(df.withColumn("mark", F.lit(1)))
        assert left.columns == ["doc_id", "text", "mark"]
        assert sorted(str(tuple(r)[:2]) for r in left.collect()) == sorted(map(str, [rows[0], rows[2], rows[6], rows[7], rows[8], rows[9]]))


def test_very_long_texts_and_hubs_of_many_pairs(spark, monkeypatch):
    from tidemark.llm import minhash

    monkeypatch.setattr(minhash, "PAIRS_AT_ONCE", 3)
    pick = random.Random(5)
    long = [f"w{pick.randrange(50_000)}" for _ in range(120_000)]
    base = [f"v{pick.randrange(1000)}" for _ in range(100)]
    rows = [(1, " ".join(long)), (2, " ".join(edited(pick, long, 500))), (3, " ".join(long[:80_000]))] + [(10 + i, " ".join(edited(pick, base, 1))) for i in range(40)]
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == classes(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}

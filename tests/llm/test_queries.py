"""The registered queries themselves, on the smallest tables: against their SQL, or brute force."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece
from test_minhash import classes
from test_texts import ASSIGN, distance

from tidemark.llm import queries as Q, toxicity as T
from tidemark.llm.pieces import default_model_path

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{DATA}/documents.parquet")
    return {int(i): t or "" for i, t in zip(d.doc_id, d.text)}


@pytest.fixture(scope="module")
def run(spark):
    def rows(name):
        return Q.queries()[name](spark, DATA).collect()

    return rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_a_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = Q.queries()[name](spark, DATA)
    cursor = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want


def test_op2(run, texts):
    assert {r.doc_id: r.class_id for r in run("op2_minhash_near_dedup")} == classes(list(texts.items()))


def brute_score(model, text):
    """Features and score of a text by comparing every word with every entry."""

    def find(word):
        found = []
        for i, (entry, stem) in enumerate(model.entries):
            edits = 0 if stem and word.startswith(entry) else distance(word, entry)
            if edits <= T.edits_allowed(entry, stem) and (not stem or edits == 0):
                found.append((edits, stem, i))
        best = min(found, default=None)
        return None if best is None or (best[0] and word in model.own_words) else (best[2], best[0])

    sep = T._separators()
    plain = "".join(" " if ord(c) < 0x20000 and sep[ord(c)] else c for c in text)
    spans = [m.span() for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", plain)]
    hits = [(k, find(plain[a:b].lower())) for k, (a, b) in enumerate(spans)]
    hits = [(k, *h) for k, h in hits if h]
    out, counts = [0.0] * T.FEATURES, []
    for k, entry, edits in hits:
        first, last = max(k - T.WINDOW, 0), min(k + T.WINDOW, len(spans) - 1)
        before, after = text[spans[first][0] : spans[k][0]], text[spans[k][1] : spans[last][1]]
        near = set(before.lower().split()) | set(after.lower().split())
        quoted = (sum(before.count(q) for q in T.QUOTES) % 2 == 1 and any(q in after for q in T.QUOTES)) or bool(near & T.REPORTING)
        count = model.credits[entry] if edits else 1.0
        counts.append((k, count, edits > 0))
        out[(2 if quoted else 0 if near & T.ADDRESS else 1) + 3 * (edits > 0)] += count * model.strengths[entry]
    if hits:
        out[:6] = [math.log1p(x) for x in out[:6]]
        out[6] = max(math.log1p(sum(c for j, c, _ in counts if k <= j <= k + T.WINDOW)) for k, _, _ in counts)
        out[7], out[8] = (math.sqrt(sum(c for _, c, e in counts if e or every) / len(spans)) for every in (True, False))
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], out))
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_op3(spark, run, texts):
    model = T.fit_toxicity(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = run("op3_toxicity")
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
        assert abs(r.score - brute_score(model, texts[r.doc_id])) < 1e-9


def test_scores_of_misspelled_and_quoted_words_match_brute_force(spark):
    model = T.ToxicityModel((("idiot", False), ("worthless", False), ("réeux", True), ("scum", False)), (2.0, 3.0, 1.5, 2.5), (-3.0, 1.2, 0.9, -0.4, 0.8, 0.7, 0.1, 1.1, 2.0, 0.5), frozenset({"idio"}), (0.5, 0.7, 0.1, 0.4))
    texts = ["you idiot", 'he said "idiot" today', "an idio and an idoit and wrthles you", "réeuxaux réeux scumm", "", "… «scum» idiot’s", "idiot " * 40, "plain words only", "xdiot, idiott; worthles — your worthless"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.with_toxicity(df, model).collect():
        assert abs(r.score - brute_score(model, texts[r.doc_id])) < 1e-9, texts[r.doc_id]


def test_op4(run, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    pieces = {}
    for r in run("op4_token_packing"):
        ids = np.frombuffer(r.ids, "<u2").tolist()
        for i, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault(i, {})[part] = ids[a:b]
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in pieces.items()} == {i: library.encode(t, add_bos=True, add_eos=True) for i, t in texts.items()}


def test_op5(run, texts):
    rows = run("op5_secret_scan")
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        t = texts[r.doc_id]
        found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[2] == k for f in found) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == joined


def test_op7(run):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    rows = [(int(i), np.array(v, np.float64)) for i, v in zip(e.vec_id, e.embedding) if v is not None and len(v) and np.isfinite(np.array(v, np.float64)).all() and np.any(v)]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in run("op7_permutation_index"):
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = total = 0
    for q in ids[ids % 100 == 0].tolist():
        gaps = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, gaps)).tolist() if ids[i] != q][:10]
        found = sorted(got[q])
        assert [rank for rank, *_ in found] == list(range(1, 11)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        assert all(abs(score - gaps[ids == i][0]) < 1e-12 for _, score, i in found)
        hits += len({i for *_, i in found} & set(ids[order].tolist()))
        total += 10
    assert set(got) == set(ids[ids % 100 == 0].tolist()) and hits / total >= 0.9


def test_op8(run, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    rows = run("op8_sentencepiece_codec")
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

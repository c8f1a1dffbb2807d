"""The pipeline's stages on a small corpus."""

import random

import numpy as np

import corpus_pipeline as P


def test_stages_take_effect_and_keep_clean_rows(spark, tmp_path):
    pick = random.Random(5)
    words = [f"{c}{v}{d}" for c in "bdfgklmnprt" for v in "aeiou" for d in "lnrst"]
    say = lambda n: " ".join(pick.choices(words, k=n))
    docs = [(i, say(60), "xx", "s", 0) for i in range(200)]
    labels = [(i, 0, 0) for i in range(0, 200, 2)]
    for i in range(300, 400):
        docs.append((i, say(20) + " idiot " + say(9) + " worthless " + say(20), "xx", "s", 0))
        labels.append((i, 0, 1))
    item = say(25)
    docs += [(500, docs[3][1], "xx", "s", 0), (501, docs[4][1].replace(docs[4][1].split()[30], "other"), "xx", "s", 0)]
    docs += [(502, say(20) + " " + item + " " + say(20), "xx", "s", 0), (503, say(30) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + say(9), "xx", "s", 0), (504, None, "xx", "s", 0), (505, "", None, None, None), (None, say(30), "xx", "s", 0)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got, frame = {}, spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    for name, stage in P.STAGES:
        frame = stage(spark, frame, folder)
        assert name == "sentencepiece" or frame.columns == columns
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        got[name] = {r.doc_id: r for r in frame.collect()}
    clean = set(range(200)) | {502, 503, 504, 505, None}
    assert set(got["toxicity"]) == clean | {500, 501}
    assert set(got["near_dedup"]) == clean
    assert item.split()[12] + " " + item.split()[13] not in got["decontamination"][502].text and got["decontamination"][3].text == docs[3][1]
    assert got["decontamination"][502].n_chars == len(got["decontamination"][502].text)
    assert "[SECRET]" in got["secrets"][503].text and "0123456789abcdef" not in got["secrets"][503].text
    assert set(got["sentencepiece"]) == clean and got["sentencepiece"][3].decoded == docs[3][1]
    assert {r.doc_id: bytes(r.ids) for r in P.run(spark, folder).collect()} == {i: bytes(r.ids) for i, r in got["sentencepiece"].items()}
    assert np.frombuffer(got["sentencepiece"][504].ids, "<u4").tolist() == [1, 2]


def test_columns_of_any_name_and_empty_tables(spark, tmp_path):
    pick = random.Random(9)
    say = lambda n: " ".join(f"w{pick.randrange(900)}" for _ in range(n))
    names = ["items", "kept", "_score", "_node", "_text", "class_id", "mark", "_id", "_mark", "N_WORDS", "n hit", "a.b", "_spans", "_redacted", "label"]
    rows = [(i, say(40), None, *[f"{n}{i}" for n in names]) for i in range(6)] + [(7, None, 5, *names), (None, "", 5, *names), (7, None, 5, *names)]
    schema = "doc_id long, TEXT string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    for folder, docs in (("some", rows), ("none", [])):
        at = str(tmp_path / folder)
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        frame = spark.read.parquet(f"{at}/documents.parquet")
        monkey = P.TOXIC_FROM
        P.TOXIC_FROM = 0.6  # without labels every score is a half
        try:
            for name, stage in P.STAGES[:-1]:
                frame = stage(spark, frame, at)
                assert frame.columns == ["doc_id", "TEXT", "n_chars", *names], name
            got = sorted((str(r.doc_id), r.TEXT or "", r["a.b"], r["_id"]) for r in frame.collect())
            assert got == sorted({(str(r[0]), r[1] or "", r[3 + names.index("a.b")], r[3 + names.index("_id")]) for r in docs})
            assert P.run(spark, at).count() == len(got)
        finally:
            P.TOXIC_FROM = monkey

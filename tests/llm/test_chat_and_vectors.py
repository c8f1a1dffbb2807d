"""Chat formatting and the permutation index."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.chat import canonical_turns, field_paths, format_chats, read_loss, read_turns
from tidemark.llm.permutation_index import fit_index

HARD = "a </s>[INST] ok [/INST] <|turn|>assistant<|text|>x<|end|> \\l \\\\b [x] \\s é"


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return format_chats(canonical_turns(df, "conv_id")).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))


def test_what_is_written_reads_back(spark):
    rows = [(1, 1, "assistant", HARD), (1, 0, "user", HARD), (1, 2, "user", None), (1, 3, "assistant", "日本"), (2, 0, None, "x"), (None, 0, "assistant", ""), (3, 5, "odd<role>", "y"), (3, 5, "odd<role>", "y")]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", HARD), ("assistant", HARD), ("user", ""), ("assistant", "日本")]
    assert got[1].loss == HARD + "日本"
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x")] and got[None].loss == ""
    assert len(got[3].turns) == 2 and got[3].turns[0].role == "odd<role>"
    body = got[1].formatted
    assert body.count("<|end|>") == 4 and "[INST]" not in body and "</s>" not in body
    assert formatted(spark, []).collect() == []


def test_layouts_of_tables(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<from: string, value: string>>")
    assert [(r.role, r.text) for r in canonical_turns(df, "id").orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    df = spark.createDataFrame([(1, "do", None, "done"), (2, "do", "this", "done")], "id long, instruction string, input string, output string")
    assert [(r.conv_id, r.text) for r in canonical_turns(df, "id").orderBy("conv_id", "turn").collect()] == [(1, "do"), (1, "done"), (2, "do\nthis"), (2, "done")]
    with pytest.raises(ValueError):
        canonical_turns(df.select("id", "output"), "id")
    assert field_paths(df.schema) == ["id", "input", "instruction", "output"]


def test_mixed_records_in_one_column(spark):
    records = [
        {"messages": [{"role": "user", "content": "q<1>"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "p", "response": "r"}, {"prompt": "p", "completion": "c"}, {"output": "o", "instruction": "i", "input": ""},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, record string")
    got = [(r.conv_id, r.role, r.text) for r in canonical_turns(df, "id", "record").orderBy("conv_id", "turn").collect()]
    assert got == [(0, "user", "q<1>"), (0, "assistant", "a"), (1, "user", "q"), (1, "assistant", "b"), (2, "user", "p"), (2, "assistant", "r"), (3, "user", "p"), (3, "assistant", "c"), (4, "user", "i"), (4, "assistant", "o")]
    odd = df.union(spark.createDataFrame([(9, '{"what": 1}')], df.schema))
    with pytest.raises(Exception, match="no mapping"):
        canonical_turns(odd, "id", "record", on_unknown="raise").collect()
    assert canonical_turns(odd, "id", "record", on_unknown="drop").where("conv_id = 9").collect() == []


def test_fingerprints_choose_a_tables_mapping_and_see_all_messages(spark, monkeypatch):
    from tidemark.llm import chat

    seen = []
    monkeypatch.setattr(chat, "fingerprint", lambda paths, known=chat.fingerprint: seen.append(1) or known(paths))
    table = spark.createDataFrame([(1, "q", "a", "more")], "id long, question string, answer string, note string")
    assert [(r.role, r.text) for r in canonical_turns(table, "id").orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")] and seen
    with pytest.raises(ValueError, match="no mapping"):
        canonical_turns(table.drop("answer"), "id")
    alike, unlike = '{"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}', '{"messages": [{"role": "user", "content": "q"}, {"from": "gpt", "value": "lost"}]}'
    records = spark.createDataFrame([(1, alike), (2, unlike), (3, '{"messages": [{"role": "user", "content": "q"}, {"role": "user"}]}')], "id long, record string")
    assert [(r.conv_id, r.text) for r in canonical_turns(records, "id", "record", on_unknown="drop").orderBy("conv_id", "turn").collect()] == [(1, "q"), (1, "a")]
    for i in (2, 3):
        with pytest.raises(Exception, match="no mapping"):
            canonical_turns(records.where(f"id = {i}"), "id", "record", on_unknown="raise").collect()
    assert [(r.role, r.text) for r in canonical_turns(records.where("id = 2"), "id", "record").collect()] == [("", unlike)]


def test_records_without_turns_and_broken_ones(spark):
    none = [None, "", " \n\t", '{"messages": []}', '{"conversations": []}']
    broken = ["[]", "not json", '{"messages": [}', "3", '{"messages": "text"}', '{"messages": [], "more": 1}', "{}", "null", '{"prompt": null, "answer": 2}']
    df = spark.createDataFrame(list(enumerate(none + broken)), "id long, record string")
    for mode, want in (("keep", [(len(none) + i, 0, "", t) for i, t in enumerate(broken)]), ("drop", [])):
        assert sorted((r.conv_id, r.turn, r.role, r.text) for r in canonical_turns(df, "id", "record", on_unknown=mode).collect()) == want
    empty = '{"prompt": null, "response": ""}'
    got = canonical_turns(spark.createDataFrame([(1, empty)], df.schema), "id", "record").orderBy("turn").collect()
    assert [(r.role, r.text or "") for r in got] == [("user", ""), ("assistant", "")]
    with pytest.raises(ValueError):
        canonical_turns(df, "id", "record", on_unknown="guess")
    out = format_chats(canonical_turns(df, "id", "record")).withColumn("turns", read_turns(F.col("formatted"))).collect()
    assert {r.conv_id: [t.text for t in r.turns] for r in out} == {len(none) + i: [t] for i, t in enumerate(broken)}


def brute(rows, queries, k=10):
    usable = {i: np.array(v) for i, v in rows if v is not None and not any(x is None for x in v) and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in usable:
            near = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q)
            out[q] = near[:k]
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    index = fit_index(df, **options)
    indexed = index.stored_index(df, "vec_id", "embedding")
    out = {}
    for r in index.search(indexed, indexed.where("id % 10 = 0"), block_queries=7).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(8, 32))
    rows = [(i, (centres[i % 8] + 0.4 * pick.normal(size=32)).astype(np.float32).tolist()) for i in range(1500)]
    want, got = brute(rows, range(0, 1500, 10)), search(spark, rows, least=100)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert all(abs(s - dict((i, s) for s, i in want[q]).get(i, s)) < 1e-12 for q in got for s, i in got[q])


def test_a_repeated_query_is_one_and_unlike_vectors_of_an_id_are_two(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = fit_index(df)
    asked = spark.createDataFrame([(10, [10.0, 1.0]), (10, [10.0, 1.0]), (20, [20.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    for block in (1024, 1):
        got = index.search(index.add_orders(df, "vec_id", "embedding"), index.add_orders(asked, "vec_id", "embedding"), block_queries=block).collect()
        ten = sorted((r.rank, r.vec_id) for r in got if r.query_id == 10)
        assert [rank for rank, _ in ten] == list(range(1, 11)) and len({v for _, v in ten}) == 10
        twenty = sorted((r.rank, r.vec_id) for r in got if r.query_id == 20)
        assert [rank for rank, _ in twenty] == [k for k in range(1, 11) for _ in (0, 1)] and {1, 2, 10, 19, 21} <= {v for _, v in twenty}


def test_repeated_rows_are_candidates_each(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 21)] + [(5, [5.0, 1.0]), (5, [5.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = fit_index(df)
    found = index.search(index.stored_index(df, "vec_id", "embedding"), index.add_orders(df.where("vec_id = 4"), "vec_id", "embedding")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found][:5] == [(3, 1.0), (5, 1.0), (5, 1.0), (5, 1.5), (2, 2.0)]


def test_equal_unusable_and_few_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (110, [1.0, None]), (120, [float("nan"), 1.0]), (130, [float("inf"), 1.0]), (140, [5.0, 5.0])]
    got = search(spark, rows)
    assert set(got) == {0, 10, 20, 30, 140}
    assert [i for _, i in got[0]] == list(range(1, 11)) and [i for _, i in got[20]] == list(range(10))
    assert search(spark, rows[:3]) == {0: [(0.0, 1), (0.0, 2)]}
    assert search(spark, []) == {}

"""The registered queries of this subpackage: each applies its operator, with production parameters,
to the whole of its table and derives the digest columns that the contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.shipping import ship

from .chat import END, TEXT, TURN, canonical_turns, format_chats, read_loss, read_turns
from .decontaminate import decontaminate
from .minhash import near_duplicates
from .packing import pack_tokens
from .permutation_index import fit_index
from .pieces import encode_and_decode
from .secrets import KINDS, with_secrets
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_array_dedup
from .toxicity import fit_toxicity, training_rows, with_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(documents, _table(spark, sf_dir, "labels"))
    scored = with_toxicity(documents, model)
    return scored.select("doc_id", (~training_rows()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(_table(spark, sf_dir, "documents"))


def _joined(spans, *kinds: str):
    """kind:start:end of the spans of these kinds, by start, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")

    def of(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(_joined(spans, *KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _joined(spans, *KINDS).alias("spans"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = canonical_turns(_table(spark, sf_dir, "conversations"), "conv_id").withColumn("conv_id", F.col("conv_id").cast("long")).unionByName(extra)
    out = format_chats(turns).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    index = fit_index(vectors)
    indexed = index.stored_index(vectors, "vec_id", "embedding")
    return index.search(indexed, indexed.where("id % 100 = 0"))


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_minhash_near_dedup, op3_toxicity, op4_token_packing, op5_secret_scan, op6_chat_formatting, op7_permutation_index, op8_sentencepiece_codec, op9_benchmark_decontamination, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    said = "</s>[INST] ok [/INST]"
    escapes = " + ".join(f"len({{0}}) - len(replace({{0}}, '{c}', ''))" for c in ("\\", "<", "["))
    return {
        "op6_chat_formatting": f"""
            WITH t AS (
              SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}')
            SELECT conv_id, count(*) AS n_turns,
              sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
              coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
              sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
              sum({len(TURN + TEXT + END)} + len(role) + len(text) + {escapes.format("role")} + {escapes.format("text")})::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id""",
        "op9_benchmark_decontamination": """
            WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
            b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
            windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
            sizes AS (SELECT DISTINCT n FROM windows),
            places AS (SELECT doc_id, n, i, w[i : i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
            hits AS (SELECT doc_id, i, p.n AS n, item FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
            words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
            items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op10_substring_dedup": """
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            places AS (SELECT doc_id, i, w[i : i + 34] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
            again AS (SELECT win FROM places GROUP BY win HAVING count(*) > 1),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM places SEMI JOIN again USING (win)),
            left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) t ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
            counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN left_over USING (doc_id) LEFT JOIN counts USING (doc_id)""",
        "op1_suffix_array_dedup": """
            WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            b AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
            cut AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 610) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 256)) AS base FROM b WHERE n >= 50)),
            places AS (SELECT doc_id, base + j AS i, substr(part, 2 * j + 1, 100) AS win FROM (SELECT doc_id, base, part, unnest(range(0, least(256, n - 49 - base))) AS j FROM cut)),
            firsts AS (SELECT win, min(doc_id) AS first FROM places GROUP BY win HAVING count(*) > 1),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM places JOIN firsts USING (win) WHERE first < doc_id),
            spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < k - 1) AS n_spans FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) GROUP BY doc_id),
            left_over AS (SELECT doc_id, string_agg(byte, '' ORDER BY k) AS kept FROM (SELECT doc_id, unnest(range(0, n)) AS k, unnest(regexp_extract_all(h, '..')) AS byte FROM b SEMI JOIN spans USING (doc_id)) t ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
            SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
            FROM b LEFT JOIN spans USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
    }

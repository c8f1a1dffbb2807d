"""From raw documents to token ids: toxicity, near-duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Rows without an id or a text go through every stage like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._scratch import scratch
from tidemark.llm.decontaminate import with_contamination
from tidemark.llm._text import free_names, place_of, quoted
from tidemark.llm.minhash import one_of_each
from tidemark.llm.pieces import encode_and_decode
from tidemark.llm.secrets import with_secrets
from tidemark.llm.toxicity import fit_toxicity, with_toxicity
from tidemark.shipping import ship

TOXIC_FROM = 0.3


def _retexted(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """docs with another text, and its length where there is a column for it."""
    out = {place_of(columns, "text"): text}
    lower = [c.lower() for c in columns]
    if "n_chars" in lower:
        at = lower.index("n_chars")
        out[at] = F.length(text).cast(docs.schema[columns[at]].dataType)
    return docs.select(*[out.get(i, F.col(quoted(c))).alias(c) for i, c in enumerate(columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score says toxic go."""
    ship(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = free_names(docs.columns, "_score")
    return with_toxicity(docs, model, score_col=score).where(F.col(score) < TOXIC_FROM).select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row with the smallest id stays; rows without an id sort last, by text."""
    ship(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    ship(spark)
    names = free_names(docs.columns, "n_words", "n_hit", "hit_spans", "items", "kept")
    out = with_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_text=True, unnamed=True, names=tuple(names))
    return _retexted(out, docs.columns, F.when(F.col(names[1]) > 0, F.col(names[4])).otherwise(F.col("text")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    ship(spark)
    spans, text = free_names(docs.columns, "_spans", "_redacted")
    return _retexted(with_secrets(docs, spans_col=spans, redacted_col=text), docs.columns, F.col(text))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from them."""
    ship(spark)
    return encode_and_decode(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("sentencepiece", sentencepiece)]

#: The fitted score, the signatures' classes and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch(docs)
    return docs

"""Training-data pipeline over ``documents``: language, near-duplicates, secrets, mixture, windows.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that is written and read
again before the next stage. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import circulant, language, mixing, packing, secret_scan
from cellwise.llm.common import remainder, stored, table
from cellwise.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a language that was learned; columns and texts stay as they are."""
    model = language.fit(docs, remainder(F.col("doc_id"), 3) != 1)
    rows = docs.select(F.struct("*").alias("doc"))
    found = language.identify(rows, model, "doc.text", fits="fits")
    return found.where((F.col("lang_pred") != language.UNKNOWN) & F.col("fits")).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return circulant.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew."""
    masked = docs.withColumn("text", secret_scan.redacted("text"))
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at target weights: a row per document and pass over its source, with the words taken."""
    return mixing.mixed_documents(docs, n_chars="n_chars")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training windows."""
    import public_tokenizers
    return packing.packed(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained classifiers, lexing and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the last result is returned as stored."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bottomk, circulant, classlm, language, lexical, mixing, packing, perspectives, quality, secret_scan,
               spherical, trie, url_model)
from .common import remainder, stored, table

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = stored(mixing.placed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=False))
    sources, pieces = mixing.mixed(place)
    return mixing.summary(place, sources, pieces).withColumnRenamed("id", "doc_id")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs))


@query("op4_url_model", url_model.oracle_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_model.judged(pages).select("page_id", "host", "path", "rule", "verdict")


@query("op5_circulant_minhash", circulant.oracle_sql(4, 80))
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = circulant.near_duplicates(table(spark, sf_dir, "documents"), width=4, similarity=80)
    null = lambda c: F.nullif(c, F.lit(circulant.NULL_ID))
    return found.select(null(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                        null(F.col("component_id")).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


@query("op6_perspectives", perspectives.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotated(table(spark, sf_dir, "conversations"))


@query("op7_bottom_k")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottomk.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own, changed, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select(
        F.nullif(F.col("id"), F.lit(bottomk.NULL_ID)).alias("doc_id"), "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        bottomk.as_text(own).alias("fingerprint"), bottomk.as_text(changed).alias("edited_fingerprint"),
        bottomk.resemblance(own, changed).alias("near_edited"), bottomk.resemblance(own, following).alias("near_next"))


@query("op8_spherical_caps", spherical.oracle_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spherical.linked_vectors(table(spark, sf_dir, "embeddings"))
    null = lambda c: F.nullif(F.col(c), F.lit(spherical.NULL_ID))
    return found.select(null("id").alias("vec_id"), "n_links", null("component_id").alias("component_id"),
                        (F.col("id") == F.col("component_id")).alias("kept"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = language.fit(docs, ~held_out)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_brown_classes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classlm.score(docs, remainder(F.col("doc_id"), 10) == 0).withColumnRenamed("id", "doc_id")


@query("op11_boosted_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = remainder(F.col("doc_id"), 5) != 0
    found = quality.classified(docs, table(spark, sf_dir, "labels"), training)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op12_prefix_trie", trie.oracle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_block_max", lexical.oracle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id")

"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, chat, html, jaccard, langid, mixing, negatives, repeats, runs, tokens, toxicity, vectors
from lexmill.session import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.with_fixture(table(spark, sf_dir, "conversations")))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("toxic_spans").alias("n_spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    return mixing.mix_sources(docs).select("doc_id", "source", words.alias("n_tokens"), "mix_epoch", "mix_block", "mix_weight")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = jaccard.join(table(spark, sf_dir, "documents"), n=3, percent=90, every_link=False)
    return classes.select("doc_id", "n_shingles", "component_id")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_vectors": op2_vectors,
    "op3_repeats": op3_repeats,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_bpe": op6_bpe,
    "op7_jaccard": op7_jaccard,
    "op8_tokens": op8_tokens,
    "op9_neighbours": op9_neighbours,
    "op10_html": op10_html,
    "op11_negatives": op11_negatives,
    "op12_runs": op12_runs,
    "op13_languages": op13_languages,
}

ORACLE = {
    "op1_chat": chat.SQL,
    "op2_vectors": vectors.NEAR_SQL,
    "op3_repeats": repeats.SQL,
    "op5_mixing": mixing.SQL,
    "op7_jaccard": jaccard.SQL,
    "op8_tokens": tokens.SQL,
    "op11_negatives": negatives.SQL,
}

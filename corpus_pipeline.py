"""A training corpus from ``documents``: five stages, each applied to all rows that the one before it kept.

Defined cases, for each stage: null texts count as empty and stay null; rows with a null id are judged like others, but
are no near copies; rows that repeat an id are judged one by one; columns whose names clash with those that an operator
makes come back unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm import bpe, jaccard, mixing, repeats, toxicity
from lexmill.llm.common import free_names
from lexmill.session import cut, drop, scratch, table


def _as_before(out: DataFrame, docs: DataFrame, moved: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return out.select(*(F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under a half."""
    own, moved = free_names(docs, toxicity.MADE)
    scored = toxicity.score_documents(own, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _as_before(scored.filter("toxicity < 0.5"), docs, moved)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies (5 words, 0.8).

    Rows are judged one by one: of rows that repeat an id, each whose text is no copy of another document's stays, and
    one of those with the same set of shingles. Rows without an id stay; rows without words go only where another of
    their id has none either.
    """
    with scratch(spark) as keep:
        classes, _ = jaccard.join(docs, n=5, percent=80, every_link=False)
        own = classes.filter("doc_id = component_id AND doc_id = coalesce(class_id, doc_id)")
        of_text = own.groupBy("doc_id", "class_id", "mark").agg(F.count("*").alias("rows"))
        kept = of_text.groupBy("doc_id", "class_id").agg(F.min(F.struct("mark", "rows")).alias("k"))
        kept = keep(cut(kept.select(F.col("doc_id").alias("_id"), F.col("k.mark").alias("_mark"), (F.col("k.rows") > 1).alias("_repeats"))))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.xxhash64("text").alias("_of")).join(kept, (F.col("row.doc_id") == F.col("_id")) & (F.col("_of") == F.col("_mark")))
    first = F.row_number().over(W.partitionBy("_id", "_mark").orderBy("row"))  # few: rows that repeat an id and a text
    again = rows.filter("_repeats").withColumn("_n", first).filter("_n = 1")
    return rows.filter("NOT _repeats").select("row.*").unionByName(again.select("row.*")).unionByName(docs.filter("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that an earlier one has; untouched texts stay as they are."""
    own, moved = free_names(docs, repeats.MADE)
    out = repeats.remove_repeats(own)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _as_before(out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")), docs, moved)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of scarce sources repeated as the target weights ask."""
    own, moved = free_names(docs, mixing.MADE)
    return _as_before(mixing.mix_sources(own), docs, moved)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row; a null text has no tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeated passages", cut_repeats), ("mixing", mix), ("encoding", encode)]

#: Toxicity, recompression and BPE can't be stated in SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written; what it and the stage before it wrote to get there is removed."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch(spark) as keep:
            docs = keep(cut(stage(spark, before, sf_dir)))
        if i:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

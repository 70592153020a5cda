"""Prompts from retrieved chunks, and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings of the prompt's parts, in their order.
QUESTION, TEXTS, RULE = "السؤال: ", "النصوص المرجعية:", "---"
SECTIONS = ("[المواد المطلوبة صراحة]", "[تعريفات]", "[المواد الأساسية]", "[المواد المُحال إليها]")
#: Our own instructions per mode.
SYSTEM = {
    "user": "Answer from the given texts only, name the article of every statement, quote articles that a named one refers to, and say so when the texts don't settle the question.",
    "lawyer": "Analyse the case from the given texts: relevant articles, how they apply, weak points on either side and a strategy; keep wording and interpretation apart and name what is missing.",
}
EXCERPT = 300


def section() -> Column:
    """Which part of the prompt a chunk goes to: definitions have one of their own unless they were asked for by number."""
    return (
        F.when(F.col("source") == "explicit", F.lit(0))
        .when(F.col("node_type") == "Definition", F.lit(1))
        .when(F.col("source") == "primary", F.lit(2))
        .when(F.col("source") == "cross_ref", F.lit(3))
    )


def prompts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """qid and prompt; a question's chunks are few, as they are capped. Empty parts are left out."""
    rows = found.withColumn("section", section()).filter("section IS NOT NULL")
    parts = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("section", "rank", "text"))).alias("parts"))

    def one(i: int, heading: str) -> Column:
        own = F.filter("parts", lambda p: p["section"] == i)
        return F.when(F.size(own) > 0, F.concat(F.array(F.lit(f"\n{heading}")), F.flatten(F.transform(own, lambda p: F.array(p["text"], F.lit(RULE)))))).otherwise(F.array().cast("array<string>"))

    head = F.array(F.concat(F.lit(QUESTION), F.col("question")), F.lit(""), F.lit(TEXTS))
    joined = questions.select("qid", "question").join(parts, "qid", "left").withColumn("parts", F.coalesce("parts", F.expr("CAST(array() AS array<struct<section:int,rank:int,text:string>>)")))
    return joined.select("qid", F.array_join(F.concat(head, *(one(i, h) for i, h in enumerate(SECTIONS))), "\n").alias("prompt"))


def system_prompt(mode: Column) -> Column:
    return F.when(mode == "lawyer", F.lit(SYSTEM["lawyer"])).otherwise(F.lit(SYSTEM["user"]))


def source_struct() -> Column:
    """A source as it is returned: excerpt of 300 characters, score to three places."""
    return F.struct("node_id", "node_type", F.col("article_number").alias("article"), "breadcrumb", F.substring("text", 1, EXCERPT).alias("excerpt"), "text", F.bround("score", 3).alias("score"), "source")


def sources(found: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", source_struct().alias("s"))))
    return found.groupBy("qid").agg(F.transform(listed, lambda x: x["s"]).alias("sources"))


def source_line() -> Column:
    """A source as a line of text."""
    return F.format_string("[%-9s] score=%.3f  %s  (%s)", "source", "score", "node_id", F.substring("breadcrumb", 1, 80))

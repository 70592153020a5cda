"""What a front end shows, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Marks of error classes in lower case.
ERRORS = {"paused": ("instance is paused", "databasepaused"), "missing_model": ("deploymentnotfound", "resource not found"), "authentication": ("authentication", "401")}


def total_latency(elapsed: Column) -> Column:
    return F.aggregate(F.map_values(elapsed), F.lit(0).cast("long"), lambda a, x: a + x)


def score_label(source: Column, score: Column) -> Column:
    return F.when(source == "explicit", F.lit("direct")).when(score > 0, F.format_string("similarity %.3f", score)).otherwise(F.lit("expansion"))


def suggestions(question: Column, by_keyword: dict[str, list[str]], default: list[str]) -> Column:
    """The list of the first keyword, in the order given, that a question contains."""
    listed = lambda xs: F.array(*map(F.lit, xs))
    return reduce(lambda rest, kv: F.when(F.contains(question, F.lit(kv[0])), listed(kv[1])).otherwise(rest), reversed(by_keyword.items()), listed(default))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    rule = lambda marks: reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in marks])
    return reduce(lambda rest, kv: F.when(rule(kv[1]), F.lit(kv[0])).otherwise(rest), reversed(ERRORS.items()), F.lit("backend"))


def star(found: DataFrame) -> dict[str, DataFrame]:
    """nodes and edges around each question: one node per article, coloured by the source it came from first."""
    first = found.filter("article_number IS NOT NULL").withColumn("_n", F.row_number().over(W.partitionBy("qid", "article_number").orderBy("rank"))).filter("_n = 1")
    articles = first.select("qid", F.concat(F.lit("article_"), F.col("article_number").cast("string")).alias("id"), F.col("source").alias("kind"))
    hubs = found.select("qid").distinct().select("qid", F.lit("question").alias("id"), F.lit("question").alias("kind"))
    return {"nodes": hubs.union(articles), "edges": articles.select("qid", F.lit("question").alias("src"), F.col("id").alias("dst"))}


def refs_banner(refs: Column) -> Column:
    return F.array_join(F.transform(refs, lambda n: n.cast("string")), "، ")


def answer_words(answer: Column) -> Column:
    return F.filter(F.split(answer, "(?U)\\s+"), lambda w: w != "")

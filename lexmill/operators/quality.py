"""Checks of a built corpus, each one row: check, ok, n (violations or the measured number)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.session import cut


STRETCH = 1 << 16


def gaps(numbers: DataFrame, column: str) -> DataFrame:
    """Numbers from 1 to the greatest that are missing."""
    have = numbers.select(F.col(column).cast("long").alias("number")).filter("number IS NOT NULL").distinct()
    top = have.agg(F.max("number").alias("top")).filter("top >= 1")
    blocks = top.select("top", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / STRETCH))).alias("block")).repartition("block")
    within = F.sequence(F.greatest(F.col("block") * STRETCH, F.lit(1)), F.least((F.col("block") + 1) * STRETCH - 1, F.col("top")))
    want = blocks.select(F.explode(within).alias("number"))
    return want.join(have, "number", "left_anti")


def dangling(refs: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """Rows whose reference has no target."""
    return refs.join(targets.select(column).distinct(), column, "left_anti")


def page_violations(articles: DataFrame, bucket: int = 10_000) -> DataFrame:
    """Articles whose first page lies over one page before the last page of the last article before that has pages, by number.

    Buckets of numbers are ordered apart; what the last bucket before leaves stands for all before it, so no task holds
    a whole law. Articles without a number come first; null laws are one law.
    """
    last = F.when(F.size("source_pages") > 0, F.array_max("source_pages"))
    rows = articles.withColumn("_last", last).withColumn("_at", F.coalesce(F.floor(F.col("article_number") / bucket), F.lit(-(1 << 40))))
    order = F.struct(F.coalesce("article_number", F.lit(-(1 << 31))).alias("n"), "chunk_order")
    ends = rows.groupBy("law_id", "_at").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), order)).alias("_end"))
    before = F.last("_end", True).over(W.partitionBy("law_id").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(F.col("law_id").alias("_law"), F.col("_at").alias("_of"), before.alias("_before"))
    met = rows.join(ends, rows["law_id"].eqNullSafe(ends["_law"]) & (rows["_at"] == ends["_of"]))
    own = F.last("_last", True).over(W.partitionBy("law_id", "_at").orderBy("article_number", "chunk_order").rowsBetween(W.unboundedPreceding, -1))
    met = met.withColumn("before", F.coalesce(own, "_before", F.lit(0)))
    return met.filter((F.size("source_pages") > 0) & (F.get("source_pages", F.lit(0)) < F.col("before") - 1)).drop("_last", "_at", "_law", "_of", "_before")


def at_index(values: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """n, p50 (interpolated, cut), and the values at index int(n * share) of the sorted list, from 0; max.

    Equal values are counted first, then ordered by ranges; a range's place follows from the sums of those before it, so
    no task sorts all values.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c")).filter("v IS NOT NULL")
    ranged = cut(counts.repartitionByRange("v")).withColumn("_p", F.spark_partition_id())
    sums = ranged.groupBy("_p").agg(F.sum("c").alias("own"))  # one row a range
    sums = sums.select("_p", (F.sum("own").over(W.orderBy("_p")) - F.col("own")).alias("_before"), F.sum("own").over(W.partitionBy()).alias("n"))
    run = ranged.join(sums, "_p").withColumn("upto", F.sum("c").over(W.partitionBy("_p").orderBy("v")) + F.col("_before"))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(s)), F.col("v"))).alias(f"p{round(s * 100)}") for s in shares]
    low, high = F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), F.col("v"))), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("v")))
    return run.agg(F.max("n").alias("n"), ((low + high) / 2).cast("int").alias("p50"), *picks, F.max("v").alias("max"))


def _row(name: str, df: DataFrame, ok: Column, n: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), ok.alias("ok"), n.cast("long").alias("n"))


def _none(name: str, df: DataFrame) -> DataFrame:
    return _row(name, df.agg(F.count("*").alias("n")), F.col("n") == 0, F.col("n"))


def validate(chunks: DataFrame, glossary: DataFrame, *, articles: int = 298, definitions: int = 30, median: tuple[int, int] = (100, 800), p99: int = 3500) -> DataFrame:
    """All checks as one table."""
    whole = chunks.filter("node_type = 'Article'")
    counted = chunks.agg(F.count_if(F.col("node_type") == "Definition").alias("d"), F.count_if((F.col("node_type") == "Article") & (F.col("article_number") == 1)).alias("a"))
    missing = gaps(whole, "article_number").select("number").union(whole.groupBy("article_number").count().filter("count > 1").select("article_number"))
    refs = chunks.select(F.explode("cross_refs").alias("article_number"))
    spread = at_index(chunks.filter("node_type IN ('Article', 'ArticleSegment')"), "token_count_est", (0.9, 0.99))
    rows = [
        _none("article gaps", missing),
        _row("article count", whole.agg(F.count_distinct("article_number").alias("n")), F.col("n") == articles, F.col("n")),
        _row("definitions count", counted, (F.col("d") >= definitions) & (F.col("a") == 1), F.col("d")),
        _none("page monotonicity", page_violations(whole)),
        _row("token distribution", spread, (F.col("p50") > median[0]) & (F.col("p50") < median[1]) & (F.col("p99") < p99), F.col("p50")),
        _none("dangling references", dangling(refs, whole, "article_number")),
        _none("glossary consistency", dangling(glossary, chunks.filter("node_type = 'Definition'"), "node_id")),
    ]
    return reduce(DataFrame.unionByName, rows)


def verdict(checks: DataFrame) -> tuple[list[str], int]:
    """A line for each check, in order of their names, and the exit status: 0 if all passed, else 1. For the few rows of ``validate``."""
    rows = sorted(checks.select("check", "ok", "n").collect())
    return [f"{'PASS' if r['ok'] else 'FAIL'} {r['check']} ({r['n']})" for r in rows], int(not all(r["ok"] for r in rows))


def counters(pages: DataFrame, articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: pages, chars, articles, chunks, definitions, with_refs, with_terms."""
    a = pages.agg(F.count("*").alias("pages"), F.sum(F.length("cleaned_text")).alias("chars"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if("is_definition").alias("definitions"), F.count_if(F.size("cross_refs") > 0).alias("with_refs"), F.count_if(F.size("defined_terms_used") > 0).alias("with_terms"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(a).join(one(articles.agg(F.count("*").alias("articles"))), "_k").join(one(c), "_k").drop("_k")

"""Routing of questions and retrieval: named articles, nearest vectors, one hop along edges, first of each node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.config import DEFAULT_MODE, PROFILES, RouteConfig
from lexmill.functions import text as T
from lexmill.operators import vector
from lexmill.session import spread

# How questions name articles, and suggestions by keyword are in presentation.
NUMBER = "[\\d٠-٩۰-۹]+"
NAMED = f"(?U)(?<![اوفبلكم])(?:ال|لل|بال)?(?:مادة|مادتين|مادتي|مادتى)\\s*\\(?\\s*({NUMBER})\\s*\\)?(?:\\s*و\\s*\\(?\\s*({NUMBER})\\s*\\)?)?"
LISTED = f"(?U)(?<![اوفبلكم])(?:ال|لل|بال)?مواد\\s+({NUMBER}(?:\\s*(?:و|إلى|الى|،|,|-)\\s*{NUMBER})+)"
SPAN = f"(?U)({NUMBER})\\s*(?:إلى|الى|-)\\s*({NUMBER})"
#: Either form in one pass, the word of a list, a range in it, and what a match holds besides digits and white space.
ANY = T.spelled(f"(?:{NAMED.removeprefix('(?U)')}|{LISTED.removeprefix('(?U)')})")
LIST_WORD, ANY_SPAN = "مواد", T.spelled(SPAN)
OTHERS = "البلمةدتينىو()إ،,-"
SOURCES = ("explicit", "primary", "definition", "cross_ref")
COLUMNS = ["qid", "node_id", "node_type", "article_number", "breadcrumb", "text", "score", "source", "pos"]


def route(question: Column, config: RouteConfig = RouteConfig()) -> Column:
    """Sorted article numbers that a question names. In a list the first range, if it is valid and short enough,
    stands for the whole list; else every number counts."""
    valid = lambda n: n.between(1, config.total_articles)

    def numbers(match: Column) -> Column:
        return F.transform(T.runs_of_digits(match, OTHERS), lambda t: T.western_digits(t).try_cast("int"))

    def with_span(match: Column) -> Column:
        ends = F.filter(F.when(F.contains(match, F.lit(LIST_WORD)), numbers(F.regexp_extract(match, ANY_SPAN, 0))), lambda n: n.isNotNull())
        return F.struct(match.alias("m"), F.get(ends, F.lit(0)).alias("a"), F.get(ends, F.lit(1)).alias("b"))

    def named(x: Column) -> Column:
        good = F.coalesce(valid(x["a"]) & valid(x["b"]) & (F.abs(x["b"] - x["a"]) <= config.max_span), F.lit(False))
        return F.when(good, F.sequence(F.least(x["a"], x["b"]), F.greatest(x["a"], x["b"]))).otherwise(numbers(x["m"]))

    # a match is looked at once: its first range first, then its numbers
    matches = F.transform(F.regexp_extract_all(question, F.lit(ANY), F.lit(0)), with_span)
    return F.sort_array(F.array_distinct(F.filter(F.flatten(F.transform(matches, named)), valid)))


def resolved(questions: DataFrame) -> DataFrame:
    """``questions(qid, question, mode, primary_k)`` with the profile of their mode; an unknown mode is the default."""
    mode = F.when(F.col("mode").isin(*PROFILES), F.col("mode")).otherwise(F.lit(DEFAULT_MODE))
    pick = lambda field: reduce(lambda rest, m: F.when(F.col("mode") == m[0], F.lit(getattr(m[1], field))).otherwise(rest), PROFILES.items(), F.lit(None).cast("int"))
    out = questions.withColumn("mode", mode).withColumn("primary_k", F.coalesce("primary_k", pick("primary_k")))
    return out.withColumns({f: pick(f) for f in ("definitions_per_article", "crossrefs_per_article", "max_context_chunks", "max_tokens")})


def node_view(graph: dict[str, DataFrame]) -> DataFrame:
    """All text nodes in one shape: node_id, node_type, article_number (null for definitions), text, embedding."""
    number = {"Article": "number", "ArticleSegment": "parent_article"}
    parts = []
    for kind in ("Article", "ArticleSegment", "Definition"):
        body = F.col("definition_text") if kind == "Definition" else F.col("text")
        n = F.col(number[kind]) if kind in number else F.lit(None).cast("int")
        parts.append(graph[kind].select("node_id", F.lit(kind).alias("node_type"), F.when(n != 0, n).alias("article_number"), F.coalesce(body, F.lit("")).alias("text"), "embedding"))
    return reduce(DataFrame.union, parts)


def as_retrieved(df: DataFrame, score: Column, source: str, pos: Column) -> DataFrame:
    return df.select("qid", "node_id", "node_type", "article_number", T.breadcrumb_of(F.col("text")).alias("breadcrumb"), "text", score.cast("double").alias("score"), F.lit(source).alias("source"), pos.cast("int").alias("pos"))


def explicit(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Articles whose numbers a question names, by number, with score 1. ``questions(qid, refs)``."""
    wanted = questions.select("qid", F.explode("refs").alias("article_number"))
    found = wanted.join(nodes.filter("node_type = 'Article'"), "article_number")
    return as_retrieved(found, F.lit(1.0), "explicit", F.row_number().over(W.partitionBy("qid").orderBy("article_number", "node_id")))


def primary(questions: DataFrame, nodes: DataFrame, config: RouteConfig = RouteConfig()) -> DataFrame:
    """Nearest nodes per index, merged. ``questions(qid, primary_k, embedding)``."""
    best = vector.topk_merged(questions, nodes.withColumnRenamed("node_type", "label"), F.col("primary_k"), config.index_labels)
    return as_retrieved(best.select("qid", "node_id", "score", "rank").join(nodes, "node_id"), F.col("score"), "primary", F.col("rank"))


def seeds(found: DataFrame) -> DataFrame:
    """Articles, not segments or definitions, from which to expand."""
    return found.filter("node_type = 'Article'").select("qid", "node_id").distinct()


def hop(seeds: DataFrame, edges: DataFrame, per_seed: Column | int, row_cap: int | None = 100, parts: int | None = None) -> DataFrame:
    """qid, target and pos: targets one edge away, at most ``per_seed`` of each seed among a question's first
    ``row_cap`` rows, each once. The order, which decides what the limits keep, is by seed and target.

    ``parts`` is the number of partitions, where it has to grow with the tables (``parts_for``)."""
    seeds = spread(seeds, parts, "node_id")
    # only edges from seeds are made distinct
    asked = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("target")).join(seeds.select("node_id").distinct(), "node_id", "left_semi").distinct()
    if parts and row_cap is not None:  # dealt anew by question, rows past the cap would move; no seed has more than the cap
        asked = asked.withColumn("_n", F.row_number().over(W.partitionBy("node_id").orderBy("target"))).filter(F.col("_n") <= row_cap).drop("_n")
    met = spread(seeds.join(asked, "node_id"), parts, "qid")
    if row_cap is not None:
        met = met.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy("node_id", "target"))).filter(F.col("_n") <= row_cap)
    met = met.withColumn("_k", F.row_number().over(W.partitionBy("qid", "node_id").orderBy("target"))).filter(F.col("_k") <= per_seed)
    first = met.groupBy("qid", "target").agg(F.min("node_id").alias("at"))
    return first.select("qid", "target", F.row_number().over(W.partitionBy("qid").orderBy("at", "target")).alias("pos"))


def expand(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, kind: str, per_seed: Column, source: str, row_cap: int | None = 100, parts: int | None = None) -> DataFrame:
    reached = hop(seeds, edges.filter(F.col("type") == kind), per_seed, row_cap, parts).withColumnRenamed("target", "node_id")
    return as_retrieved(reached.join(nodes, "node_id"), F.lit(0.0), source, F.col("pos"))


def dedupe_and_cap(found: DataFrame, cap: Column | int) -> DataFrame:
    """First of each node by source, then place; then the first ``cap`` of each question, at least one.

    Rows of equal source and place go by score, greatest first, then by their other columns (nulls first), so the rows
    that stay don't depend on how the input is partitioned. Null ids count as one node; an unknown source comes first.
    """
    priority = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    rest = [c for c in ("node_type", "article_number", "breadcrumb", "text", "source") if c in found.columns]
    order = [priority, "pos", *([F.desc("score")] if "score" in found.columns else []), *rest]
    first = found.withColumn("_n", F.row_number().over(W.partitionBy("qid", "node_id").orderBy(*order))).filter("_n = 1").drop("_n")
    placed = first.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(priority, "pos", "node_id")))
    return placed.filter(F.col("rank") <= F.greatest(F.lit(cap) if isinstance(cap, int) else cap, F.lit(1)))

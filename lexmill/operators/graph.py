"""Vertex and edge tables of a corpus, with set semantics: upserts by key, edges once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.config import CorpusConfig

KEYS = {"book": ["law_id", "number"], "part": ["law_id", "book_number", "number"], "chapter": ["law_id", "book_number", "part_number", "number"]}
TEXT = ["law_id", "text", "text_normalized", "char_count", "token_count_est", "source_pages", "embedding"]


def pick(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the first in ``order``. Keys with many rows are reduced before they meet."""
    rest = F.struct(*(c for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.min_by(rest, order).alias("_r")).select(*keys, "_r.*")


def upserted(df: DataFrame, key: str = "node_id", order: str = "chunk_order") -> DataFrame:
    """Last write wins: by ``order``, then by document, then by the other columns that order."""
    rest = F.struct(*(c for c in df.columns if c != key))
    by = [order, *(c for c in ("doc_id", "char_count", "text") if c in df.columns and c != order)]
    return df.groupBy(key).agg(F.max_by(rest, F.struct(*by)).alias("_r")).select(key, "_r.*")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that break a uniqueness constraint, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def hierarchy_nodes(chunks: DataFrame, level: str) -> DataFrame:
    """Distinct books, parts or chapters; the first title counts; rows with a null key part give no node."""
    above = [f"{x}_number" for x in ("book", "part", "chapter")[: len(KEYS[level]) - 2]]
    rows = chunks.select("law_id", *above, F.col(f"{level}_number").alias("number"), F.col(f"{level}_title").alias("title"), "chunk_order")
    return pick(rows.dropna(subset=["law_id", *above, "number"]), ["law_id", *above, "number"], F.col("chunk_order")).drop("chunk_order")


def _embedded(chunks: DataFrame) -> DataFrame:
    return chunks if "embedding" in chunks.columns else chunks.withColumn("embedding", F.lit(None).cast("array<float>"))


def text_nodes(chunks: DataFrame, node_type: str) -> DataFrame:
    """Article, ArticleSegment or Definition nodes; definitions have a term and definition_text but no number."""
    rows = _embedded(chunks).filter(F.col("node_type") == node_type)
    own = {
        "Article": [F.col("article_number").alias("number")],
        "ArticleSegment": [F.col("article_number").alias("parent_article"), "segment_index", "segment_total"],
        "Definition": [F.col("defined_term").alias("term"), "term_variants"],
    }[node_type]
    out = upserted(rows.select("node_id", "chunk_order", *own, *TEXT)).drop("chunk_order")
    return out.withColumnRenamed("text", "definition_text") if node_type == "Definition" else out


def edges(df: DataFrame, src: Column, dst: Column, kind: str, idx: Column | None = None, total: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("int")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (none if idx is None else idx).alias("idx"), (none if total is None else total).alias("total")).distinct()


def level_id(kind: str, *parts: str) -> Column:
    """An identifier for a book, part or chapter from its key; null if a part of the key is."""
    return F.concat(F.lit(f"{kind}:"), *(x for p in parts for x in (F.col(p).cast("string"), F.lit("/"))))


def hierarchy_edges(chunks: DataFrame) -> DataFrame:
    """HAS_BOOK, HAS_PART, HAS_CHAPTER and HAS_ARTICLE; an article hangs on its chapter, else its part, else nothing."""
    book, part, chapter = level_id("book", "law_id", "book_number"), level_id("part", "law_id", "book_number", "part_number"), level_id("chapter", "law_id", "book_number", "part_number", "chapter_number")
    articles = chunks.filter("node_type = 'Article'")
    above = F.when(F.col("chapter_number").isNotNull(), chapter).otherwise(part)
    found = [
        edges(chunks, F.col("law_id"), book, "HAS_BOOK"),
        edges(chunks, book, part, "HAS_PART"),
        edges(chunks, part, chapter, "HAS_CHAPTER"),
        edges(articles, above, F.col("node_id"), "HAS_ARTICLE"),
    ]
    return reduce(DataFrame.union, found).filter("src IS NOT NULL AND dst IS NOT NULL")


def next_edges(articles: DataFrame, bucket: int = 10_000) -> DataFrame:
    """NEXT between articles that follow each other by number in a law.

    Buckets of numbers are ordered apart; the last article of one goes on to the first of the next that has any, so
    no task holds a whole law.
    """
    rows = articles.filter("node_type = 'Article'").select("law_id", "node_id", "article_number", "chunk_order", F.floor(F.col("article_number") / bucket).alias("_b"))
    order = F.struct("article_number", "chunk_order")
    heads = rows.groupBy("law_id", "_b").agg(F.min_by("node_id", order).alias("head"))
    heads = heads.select("law_id", "_b", F.lead("head").over(W.partitionBy("law_id").orderBy("_b")).alias("head"))
    after = F.lead("node_id").over(W.partitionBy("law_id", "_b").orderBy("article_number", "chunk_order"))
    found = rows.withColumn("after", after).join(heads, ["law_id", "_b"], "left")
    found = found.withColumn("after", F.coalesce("after", "head"))
    return edges(found.filter("after IS NOT NULL"), F.col("node_id"), F.col("after"), "NEXT")


def segment_edges(chunks: DataFrame) -> DataFrame:
    """HAS_SEGMENT with index and total, where the parent article exists."""
    parents = chunks.filter("node_type = 'Article'").select(F.col("node_id").alias("parent")).distinct()
    found = chunks.filter("node_type = 'ArticleSegment'").withColumn("parent", F.regexp_replace("node_id", "-seg\\d+$", "")).join(parents, "parent")
    return edges(found, F.col("parent"), F.col("node_id"), "HAS_SEGMENT", F.col("segment_index"), F.col("segment_total"))


def reference_edges(chunks: DataFrame) -> DataFrame:
    """REFERENCES to articles of the same law; references to itself or to no article vanish."""
    return resolved_references(references(chunks), chunks)


def references(chunks: DataFrame) -> DataFrame:
    """law_id, node_id and ref of each reference of a chunk, but to its own article."""
    return chunks.select("law_id", "node_id", "article_number", F.explode("cross_refs").alias("ref")).filter("NOT (ref <=> article_number)")


def resolved_references(found: DataFrame, chunks: DataFrame) -> DataFrame:
    articles = chunks.filter("node_type = 'Article'").select("law_id", F.col("article_number").alias("ref"), F.col("node_id").alias("target")).distinct()
    return edges(found.join(articles, ["law_id", "ref"]), F.col("node_id"), F.col("target"), "REFERENCES")


def external_edges(chunks: DataFrame) -> DataFrame:
    return edges(chunks.select("node_id", F.explode("external_refs").alias("law")), F.col("node_id"), F.col("law"), "EXTERNAL_REF")


def term_edges(chunks: DataFrame) -> DataFrame:
    """USES_TERM from all but definitions to each definition of a term."""
    return resolved_terms(uses(chunks), chunks)


def uses(chunks: DataFrame) -> DataFrame:
    """law_id, node_id and term of each use of a defined term."""
    return chunks.filter("node_type <> 'Definition'").select("law_id", "node_id", F.explode("defined_terms_used").alias("term"))


def resolved_terms(found: DataFrame, chunks: DataFrame) -> DataFrame:
    terms = chunks.filter("node_type = 'Definition'").select("law_id", F.col("defined_term").alias("term"), F.col("node_id").alias("target")).distinct()
    return edges(found.join(terms, ["law_id", "term"]), F.col("node_id"), F.col("target"), "USES_TERM")


def laws(chunks: DataFrame, config: CorpusConfig) -> DataFrame:
    told = {"title": config.law_title, "issued_date": config.issued_date, "gazette_issue": config.gazette_issue}
    return chunks.select("law_id").distinct().select(F.col("law_id").alias("id"), *(F.lit(v).alias(k) for k, v in told.items()))


def build_graph(chunks: DataFrame, config: CorpusConfig) -> dict[str, DataFrame]:
    """All vertex tables by label, and ``edges``."""
    law = laws(chunks, config)
    levels = {level.capitalize(): hierarchy_nodes(chunks, level) for level in KEYS}
    texts = {kind: text_nodes(chunks, kind) for kind in ("Article", "ArticleSegment", "Definition")}
    other = chunks.select(F.explode("external_refs").alias("description")).distinct()
    every = [f(chunks) for f in (hierarchy_edges, next_edges, segment_edges, reference_edges, external_edges, term_edges)]
    return {"Law": law, **levels, **texts, "ExternalLaw": other, "edges": reduce(DataFrame.union, every)}

"""References to articles and other laws, and uses of defined terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

# Forms of references in running text.
NOT_INSIDE = "(?<![اوفبلكم])"
ONE = f"(?U){NOT_INSIDE}(?:ال|لل|بال)?(?:مادة|مادتين|مادتى|مادتي)[يى]?\\s*[)(]?\\s*([\\d٠-٩۰-۹]{{1,4}})\\s*[)(]?"
SEVERAL = f"(?U){NOT_INSIDE}(?:ال|لل|بال)?مواد[يى]?\\s*[)(]\\s*([\\d٠-٩۰-۹\\s،,]+?)\\s*[)(]\\s*(?:من|،)?"
OTHER_LAW = "(?U)قانون[^،,.\\n]{1,80}رقم\\s*([\\d٠-٩۰-۹]+)\\s*لسنة\\s*([\\d٠-٩۰-۹]{4})"


#: Either form in one pass, tried only at letters that begin one.
ANY = T.spelled(f"(?=[المب]){NOT_INSIDE}(?:{ONE.removeprefix('(?U)' + NOT_INSIDE)}|{SEVERAL.removeprefix('(?U)' + NOT_INSIDE)})")
LAW = T.spelled(OTHER_LAW)


def cross_refs(text: Column, max_article: Column, own: Column | None = None) -> Column:
    """Sorted article numbers that a text refers to, up to max_article, without its own."""
    matches = F.regexp_extract_all(T.strip_diacritics(text), F.lit(ANY), F.lit(0))
    # all matches are read as one string, which is named by a list of its own so that it is made once
    numbers = F.flatten(F.transform(F.array(F.array_join(matches, " ")), T.digits_ints))
    good = (lambda n: n.between(1, max_article) & ~n.eqNullSafe(own)) if own is not None else (lambda n: n.between(1, max_article))
    return F.sort_array(F.array_distinct(F.filter(numbers, good)))


def external_refs(text: Column) -> Column:
    """Other laws in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LAW), F.lit(0)), T.squeeze))


def terms_used(texts: DataFrame, terms: DataFrame, key: str = "node_id") -> DataFrame:
    """``key`` and sorted terms of ``terms(term, variants)`` that a text uses: a variant is among its tokens, or its
    stem among their stems. A variant of several words is never one token, so such terms are not found."""
    law = [c for c in ("law_id",) if c in texts.columns and c in terms.columns]
    tokens = texts.select(key, *law, F.explode(T.arabic_tokens(F.col("text"))).alias("token"))
    variants = terms.select(*law, "term", F.explode("variants").alias("variant"))
    plain = tokens.select(key, *law, F.col("token").alias("form"), F.lit(0).alias("stem")).union(tokens.select(key, *law, T.stem(F.col("token")), F.lit(1))).distinct()
    wanted = variants.select(*law, "term", F.col("variant").alias("form"), F.lit(0).alias("stem")).union(variants.select(*law, "term", T.stem(F.col("variant")), F.lit(1))).distinct()
    return plain.join(wanted, [*law, "form", "stem"]).groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("defined_terms_used"))


def max_article(articles: DataFrame) -> DataFrame:
    """One row: the greatest article number, 0 if there is none."""
    return articles.agg(F.coalesce(F.max("article_number"), F.lit(0)).alias("max_article"))


def annotate(chunks: DataFrame, glossary: DataFrame) -> DataFrame:
    """``chunks`` with cross_refs, external_refs and defined_terms_used; definitions get no terms.

    Each law has its own articles and terms; a glossary without law_id holds for all.
    """
    greatest = chunks.filter("node_type = 'Article'").groupBy("law_id").agg(F.max("article_number").alias("_top"))
    chunks = chunks.join(greatest, "law_id", "left")
    terms = glossary.select(*(c for c in glossary.columns if c == "law_id"), "term", T.term_variants(F.col("term"), (T.TATWEEL_PREFIX,)).alias("variants"))
    used = terms_used(chunks.filter("node_type <> 'Definition'").select("chunk_order", "doc_id", "law_id", "text").withColumn("_k", F.struct("doc_id", "chunk_order")), terms, "_k")
    used = used.select("_k.doc_id", "_k.chunk_order", "defined_terms_used")
    out = chunks.withColumn("cross_refs", cross_refs(F.col("text"), F.coalesce("_top", F.lit(0)), F.col("article_number"))).withColumn("external_refs", external_refs(F.col("text"))).drop("_top")
    return out.join(used, ["doc_id", "chunk_order"], "left").withColumn("defined_terms_used", F.coalesce("defined_terms_used", F.array().cast("array<string>")))

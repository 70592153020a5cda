"""Matches with offsets, page offsets and the overlap join between spans and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MARK = "\u0001"
STRETCH, PAGES = 1 << 12, 1 << 12


def scan(docs: DataFrame, pattern: str, text: str = "text", look: int = 30) -> DataFrame:
    """One row per match of ``pattern`` in each document, in place of its text.

    Columns: pos (from 1), start (offset of the match), segment (text from the match to the next), ahead (the first
    ``look`` characters after the segment). The text is split, not joined back, so each part of it moves once.
    Offsets run along each text: by doc_id and, where a document comes in several, char_start. U+0001, which no text
    needs, marks the cuts; it is deleted first and counts in no offset.
    """
    marked = F.regexp_replace(F.translate(F.col(text), MARK, ""), pattern, MARK + "$0")
    parts = F.split(marked, MARK)
    cut = F.transform(parts, lambda s, i: F.struct(s.alias("segment"), F.substring(F.coalesce(F.get(F.col("_parts"), i + 1), F.lit("")), 1, look).alias("ahead")))
    keys = [c for c in docs.columns if c != text]
    rows = docs.withColumn("_parts", parts).select(*keys, F.posexplode(cut).alias("pos", "_s"))
    one = [c for c in ("doc_id", "char_start") if c in keys]
    run = F.sum(F.length("segment")).over(W.partitionBy(*one).orderBy("pos")) - F.length("segment")
    return rows.select(*keys, "pos", "_s.segment", "_s.ahead").withColumn("start", run.cast("int")).filter("pos > 0")


def matched(pattern: str, group: int = 0) -> Column:
    """The match at the start of a segment; ``pattern`` without look-behind."""
    return F.regexp_extract("segment", f"^(?:{pattern})", group)


def page_offsets(pages: DataFrame, text: str = "cleaned_text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, page_num, ps, pe of the pages of a document joined by one space (half open), and the columns to ``keep``.

    Pages are summed in stretches of PAGES numbers, and those over a document, so no task holds all its pages.
    """
    rows = pages.withColumn("_size", F.coalesce(F.length(text), F.lit(0)).cast("long") + 1).withColumn("_at", F.floor(F.col("page_num") / PAGES))
    sums = rows.groupBy("doc_id", "_at").agg(F.sum("_size").alias("_own"))
    sums = sums.select(F.col("doc_id").alias("_doc"), F.col("_at").alias("_of"), (F.sum("_own").over(W.partitionBy("doc_id").orderBy("_at")) - F.col("_own")).alias("_before"))
    met = rows.join(sums, rows["doc_id"].eqNullSafe(sums["_doc"]) & (rows["_at"] == sums["_of"]))
    end = F.col("_before") + F.sum("_size").over(W.partitionBy("doc_id", "_at").orderBy("page_num"))
    kind = "int" if keep is None else "long"
    return met.select("doc_id", "page_num", *(keep or []), (end - F.col("_size")).cast(kind).alias("ps"), (end - 1).cast(kind).alias("pe"))


def concatenate(pages: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """doc_id and text of each document; a document is as long as its pages are."""
    ordered = F.array_sort(F.collect_list(F.struct("page_num", F.col(text).alias("t"))))
    return pages.groupBy("doc_id").agg(F.concat_ws(" ", F.transform(ordered, lambda p: p["t"])).alias("text"))


def spanned_pages(spans: DataFrame, offsets: DataFrame, keys: list[str], start: str = "char_start", end: str = "char_end") -> DataFrame:
    """``keys`` and source_pages: the pages whose offsets overlap each span.

    Spans and pages meet in stretches of STRETCH characters, so a long document's spans aren't paired with all its
    pages; a pair counts in the stretch in which the later of the two begins.
    """
    stretch = lambda c: F.floor(c / STRETCH)
    within = lambda lo, hi: F.explode(F.sequence(stretch(lo), stretch(F.greatest(lo, hi - 1)))).alias("_at")
    asked = spans.select("doc_id", *keys, F.col(start).alias("_s"), F.col(end).alias("_e"), within(F.col(start), F.col(end)))
    met = asked.join(offsets.select("*", within(F.col("ps"), F.col("pe"))), ["doc_id", "_at"])
    met = met.filter((F.col("pe") > F.col("_s")) & (F.col("ps") < F.col("_e")) & (F.col("_at") == stretch(F.greatest("ps", "_s"))))
    return met.groupBy("doc_id", *keys).agg(F.array_sort(F.collect_list("page_num")).alias("source_pages"))

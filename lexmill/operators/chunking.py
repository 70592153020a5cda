"""From articles to chunks: whole articles, segments of long ones, definitions of the first, and a glossary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.config import CorpusConfig
from lexmill.functions import spans
from lexmill.functions import text as T

# Enumeration marks, numbered and unnumbered headers of terms.
NOT_DIGIT = "(?<![\\d٠-٩۰-۹])"
ENUMERATION = "([\\d٠-٩۰-۹]{1,2})\\s*[-–]\\s*"
TERM = "([\\d٠-٩۰-۹]{1,2})\\s*[-–]\\s*([^:.]+?)\\s*[:.]"
UNNUMBERED = "\\s*[-–]\\s+([ء-ي][ء-ي\\s]{1,50}?)\\s*[:.]"
#: Bits of chunk_order that hold a chunk's place in its article, and of those the place in a gap between two terms.
IDX_BITS, TERM_BITS = 32, 10
AFTER = "(?<=[\\s.،])"


def segments(body: Column) -> Column:
    """Parts of a body at its enumeration marks, the preamble before each; the whole body if it has under two. Without
    U+0001, which marks the cuts."""
    body = F.translate(body, spans.MARK, "")
    parts = F.split(F.regexp_replace(body, f"(?U){NOT_DIGIT}{ENUMERATION}", spans.MARK + "$0"), spans.MARK)
    preamble = T.strip(F.get(parts, F.lit(0)))
    pieces = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.when(preamble != "", F.concat(preamble, F.lit("\n\n"), T.strip(s))).otherwise(T.strip(s)))
    return F.when(F.size(parts) < 3, F.array(body)).otherwise(pieces)


def definitions(articles: DataFrame) -> DataFrame:
    """The columns of ``articles(doc_id, body_text, ...)`` but its body, with idx, number, term and definition.

    Each body stands alone; bodies of one document are told apart by char_start. idx orders the terms of a body: ten bits
    for those in one gap (numbers have two digits, so it holds under a hundred), the rest for the header. Headers are numbered; where numbers jump, unnumbered headers in between take the missing numbers in turn.
    """
    keys = [c for c in articles.columns if c != "body_text"]
    found = spans.scan(articles.withColumnRenamed("body_text", "text"), f"(?U){NOT_DIGIT}{TERM}")
    head = F.regexp_extract("segment", f"(?U)^(?:{TERM})", 0)
    found = found.withColumn("n", T.page_int(F.regexp_extract("segment", f"(?U)^(?:{TERM})", 1))).withColumn("name", F.regexp_extract("segment", f"(?U)^(?:{TERM})", 2)).withColumn("length", F.length(head))
    one = [c for c in ("doc_id", "char_start") if c in keys]
    found = found.withColumn("until", F.lead("n").over(W.partitionBy(*one).orderBy("pos")))
    # the header's last sign stays before the gap, for what must precede an unnumbered header
    parts = F.split(F.regexp_replace(F.expr("substring(segment, length)"), f"(?U){AFTER}{UNNUMBERED}", spans.MARK + "$0"), spans.MARK)
    room = F.when(F.col("until") > F.col("n") + 1, F.least(F.col("until") - F.col("n") - 1, F.size("parts") - 1)).otherwise(F.lit(0))
    found = found.withColumn("parts", parts).withColumn("room", F.coalesce(room, F.lit(0)))
    kept = F.expr("concat(slice(parts, 1, room), array(array_join(slice(parts, room + 1, greatest(size(parts) - room, 0)), '')))")
    rows = found.select(*keys, "pos", "n", "name", F.posexplode(kept).alias("k", "piece"))
    own = F.regexp_extract("piece", f"(?U)^(?:{UNNUMBERED})", 1)
    used = F.length(F.regexp_extract("piece", f"(?U)^(?:{UNNUMBERED})", 0))
    rows = rows.select(
        *keys, F.shiftleft(F.col("pos").cast("long"), TERM_BITS).bitwiseOR(F.col("k")).alias("idx"), (F.col("n") + F.col("k")).alias("number"), F.when(F.col("k") == 0, F.col("name")).otherwise(own).alias("term"),
        F.when(F.col("k") == 0, F.expr("substring(piece, 2)")).otherwise(F.substring("piece", used + 1, F.length("piece"))).alias("definition"),
    )
    return rows.withColumn("term", T.strip(T.for_display(F.col("term")))).withColumn("definition", T.trim_signs(F.col("definition"), T.SIGNS)).filter("term <> ''")


def with_law(articles: DataFrame, config: CorpusConfig) -> DataFrame:
    """``articles`` with law_id, and its lower-case form that node ids begin with.

    What is not given follows from the row and the config alone, so a document has the same ids in every load.
    """
    if "law_id" not in articles.columns:
        own = F.concat(F.lit(f"{config.law_id}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        articles = articles.withColumn("law_id", own if config.per_document else F.lit(config.law_id))
    return articles.withColumn("_prefix", F.lower("law_id"))


def _texts(df: DataFrame, suffix: Column, body: Column) -> DataFrame:
    """Display and index text with their sizes; the breadcrumb has titles as parsed, the columns for display."""
    crumb = T.breadcrumb(*(F.col(f"{x}_{y}") for x in ("book", "part", "chapter") for y in ("number", "title")), F.col("article_number"), suffix)
    out = df.withColumn("text", F.concat(crumb, F.lit("\n\n"), T.for_display(body)))
    out = out.withColumn("text_normalized", T.for_index(F.col("text"))).withColumn("char_count", F.length("text")).withColumn("token_count_est", T.estimate_tokens(F.col("text")))
    return out.withColumns({f"{x}_title": T.for_display(F.col(f"{x}_title")) for x in ("book", "part", "chapter")})


def build_chunks(articles: DataFrame, offsets: DataFrame, config: CorpusConfig) -> DataFrame:
    """Chunks in order of chunk_order: every article, then its segments or definitions.

    The article with number 1 gives definitions; bodies longer than the limit with two marks or more give segments.
    Node ids begin with the law: the column law_id of ``articles`` where there is one; else the config's, followed by the
    doc_id unless the config says that all documents are one law.
    """
    articles = with_law(articles, config)
    pages = spans.spanned_pages(articles, offsets, ["char_start"])
    base = articles.join(pages, ["doc_id", "char_start"], "left").withColumn("source_pages", F.coalesce("source_pages", F.array().cast("array<int>")))
    base = base.withColumn("body_text", T.strip(F.col("body_text"))).withColumn("article_id", F.format_string("%s-art%03d", "_prefix", "article_number"))
    none = lambda kind: F.lit(None).cast(kind)
    same = {"defined_term": none("string"), "term_variants": F.array().cast("array<string>"), "segment_index": none("int"), "segment_total": none("int")}

    whole = _texts(base.withColumns(same | {"node_type": F.lit("Article"), "idx": F.lit(0).cast("long"), "node_id": F.col("article_id")}), F.lit(""), F.col("body_text"))
    long = base.filter((F.col("article_number") != 1) & (F.length("body_text") > config.long_article)).withColumn("parts", segments(F.col("body_text"))).filter(F.size("parts") > 1)
    long = long.select("*", F.size("parts").alias("total"), F.posexplode("parts").alias("i", "part")).withColumn("idx", (F.col("i") + 1).cast("long"))
    long = long.withColumns(same | {"node_type": F.lit("ArticleSegment"), "segment_index": F.col("idx").cast("int"), "segment_total": F.col("total"), "node_id": F.format_string("%s-seg%02d", "article_id", "idx")})
    long = _texts(long, F.concat(F.lit(" → جزء "), F.col("idx").cast("string"), F.lit("/"), F.col("total").cast("string")), F.col("part"))
    first = definitions(base.filter("article_number = 1"))
    named = F.when(F.coalesce("number", F.lit(0)) != 0, F.concat(F.lit(" → التعريف "), F.col("number").cast("string"), F.lit(": "), F.col("term"))).otherwise(F.concat(F.lit(" → "), F.col("term")))
    first = first.withColumns(same | {"node_type": F.lit("Definition"), "defined_term": F.col("term"), "term_variants": T.term_variants(F.col("term")), "node_id": F.concat("_prefix", F.lit("-def-"), T.slug(F.col("term"), F.col("number")))})
    first = _texts(first, named, F.col("definition"))
    columns = [
        "doc_id", "law_id", "node_id", "node_type", "book_number", "book_title", "part_number", "part_title", "chapter_number", "chapter_title", "article_number", "defined_term", "term_variants",
        "segment_index", "segment_total", "text", "text_normalized", "char_count", "token_count_est", "source_pages", "char_start", "idx",
    ]
    rows = reduce(DataFrame.union, [x.select(columns) for x in (whole, long, first)])
    rows = rows.withColumn("chunk_order", F.shiftleft(F.col("char_start").cast("long"), IDX_BITS).bitwiseOR(F.col("idx"))).withColumn("is_definition", F.col("node_type") == "Definition")
    return rows.withColumn("law_title", F.lit(config.law_title)).drop("char_start", "idx")


def glossary(chunks: DataFrame) -> DataFrame:
    """term, node_id and law_id; of several definitions of a term in a law the last counts."""
    last = F.row_number().over(W.partitionBy("law_id", "defined_term").orderBy(F.desc("doc_id"), F.desc("chunk_order")))
    return chunks.filter("node_type = 'Definition'").withColumn("_n", last).filter("_n = 1").select(F.col("defined_term").alias("term"), "node_id", "law_id")

"""Registry of the library's own queries over the driver's tables, each with SQL for the same rows.

Orders stand in for articles (with customers, nations and regions above them), line items for segments and
references, conversations for paged documents. Each query runs one operator over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import spans
from lexmill.functions import text as T
from lexmill.operators import adjacency, annotate, chunking, context, graph, presentation, quality, retrieval, structure, vector, vector_index
from lexmill.providers import embed_stored
from lexmill.session import parts_for, shared_folder, table
from lexmill.sources.files import pages_of
from lexmill.streaming import history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: White space as the patterns of the library see it, for SQL whose own class is ASCII only.
SPACE = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# -- text --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩')) AS eastern, sha256(text) AS western FROM documents")
def text_digits(spark, sf):
    east = T.eastern_digits(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", sha(east).alias("eastern"), sha(T.western_digits(east)).alias("western"))


@query(f"SELECT doc_id, greatest(1, round_even(length(text) / 3.4::DOUBLE, 0))::INT AS tokens, sha256(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) AS flat FROM documents")
def text_flat_and_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), sha(T.squeeze(F.col("text"))).alias("flat"))


@query("SELECT conv_id, turn, CASE WHEN contains(t, chr(10) || chr(10)) THEN split_part(t, chr(10) || chr(10), 1) ELSE '' END AS crumb FROM (SELECT conv_id, turn, role || chr(10) || chr(10) || text AS t FROM conversations)")
def text_breadcrumb_of(spark, sf):
    text = F.concat("role", F.lit("\n\n"), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.breadcrumb_of(text).alias("crumb"))


@query(
    "SELECT c_custkey, concat_ws(' ← ', 'الكتاب ' || n_regionkey || ': ' || n_name, CASE WHEN c_nationkey % 5 > 0 THEN 'الباب ' || c_nationkey END, 'المادة (' || c_custkey || ')') AS crumb FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
def text_breadcrumb(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey"))
    return df.select("c_custkey", T.breadcrumb(F.col("n_regionkey"), F.col("n_name"), part, F.lit(""), F.lit(None).cast("int"), F.lit(None).cast("string"), F.col("c_custkey")).alias("crumb"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN printf('%03d', p_size) ELSE left(regexp_replace(p_name, '\\s+', '-', 'g'), 40) END AS slug FROM part")
def text_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("slug"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi'), '(mark)', '<mark>\\1</mark>', 'gi')) AS marked FROM documents")
def text_highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sha(T.highlight(F.col("text"), F.lit("the of? mark!"))).alias("marked"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 100 > 9 THEN (o_orderkey % 10) * 10 + o_orderkey % 100 // 10 ELSE o_orderkey % 100 END::INT AS stored, (o_orderkey % 100)::INT AS typed FROM orders"
)
def text_numbers(spark, sf):
    east = T.eastern_digits((F.col("o_orderkey") % 100).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", T.page_int(east).alias("stored"), T.typed_int(east).alias("typed"))


@query("SELECT doc_id, sha256(regexp_replace(replace(text, 'e', 'e\u064e\u0640'), '[\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}\\x{0640}]', '', 'g')) AS bare FROM documents")
def text_diacritics(spark, sf):
    marked = F.replace("text", F.lit("e"), F.lit("e\u064e\u0640"))
    return table(spark, sf, "documents").select("doc_id", sha(T.strip_diacritics(marked)).alias("bare"))


@query("SELECT doc_id, sha256(text) AS bare FROM documents")
def text_private_use(spark, sf):
    marked = F.replace("text", F.lit("t"), F.lit("t\ue000\uf8ff"))
    return table(spark, sf, "documents").select("doc_id", sha(T.strip_private_use(marked)).alias("bare"))


# -- pages, structure, chunks ------------------------------------------------------------------------------------


#: A page between a gazette's header and a line that holds only its number, in any digits.
HEADED = "الجريدة الرسمية العدد 14 مكرر سنة ٢٠٢٥ "


@query(
    f"SELECT doc_id, sha256(regexp_replace(regexp_replace('{HEADED}' || text || chr(10) || ' ١2 ' || chr(10) || 'end', 'الجر{SPACE}*[^\\x{{0009}}-\\x{{000D}} ]{{0,5}}{SPACE}*[يی]دة{SPACE}+الرسم[يی]ة(.|\\n){{1,250}}?سنة{SPACE}*[0-9٠-٩۰-۹]+', ' ', 'g'), "
    f"'(?m)^{SPACE}*[0-9٠-٩۰-۹]{{1,4}}{SPACE}*$', '', 'g')) AS kept FROM documents".replace("\\\\", "\\")
)
def text_page_artifacts(spark, sf):
    page = F.concat(F.lit(HEADED), F.col("text"), F.lit("\n ١2 \nend"))
    return table(spark, sf, "documents").select("doc_id", sha(T.strip_page_artifacts(page)).alias("kept"))


@query("SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, 'a', '')) AS letters FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def embed_documents(spark, sf):
    """Vectors by text, each text sent once: a provider that tells a text's length and its letters a."""
    provider = lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]
    out = embed_stored(table(spark, sf, "documents").select("doc_id", "text"), "text", provider, f"{shared_folder(spark)}/vectors")
    part = lambda i: F.get("embedding", F.lit(i)).cast("long")
    return out.select("doc_id", part(0).alias("chars"), part(1).alias("letters"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.coalesce("text", F.lit("")).alias("cleaned_text"))


PAGES = "p AS (SELECT conv_id AS doc_id, turn::INT AS page_num, coalesce(text, '') AS t FROM conversations), o AS (SELECT doc_id, page_num, (sum(length(t) + 1) OVER w - length(t) - 1)::INT AS ps, (sum(length(t) + 1) OVER w - 1)::INT AS pe FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_num))"


@query(f"WITH {PAGES} SELECT doc_id, page_num, ps, pe FROM o")
def pages_offsets(spark, sf):
    return spans.page_offsets(_pages(spark, sf))


@query(f"WITH {PAGES} SELECT doc_id, sha256(string_agg(t, ' ' ORDER BY page_num)) AS text_sha FROM p GROUP BY doc_id")
def pages_concatenated(spark, sf):
    return spans.concatenate(_pages(spark, sf)).select("doc_id", sha(F.col("text")).alias("text_sha"))


@query(f"WITH {PAGES} SELECT doc_id, k, string_agg(page_num, ',' ORDER BY page_num) AS source_pages FROM o JOIN (SELECT doc_id, unnest(range(0, max(pe) // 1000 + 1))::INT AS k FROM o GROUP BY doc_id) s USING (doc_id) WHERE pe > k * 1000 AND ps < k * 1000 + 1500 GROUP BY doc_id, k")
def pages_of_spans(spark, sf):
    """Long spans, most over several pages, up to the end of each document."""
    offsets = spans.page_offsets(_pages(spark, sf))
    ranges = offsets.groupBy("doc_id").agg(F.max("pe").alias("end")).select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("end") / 1000).cast("int"))).alias("k"))
    ranges = ranges.select("doc_id", "k", (F.col("k") * 1000).alias("char_start"), (F.col("k") * 1000 + 1500).alias("char_end"))
    return spans.spanned_pages(ranges, offsets, ["k"]).withColumn("source_pages", joined(F.col("source_pages")))


@query(f"WITH {PAGES} SELECT doc_id, k, string_agg(page_num, ',' ORDER BY page_num) AS source_pages FROM o JOIN (SELECT doc_id, unnest(range(0, max(pe) // 100 + 1))::INT AS k FROM o GROUP BY doc_id) s USING (doc_id) WHERE pe > k * 100 AND ps < k * 100 + 150 GROUP BY doc_id, k")
def pages_of_all_spans(spark, sf):
    """Short spans up to the end of each document."""
    offsets = spans.page_offsets(_pages(spark, sf))
    ranges = offsets.groupBy("doc_id").agg(F.max("pe").alias("end")).select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("end") / 100).cast("int"))).alias("k"))
    ranges = ranges.select("doc_id", "k", (F.col("k") * 100).alias("char_start"), (F.col("k") * 100 + 150).alias("char_end"))
    return spans.spanned_pages(ranges, offsets, ["k"]).withColumn("source_pages", joined(F.col("source_pages")))


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_pages, length(text) - len(string_split(text, chr(10))) + 1 AS n_chars FROM documents WHERE text IS NOT NULL")
def source_pages_of_documents(spark, sf):
    pages = pages_of(table(spark, sf, "documents").filter("text IS NOT NULL"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("raw_text")).alias("n_chars"))


@query(
    "WITH a AS (SELECT o_custkey AS doc_id, row_number() OVER w AS n, o_orderpriority AS body, 'مادة (' || row_number() OVER w || '): ' AS head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) "
    "SELECT doc_id, n::INT AS article_number, body AS body_text, 1 AS book_number, 'عام' AS book_title, (17 + sum(length(head || body) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(head || body) - 1)::INT AS char_start FROM a"
)
def structure_articles(spark, sf):
    """A text per customer: a book header, then an article per order."""
    from pyspark.sql.window import Window as W

    rows = table(spark, sf, "orders").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    rows = rows.withColumn("t", F.concat(F.lit("مادة ("), F.col("n").cast("string"), F.lit("): "), "o_orderpriority"))
    texts = rows.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat_ws(" ", F.lit("الكتاب الأول عام"), F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"])).alias("text"))
    return structure.parse(texts).select("doc_id", "article_number", "body_text", "book_number", "book_title", "char_start")


@query(
    "WITH a AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderpriority AS body FROM orders) "
    "SELECT doc_id, n::INT AS article_number, body AS body_text, CASE WHEN (n - 1) // 4 % 2 = 0 THEN 1 ELSE 2 END AS book_number, 'ك ' || (n - (n - 1) % 4) AS book_title, 3 AS part_number, 'ب ' || (n - (n - 1) % 2) AS part_title, "
    "CASE WHEN n % 3 = 0 OR n % 6 = 4 THEN 4 END AS chapter_number, CASE WHEN n % 3 = 0 THEN 'ف ' || n WHEN n % 6 = 4 THEN 'ف ' || (n - 1) ELSE '' END AS chapter_title FROM a"
)
def structure_places(spark, sf):
    """A text per customer, an article per order, on pages of one order each: a book before every fourth, a part before
    every second, which clears the chapter, a chapter before every third."""
    from pyspark.sql.window import Window as W

    rows = table(spark, sf, "orders").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    n = F.col("n").cast("string")
    book = F.when(F.col("n") % 4 == 1, F.concat(F.when(F.col("n") % 8 == 1, F.lit("الكتاب الأول ك ")).otherwise(F.lit("الكتاب الثاني ك ")), n))
    part, chapter = F.when(F.col("n") % 2 == 1, F.concat(F.lit("الباب الثالث ب "), n)), F.when(F.col("n") % 3 == 0, F.concat(F.lit("الفصل الرابع ف "), n))
    pages = rows.select(F.col("o_custkey").alias("doc_id"), F.col("n").alias("page_num"), F.concat_ws(" ", book, part, chapter, F.concat(F.lit("مادة ("), n, F.lit("): "), "o_orderpriority")).alias("cleaned_text"))
    return structure.parse_pages(pages).select("doc_id", "article_number", "body_text", *(f"{x}_{y}" for x in structure.LEVELS for y in ("number", "title")))


@query(
    "SELECT k AS o_orderkey, i::INT AS number FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN [1, 2, 3, 4] WHEN o_orderkey % 4 = 1 THEN [2, 3, 6, 7] WHEN o_orderkey % 4 = 2 THEN [1, 2, 1, 2] ELSE [1, 2, 3, 1] END AS l FROM orders), LATERAL (SELECT unnest(l) AS i)"
)
def structure_renumbering(spark, sf):
    """Four patterns of read numbers: unread, near, far ahead and back."""
    pick = F.element_at(F.array(F.array(F.lit(1), F.lit(None), F.lit(9), F.lit(None)), F.array(F.lit(2), F.lit(None), F.lit(6), F.lit(99)), F.array(F.lit(1), F.lit(2), F.lit(1), F.lit(None)), F.array(F.lit(None), F.lit(2), F.lit(99), F.lit(1))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(structure.renumber(pick)).alias("number"))


@query(
    "WITH b AS (SELECT l_orderkey, min({'n': l_linenumber, 'f': l_returnflag}) AS m, count(*) AS n FROM lineitem GROUP BY l_orderkey) "
    "SELECT l_orderkey, n::INT AS n_parts, 'تمهيد' || CASE WHEN n < 2 THEN ' ' ELSE chr(10) || chr(10) END || m.n || '- ' || m.f || '.' AS first FROM b"
)
def chunk_segments(spark, sf):
    """A body per order, a preamble and a mark per line item."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.lit("- "), "l_returnflag", F.lit(".")).alias("t")))).alias("m"))
    parts = chunking.segments(F.concat(F.lit("تمهيد "), F.array_join(F.transform("m", lambda x: x["t"]), " ")))
    return lines.select("l_orderkey", F.size(parts).alias("n_parts"), F.get(parts, F.lit(0)).alias("first"))


# -- annotation and routing --------------------------------------------------------------------------------------


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 400)::INT AS a, (l_suppkey % 50)::INT AS b, (l_orderkey % 300)::INT AS c FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter([a, b, c], lambda x: x BETWEEN 1 AND 298 AND x <> b + 1))), ',') AS refs, 'قانون العمل رقم ' || a || ' لسنة 2003' AS laws FROM t"
)
def annotate_references(spark, sf):
    a, b, c = (F.col(k).cast("int") % m for k, m in (("l_partkey", 400), ("l_suppkey", 50), ("l_orderkey", 300)))
    s = lambda x: x.cast("string")
    text = F.concat(F.lit("وفقا للمادة "), s(a), F.lit(" من المواد ("), s(b), F.lit("، "), s(c), F.lit(") من قانون  العمل رقم "), s(a), F.lit(" لسنة 2003"))
    refs = annotate.cross_refs(text, F.lit(298), b + 1)
    # patterns take longer than reading, so rows of few large splits are dealt over all cores
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").hint("rebalance")
    return lines.select("l_orderkey", "l_linenumber", joined(refs).alias("refs"), F.array_join(annotate.external_refs(text), "|").alias("laws"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'الأجر' WHEN 1 THEN 'الأجر,العامل' ELSE 'العامل' END AS terms FROM orders"
)
def annotate_terms(spark, sf):
    """Texts with surface forms of one or both of two terms; the third has two words and is never found."""
    forms = F.element_at(F.array(F.lit("يصرف للأجر"), F.lit("أجور العاملين والأجر"), F.lit("على عامل واحد صاحب العمل")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    texts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id"), forms.alias("text"))
    terms = spark.createDataFrame([("الأجر",), ("العامل",), ("صاحب العمل",)], "term string").select("term", T.term_variants(F.col("term")).alias("variants"))
    return annotate.terms_used(texts, terms).select(F.col("node_id").alias("o_orderkey"), F.array_join("defined_terms_used", ",").alias("terms"))


@query(
    "WITH t AS (SELECT o_orderkey, (o_orderkey % 400)::INT AS a, (o_custkey % 310)::INT AS b, (o_custkey % 310 + o_orderkey % 90 - 30)::INT AS c0 FROM orders), u AS (SELECT *, greatest(c0, 0) AS c FROM t) "
    "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_concat([a], CASE WHEN b BETWEEN 1 AND 298 AND c BETWEEN 1 AND 298 AND abs(b - c) <= 50 THEN range(least(b, c), greatest(b, c) + 1) ELSE [b, c] END), lambda x: x BETWEEN 1 AND 298))), ',') AS refs FROM u"
)
def route_questions(spark, sf):
    a, b = F.col("o_orderkey") % 400, F.col("o_custkey") % 310
    c = F.greatest(b + F.col("o_orderkey") % 90 - 30, F.lit(0))
    question = F.concat(F.lit("ما حكم المادة "), a.cast("string"), F.lit(" مع المواد "), b.cast("string"), F.lit(" إلى "), c.cast("string"), F.lit("؟"))
    return table(spark, sf, "orders").select("o_orderkey", joined(retrieval.route(question)).alias("refs"))


@query(
    "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'lawyer' ELSE 'user' END AS mode, CASE WHEN turn % 2 = 0 THEN turn::INT WHEN role = 'assistant' THEN 8 ELSE 5 END AS primary_k, CASE WHEN role = 'assistant' THEN 20 ELSE 12 END AS max_context_chunks FROM conversations"
)
def route_profiles(spark, sf):
    asked = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", F.lit("lawyer")).otherwise(F.col("role")).alias("mode"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("int")).alias("primary_k"))
    return retrieval.resolved(asked).select("conv_id", "turn", "mode", "primary_k", "max_context_chunks")


# -- graph -------------------------------------------------------------------------------------------------------


def _statute(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.concat(F.lit("art"), F.col("o_orderkey").cast("string")).alias("node_id"), F.lit("Article").alias("node_type"), F.lit("L").alias("law_id"), F.col("n_regionkey").alias("book_number"), F.lit("b").alias("book_title"),
        F.when(F.col("n_nationkey") % 7 > 0, F.col("n_nationkey")).alias("part_number"), F.col("n_name").alias("part_title"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")).alias("chapter_number"), F.col("o_orderpriority").alias("chapter_title"),
        F.col("o_orderkey").cast("int").alias("article_number"), F.col("o_orderkey").alias("chunk_order"),
    )


STATUTE = (
    "a AS (SELECT 'art' || o_orderkey AS node_id, 'L' AS law_id, n_regionkey AS b, CASE WHEN n_nationkey % 7 > 0 THEN n_nationkey END AS p, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS c, n_name, o_orderpriority, o_orderkey "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
)


@query(f"WITH {STATUTE} SELECT law_id, b AS book_number, p AS part_number, c AS number, min_by(o_orderpriority, o_orderkey) AS title FROM a WHERE p IS NOT NULL AND c IS NOT NULL GROUP BY ALL")
def graph_chapters(spark, sf):
    return graph.hierarchy_nodes(_statute(spark, sf), "chapter")


@query(
    f"WITH {STATUTE}, i AS (SELECT *, 'book:L/' || b || '/' AS bi, 'part:L/' || b || '/' || p || '/' AS pi, 'chapter:L/' || b || '/' || p || '/' || c || '/' AS ci FROM a), "
    "e AS (SELECT law_id AS src, bi AS dst, 'HAS_BOOK' AS type FROM i UNION SELECT bi, pi, 'HAS_PART' FROM i UNION SELECT pi, ci, 'HAS_CHAPTER' FROM i UNION SELECT CASE WHEN c IS NOT NULL THEN ci ELSE pi END, node_id, 'HAS_ARTICLE' FROM i) "
    "SELECT src, dst, type FROM e WHERE src IS NOT NULL AND dst IS NOT NULL"
)
def graph_hierarchy_edges(spark, sf):
    return graph.hierarchy_edges(_statute(spark, sf)).select("src", "dst", "type")


@query(f"WITH {STATUTE}, n AS (SELECT node_id AS src, lead(node_id) OVER (ORDER BY o_orderkey) AS dst, 'NEXT' AS type FROM a) SELECT * FROM n WHERE dst IS NOT NULL")
def graph_next_edges(spark, sf):
    return graph.next_edges(_statute(spark, sf)).select("src", "dst", "type")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    own = F.concat(F.lit("art"), F.col("l_orderkey").cast("string"), F.lit("-seg"), F.col("l_linenumber").cast("string"))
    return lines.select(own.alias("node_id"), F.lit("ArticleSegment").alias("node_type"), F.lit("L").alias("law_id"), F.col("l_orderkey").cast("int").alias("article_number"), F.col("l_linenumber").cast("int").alias("segment_index"), F.lit(7).alias("segment_total"), F.array(F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")).alias("cross_refs"))


@query("SELECT DISTINCT 'art' || l_orderkey AS src, 'art' || l_orderkey || '-seg' || l_linenumber AS dst, 'HAS_SEGMENT' AS type, l_linenumber::INT AS idx, 7 AS total FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey")
def graph_segment_edges(spark, sf):
    return graph.segment_edges(_statute(spark, sf).unionByName(_segments(spark, sf), allowMissingColumns=True))


@query("SELECT DISTINCT 'art' || l_orderkey || '-seg' || l_linenumber AS src, 'art' || r AS dst, 'REFERENCES' AS type FROM (SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey]) AS r FROM lineitem) SEMI JOIN orders ON r = o_orderkey WHERE r <> l_orderkey")
def graph_reference_edges(spark, sf):
    return graph.reference_edges(_statute(spark, sf).unionByName(_segments(spark, sf), allowMissingColumns=True)).select("src", "dst", "type")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as definitions, a law a type; line items as articles that use the terms of their part and of the part after it."""
    part = table(spark, sf, "part")
    term = lambda key: F.concat(F.lit("term "), key.cast("string"))
    law = F.col("p_type").alias("law_id")
    own = part.select(law, F.concat(F.lit("def"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("Definition").alias("node_type"), term(F.col("p_partkey")).alias("defined_term"), F.col("p_partkey").alias("chunk_order"), F.col("p_name").alias("text"))
    lines = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    node = F.concat_ws("-", F.lit("art"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    used = F.array(term(F.col("p_partkey")), term(F.col("p_partkey") + 1))
    uses = lines.select(law, node.alias("node_id"), F.lit("Article").alias("node_type"), used.alias("defined_terms_used"), F.array("l_returnflag", "l_linestatus").alias("external_refs"))
    rows = own.unionByName(uses, allowMissingColumns=True)
    more = {"text_normalized": F.upper("text"), "char_count": F.length("text"), "token_count_est": T.estimate_tokens(F.col("text")), "source_pages": F.array(F.lit(1)), "term_variants": T.term_variants(F.col("text"))}
    return rows.withColumns(more)


@query(
    "WITH u AS (SELECT p_type, 'art-' || l_orderkey || '-' || l_linenumber AS src, unnest([p_partkey, p_partkey + 1]) AS used FROM lineitem JOIN part ON l_partkey = p_partkey) "
    "SELECT DISTINCT src, 'def' || p_partkey AS dst, 'USES_TERM' AS type FROM u JOIN part p ON p.p_partkey = used AND p.p_type = u.p_type"
)
def graph_term_edges(spark, sf):
    return graph.term_edges(_terms(spark, sf)).select("src", "dst", "type")


@query("SELECT DISTINCT 'art-' || l_orderkey || '-' || l_linenumber AS src, unnest([l_returnflag, l_linestatus]) AS dst, 'EXTERNAL_REF' AS type FROM lineitem JOIN part ON l_partkey = p_partkey")
def graph_external_edges(spark, sf):
    return graph.external_edges(_terms(spark, sf)).select("src", "dst", "type")


@query("SELECT 'def' || p_partkey AS node_id, 'term ' || p_partkey AS term, p_name AS definition_text, upper(p_name) AS text_normalized, length(p_name)::INT AS char_count FROM part")
def graph_definitions(spark, sf):
    return graph.text_nodes(_terms(spark, sf), "Definition").select("node_id", "term", "definition_text", "text_normalized", "char_count")


@query("SELECT p_brand, max_by(p_name, p_partkey) AS p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def graph_upsert(spark, sf):
    return graph.upserted(table(spark, sf, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", "p_partkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def graph_duplicates(spark, sf):
    return graph.duplicates(table(spark, sf, "orders"), "o_custkey")


# -- retrieval ---------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings")
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), vectors.select(F.col("vec_id").alias("node_id"), F.pmod("label", F.lit(3)).cast("string").alias("label"), "embedding")


NEAREST = (
    "s AS (SELECT q.vec_id AS qid, (n.label % 3)::VARCHAR AS label, n.vec_id AS node_id, (1 + list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[])) / 2 AS score FROM embeddings q, embeddings n WHERE q.vec_id % 100 = 0), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY round(score, 12) DESC, node_id) AS n FROM s)"
)


@query(f"WITH {NEAREST} SELECT qid, label, node_id, round(score, 9) AS score, n::INT AS rank FROM l WHERE n <= 5")
def vector_topk(spark, sf):
    return vector.topk(*_vectors(spark, sf), 5).select("qid", "label", "node_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {NEAREST} SELECT qid, label, node_id, round(score, 9) AS score, n::INT AS rank FROM l WHERE n <= 5")
def vector_index_exact(spark, sf):
    """The same from a stored index that reads all its lists and bounds every distance: built by half of the rows, the others added."""
    asked, nodes = _vectors(spark, sf)
    path = f"{shared_folder(spark)}/index"
    vector_index.build(nodes.filter("node_id % 2 = 0"), path)
    vector_index.add(nodes.filter("node_id % 2 <> 0"), path)
    return vector_index.search(asked, path, 5, None, None).select("qid", "label", "node_id", F.round("score", 9).alias("score"), "rank")


@query()
def vector_index_nearest(spark, sf):
    """Of each query's nearest lists only, ranked exactly; tests measure the recall."""
    asked, nodes = _vectors(spark, sf)
    path = f"{shared_folder(spark)}/index"
    vector_index.build(nodes, path)
    return vector_index.search(asked, path, 5, 8, 8).select("qid", "label", "node_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {NEAREST}, m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, label, node_id) AS r FROM l WHERE n <= 8) SELECT qid, label, node_id, round(score, 9) AS score, r::INT AS rank FROM m WHERE r <= 8")
def vector_topk_merged(spark, sf):
    return vector.topk_merged(*_vectors(spark, sf), 8, ("0", "1", "2")).select("qid", "label", "node_id", F.round("score", 9).alias("score"), "rank")


@query(
    "WITH s AS (SELECT DISTINCT o_custkey AS qid, o_orderkey AS node_id FROM orders), m AS (SELECT DISTINCT qid, node_id, l_partkey AS target FROM s JOIN lineitem ON node_id = l_orderkey), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY node_id, target) AS n FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY qid, node_id ORDER BY target) AS j FROM c WHERE n <= 100), "
    "f AS (SELECT qid, target, min(node_id) AS node_id FROM k WHERE j <= 3 GROUP BY qid, target) SELECT qid, target, row_number() OVER (PARTITION BY qid ORDER BY node_id, target)::INT AS pos FROM f"
)
def retrieval_hop(spark, sf):
    seeds = table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("node_id"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return retrieval.hop(seeds, edges, 3, parts=parts_for(seeds, edges))


@query(ORACLE["retrieval_hop"])
def retrieval_hop_blocks(spark, sf):
    """The same rows from sorted lists of targets, of which the limits decide how much is read."""
    seeds = table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("node_id"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return adjacency.hop(seeds, adjacency.build(edges), 3)


@query(
    ORACLE["retrieval_hop"].rsplit("SELECT qid, target,", 1)[0]
    + ", p AS (SELECT qid, target, row_number() OVER (PARTITION BY qid ORDER BY node_id, target)::INT AS pos FROM f) "
    "SELECT qid, p_partkey AS node_id, p_size::INT AS article_number, p_brand AS breadcrumb, sha256(p_brand || chr(10) || chr(10) || p_name) AS text, 0::DOUBLE AS score, 'cross_ref' AS source, pos FROM p JOIN part ON target = p_partkey"
)
def retrieval_expanded(spark, sf):
    """Nodes one edge away as chunks of a question: parts that the lines of a customer's orders name."""
    seeds = table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("node_id"), F.lit(3).alias("per"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("REFERENCES").alias("type"))
    others = edges.select("src", F.col("src").alias("dst"), F.lit("NEXT").alias("type"))
    part = table(spark, sf, "part")
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.lit("Article").alias("node_type"), F.col("p_size").cast("int").alias("article_number"), F.concat_ws("\n\n", "p_brand", "p_name").alias("text"))
    found = retrieval.expand(seeds, edges.union(others), nodes, "REFERENCES", F.col("per"), "cross_ref", parts=parts_for(seeds, edges))
    return found.select("qid", "node_id", "article_number", "breadcrumb", sha(F.col("text")).alias("text"), "score", "source", "pos")


@query("SELECT o_custkey AS qid, 'art' || o_orderkey AS node_id, o_orderkey::INT AS article_number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS pos, 1.0::DOUBLE AS score FROM orders")
def retrieval_explicit(spark, sf):
    asked = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("qid")).agg(F.collect_list(F.col("o_orderkey").cast("int")).alias("refs"))
    nodes = _statute(spark, sf).select("node_id", "node_type", "article_number", F.lit("a\n\nb").alias("text"))
    return retrieval.explicit(asked, nodes).select("qid", "node_id", "article_number", "pos", "score")


def _found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    source = F.element_at(F.array(*map(F.lit, retrieval.SOURCES)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return rows.select(
        F.col("o_custkey").alias("qid"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node_id"), F.when(F.col("l_linestatus") == "F", F.lit("Definition")).otherwise(F.lit("Article")).alias("node_type"),
        F.col("l_partkey").cast("int").alias("article_number"), F.lit("").alias("breadcrumb"), F.concat(F.lit("text "), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_discount") / 3).alias("score"), source.alias("source"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("pos"),
    )


FOUND = (
    "f AS (SELECT o_custkey AS qid, 'p' || l_partkey AS node_id, CASE WHEN l_linestatus = 'F' THEN 'Definition' ELSE 'Article' END AS node_type, l_partkey::INT AS article_number, 'text ' || l_partkey AS text, l_discount / 3 AS score, "
    "l_linenumber % 4 AS pri, ['explicit', 'primary', 'definition', 'cross_ref'][l_linenumber % 4 + 1] AS source, (l_orderkey * 10 + l_linenumber)::INT AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "d AS (SELECT *, row_number() OVER (PARTITION BY qid, node_id ORDER BY pri, pos, score DESC, node_type, article_number, text) AS n FROM f), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pri, pos, node_id)::INT AS rank FROM d WHERE n = 1), k AS (SELECT * FROM r WHERE rank <= 12)"
)


@query(f"WITH {FOUND} SELECT qid, node_id, source, pos, rank FROM k")
def retrieval_dedupe_and_cap(spark, sf):
    return retrieval.dedupe_and_cap(_found(spark, sf), 12).select("qid", "node_id", "source", "pos", "rank")


@query(
    f"WITH {FOUND}, s AS (SELECT *, CASE WHEN source = 'explicit' THEN 0 WHEN node_type = 'Definition' THEN 1 WHEN source = 'primary' THEN 2 WHEN source = 'cross_ref' THEN 3 END AS section FROM k), "
    "h AS (SELECT qid, section, chr(10) || ['[المواد المطلوبة صراحة]', '[تعريفات]', '[المواد الأساسية]', '[المواد المُحال إليها]'][section + 1] || chr(10) || string_agg(text || chr(10) || '---', chr(10) ORDER BY rank) AS part FROM s WHERE section IS NOT NULL GROUP BY qid, section), "
    "g AS (SELECT qid, string_agg(part, chr(10) ORDER BY section) AS parts FROM h GROUP BY qid) "
    "SELECT qid, sha256('السؤال: q' || qid || chr(10) || chr(10) || 'النصوص المرجعية:' || coalesce(chr(10) || parts, '')) AS prompt FROM (SELECT DISTINCT qid FROM f) LEFT JOIN g USING (qid)"
)
def context_prompts(spark, sf):
    found = retrieval.dedupe_and_cap(_found(spark, sf), 12)
    asked = _found(spark, sf).select("qid").distinct().withColumn("question", F.concat(F.lit("q"), F.col("qid").cast("string")))
    return context.prompts(asked, found).select("qid", sha(F.col("prompt")).alias("prompt"))


@query(f"WITH {FOUND} SELECT qid, count(*)::INT AS n, min_by(node_id, rank) AS first_node, min_by(round_even(score, 3), rank) AS first_score, min_by(left(text, 300), rank) AS first_excerpt FROM k GROUP BY qid")
def context_sources(spark, sf):
    listed = context.sources(retrieval.dedupe_and_cap(_found(spark, sf), 12))
    first = F.get("sources", F.lit(0))
    return listed.select("qid", F.size("sources").alias("n"), first["node_id"].alias("first_node"), first["score"].alias("first_score"), first["excerpt"].alias("first_excerpt"))


@query(f"SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '{context.SYSTEM['lawyer'].replace(chr(39), chr(39) * 2)}' ELSE '{context.SYSTEM['user'].replace(chr(39), chr(39) * 2)}' END AS told FROM conversations")
def context_system_prompts(spark, sf):
    mode = F.when(F.col("role") == "assistant", F.lit("lawyer")).otherwise(F.lit("user"))
    return table(spark, sf, "conversations").select("conv_id", "turn", context.system_prompt(mode).alias("told"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, sf):
    one = table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return one.join(other, "vec_id").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


# -- presentation ------------------------------------------------------------------------------------------------


@query(
    "SELECT event_id, event_id % 1000 + user_id AS total, CASE WHEN event_type = 'click' THEN 'direct' WHEN event_id % 8 > 0 THEN printf('similarity %.3f', (event_id % 8) / 8) ELSE 'expansion' END AS label, "
    "CASE event_id % 4 WHEN 0 THEN 'paused' WHEN 1 THEN 'missing_model' WHEN 2 THEN 'authentication' ELSE 'backend' END AS error FROM events"
)
def presentation_labels(spark, sf):
    events = table(spark, sf, "events")
    elapsed = F.create_map(F.lit("route"), F.col("event_id") % 1000, F.lit("embed"), F.col("user_id"))
    source = F.when(F.col("event_type") == "click", F.lit("explicit")).otherwise(F.lit("primary"))
    message = F.element_at(F.array(F.lit("Instance is PAUSED"), F.lit("DeploymentNotFound"), F.lit("HTTP 401"), F.lit("other")), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select("event_id", presentation.total_latency(elapsed).alias("total"), presentation.score_label(source, (F.col("event_id") % 8) / 8).alias("label"), presentation.error_class(message).alias("error"))


@query("SELECT n_nationkey, CASE WHEN contains(n_name, 'IA') THEN 'x,y' WHEN contains(n_name, 'AN') THEN 'z' ELSE 'd' END AS shown FROM nation")
def presentation_suggestions(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(presentation.suggestions(F.col("n_name"), {"IA": ["x", "y"], "AN": ["z"]}, ["d"]), ",").alias("shown"))


@query(f"WITH {FOUND} SELECT qid, 'question' AS src, 'article_' || article_number AS dst FROM k GROUP BY ALL")
def presentation_star(spark, sf):
    return presentation.star(retrieval.dedupe_and_cap(_found(spark, sf), 12))["edges"]


@query(f"WITH {FOUND}, c AS (SELECT qid, 'article_' || article_number AS id, min_by(source, rank) AS kind FROM k GROUP BY ALL) SELECT * FROM c UNION ALL SELECT DISTINCT qid, 'question', 'question' FROM k")
def presentation_star_nodes(spark, sf):
    return presentation.star(retrieval.dedupe_and_cap(_found(spark, sf), 12))["nodes"]


@query(f"WITH {FOUND} SELECT qid, rank, printf('[%-9s] score=%.3f  %s  (%s)', source, score, node_id, 'crumb of ' || node_id) AS line FROM k")
def context_source_lines(spark, sf):
    found = retrieval.dedupe_and_cap(_found(spark, sf), 12).withColumn("breadcrumb", F.concat(F.lit("crumb of "), F.col("node_id")))
    return found.select("qid", "rank", context.source_line().alias("line"))


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> ''))::INT AS n FROM documents WHERE text IS NOT NULL")
def presentation_words(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.size(presentation.answer_words(F.col("text"))).alias("n"))


# -- checks ------------------------------------------------------------------------------------------------------


@query("SELECT number FROM (SELECT unnest(range(1, (SELECT max(l_suppkey * 3) FROM lineitem) + 1)) AS number) WHERE number NOT IN (SELECT l_suppkey * 3 FROM lineitem)")
def quality_gaps(spark, sf):
    return quality.gaps(table(spark, sf, "lineitem").select((F.col("l_suppkey") * 3).alias("n")), "n")


@query("SELECT l_orderkey, l_linenumber, l_suppkey * 31 AS p_partkey FROM lineitem WHERE l_suppkey * 31 NOT IN (SELECT p_partkey FROM part)")
def quality_dangling(spark, sf):
    return quality.dangling(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") * 31).alias("p_partkey")), table(spark, sf, "part"), "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey")


@query(
    "WITH s AS (SELECT list_sort(list(n_chars)) AS l, count(*) AS n FROM documents WHERE n_chars IS NOT NULL) SELECT n, floor((l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2)::INT AS p50, l[floor(n * 0.9)::BIGINT + 1] AS p90, l[floor(n * 0.99)::BIGINT + 1] AS p99, l[n] AS max FROM s"
)
def quality_percentiles(spark, sf):
    return quality.at_index(table(spark, sf, "documents"), "n_chars", (0.9, 0.99))


@query(
    "WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS lo, o_custkey FROM orders), b AS (SELECT *, coalesce(last_value(lo + 1 IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) "
    "SELECT o_orderkey, before::INT AS before FROM b WHERE lo IS NOT NULL AND lo < before - 1"
)
def quality_page_order(spark, sf):
    lo = (F.col("o_orderkey") % 7).cast("int")
    pages = F.when(F.col("o_orderkey") % 5 > 0, F.array(lo, lo + 1)).otherwise(F.array().cast("array<int>"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("law_id"), F.col("o_orderkey").alias("article_number"), F.col("o_orderkey").alias("chunk_order"), pages.alias("source_pages"))
    return quality.page_violations(rows).select("o_orderkey", "before")


# -- sessions ----------------------------------------------------------------------------------------------------

#: Users are sessions and an error clears; a day without an event is a silence.
TOLD = (
    "e AS (SELECT user_id AS session, epoch_us(ts) AS us, event_id AS seq, event_type = 'error' AS clear FROM events), "
    "o AS (SELECT *, us - lag(us) OVER w > 86400000000 OR lag(clear) OVER w AS opens FROM e WINDOW w AS (PARTITION BY session ORDER BY us, seq)), "
    "h AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY session ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS history FROM o), "
    "n AS (SELECT session, seq, us, row_number() OVER t AS turn, first_value(us) OVER t AS began, first_value(seq) OVER t AS began_seq FROM h WHERE NOT clear WINDOW t AS (PARTITION BY session, history ORDER BY us, seq)), "
    "told AS (SELECT session, seq, us, began, began_seq, turn FROM n UNION ALL SELECT session, seq, us, NULL, NULL, 0 FROM h WHERE clear)"
)


def _told(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", history.CLEAR).otherwise(F.col("event_type")).alias("kind")
    events = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind)
    return history.replay(events, 86_400)


@query(f"WITH {TOLD} SELECT session, seq, began, began_seq, turn::BIGINT AS turn FROM told")
def session_turns(spark, sf):
    told = _told(spark, sf)
    return told.select("session", "seq", history.micros(told, "began_at").alias("began"), "began_seq", "turn")


@query(
    f"WITH {TOLD} SELECT session, count(*) AS events, arg_max(turn, (us, seq))::BIGINT AS turns, "
    "CASE WHEN arg_max(turn, (us, seq)) > 0 THEN max(began_seq) FILTER (turn > 0 AND began_seq IS NOT NULL) END AS began_seq FROM told GROUP BY session"
)
def session_shown(spark, sf):
    return history.shown(_told(spark, sf)).select("session", "events", "turns", "began_seq")

"""From pages to a graph, on a small statute of our own with the quirks that matter."""

import glob
import os
import random
import re
import threading
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill import session
from lexmill.config import CorpusConfig
from lexmill.functions import spans
from lexmill.functions import text as T
from lexmill.operators import annotate, chunking, graph, quality, retrieval, scan, structure, vector, vector_index
from lexmill.plans import delta
from lexmill.plans.answer import answer_batch, answer_timed, retrieve
from lexmill.plans.index import chunk_pages, stage_chunk, stage_embed, stage_load
from lexmill.providers import Paced, RateLimited, answering, embed_stored, with_retries
from lexmill.queries import QUERIES
from lexmill.sources import files

CONFIG = CorpusConfig("XX-LAW-1", "قانون", "2020-01-01", "1", per_document=False)
EACH = CorpusConfig("XX-LAW-1", "قانون", "2020-01-01", "1")
LONG = "تمهيد " + "نص " * 520
TEXT = [
    "الكتاب الأول أحكام عامة الباب الأول تعريفات مادة (1): يقصد بالآتي 1- العامل: كل شخص يعمل. 2- الأجر: ما يعطى، - المتدرج: من يتعلم 4- صاحب العمل: كل من يستخدم.",
    f"مادة (٢): يسري هذا على العامل وفق المادة (3) من هذا القانون. مادة (3): {LONG} ١- أول البنود ٢- ثاني البنود الباب الثاني العمل الفصل الأول الأجور مادة (): وفقا للمادة 2 والمواد (1، 2 3) من قانون العمل رقم 12 لسنة 2003 والعامل.",
    "مادة (9): نص بعيد. مادة (99): الأجر والكتاب. الكتاب الثاني خاتمة مادة (2): عودة",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(7, i, t, t) for i, t in enumerate(TEXT, 1)]
    return spark.createDataFrame(rows, "doc_id long, page_num int, raw_text string, cleaned_text string")


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    assert values(spark, T.page_int, ["٤١", "۴۱", "٤1", "", "x", " 5 ", None]) == [14, 41, 41, None, None, 5, None]
    assert values(spark, T.typed_int, ["٤١", "۴۱", " 7 ", "x", ""]) == [41, 41, 7, None, None]


def test_estimates_and_stems(spark):
    assert values(spark, T.estimate_tokens, ["", "x" * 17, "x" * 19]) == [1, 5, 6]
    assert values(spark, T.stem, ["العاملين", "والعمل", "به", "ال", "عمل", "كتابها"]) == ["عامل", "العمل", "به", "ال", "عمل", "تاب"]


def test_normal_forms(spark):
    assert values(spark, T.for_display, ["ﻻ  شيـء ١"]) == ["لا شيء ١"]
    assert values(spark, T.for_index, ["ﻻ  شَيـء ١۲\n"]) == ["لا شيء 12"]
    assert values(spark, T.strip_page_artifacts, ["أ\n 12 \nب"])[0].replace("\n", "") == "أب"
    assert values(spark, T.breadcrumb_of, ["a\n\nb", "ab", "a\n\nb\n\nc"]) == ["a", "", "a"]


def test_variants_and_slugs(spark):
    assert values(spark, T.term_variants, ["الأجر", "أجر"]) == [sorted(["الأجر", "أجر", "للأجر", "بالأجر", "والأجر", "فالأجر", "كالأجر"]), ["أجر"]]
    df = spark.createDataFrame([("a b", None), ("a", 7), ("a", 1234)], "t string, n int")
    assert [r[0] for r in df.select(T.slug(F.col("t"), F.col("n"))).collect()] == ["a-b", "007", "1234"]


def test_page_offsets_rebuild_the_text(spark, pages):
    text = spans.concatenate(pages).first().text
    assert text == " ".join(TEXT)
    for r in spans.page_offsets(pages).collect():
        assert text[r.ps : r.pe] == TEXT[r.page_num - 1]
    spanned = spans.spanned_pages(spark.createDataFrame([(7, 1, 0, 5), (7, 2, 5, 10_000), (7, 3, len(TEXT[0]), len(TEXT[0]) + 1)], "doc_id long, k int, char_start int, char_end int"), spans.page_offsets(pages), ["k"])
    assert {r.k: r.source_pages for r in spanned.collect()} == {1: [1], 2: [1, 2, 3]}


def test_spans_reach_the_end_of_each_document(spark, tmp_path):
    turns = [(1, t, "user", "x" * (t % 700)) for t in range(60)] + [(2, 0, "user", "y" * 20_000), (2, 1, "user", None), (2, 2, "user", ""), (3, 0, "user", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    at, want = {}, {}
    for c, t, _, text in turns:
        ps = at.get(c, 0)
        at[c] = (pe := ps + len(text or "")) + 1
        for k in range(pe // 100 + 1):
            if pe > k * 100 and ps < k * 100 + 150:
                want.setdefault((c, k), []).append(str(t))
    got = {(r.doc_id, r.k): r.source_pages for r in QUERIES["pages_of_all_spans"](spark, str(tmp_path)).collect()}
    assert got == {key: ",".join(v) for key, v in want.items()} and max(k for _, k in got) == 200


def test_renumbering(spark):
    df = spark.createDataFrame([([1, None, 5, 99, 2],)], "n array<int>")
    assert df.select(structure.renumber(F.col("n"))).first()[0] == [1, 2, 5, 6, 2]


def test_ordinals(spark):
    got = values(spark, structure.ordinal, ["الثاني عشر", "الحادي عشر", "الأولى ثم", "العمل"])
    assert [g.number for g in got] == [2, 11, 1, None]
    assert got[0].length == len("الثاني")


def test_articles(spark, pages):
    rows = structure.parse(spans.concatenate(pages)).orderBy("char_start").collect()
    assert [r.article_number for r in rows] == [1, 2, 3, 4, 5, 6, 2]
    assert [(r.book_number, r.part_number, r.chapter_number) for r in rows] == [(1, 1, None), (1, 1, None), (1, 1, None), (1, 2, 1), (1, 2, 1), (1, 2, 1), (2, None, None)]
    assert rows[0].book_title == "أحكام عامة" and rows[0].part_title == "تعريفات" and rows[3].chapter_title == "الأجور"
    assert rows[6].book_title == "خاتمة" and rows[6].body_text == "عودة"
    text = " ".join(TEXT)
    assert all(text[r.char_start : r.char_end].startswith("مادة") for r in rows)
    assert rows[1].body_text == "يسري هذا على العامل وفق المادة (3) من هذا القانون"


def test_definitions_fill_gaps(spark):
    df = spark.createDataFrame([(1, "تمهيد 10- الأول: أ، ب. - الثاني: ج 12- الثالث: د")], "doc_id long, body_text string")
    rows = chunking.definitions(df).orderBy("idx").collect()
    assert [(r.number, r.term, r.definition) for r in rows] == [(10, "الأول", "أ، ب"), (11, "الثاني", "ج"), (12, "الثالث", "د")]


def test_segments(spark):
    got = values(spark, chunking.segments, ["مقدمة 1- أ 2- ب", "1- أ", "بلا", "1- أ 2- ب"])
    assert got == [["مقدمة\n\n1- أ", "مقدمة\n\n2- ب"], ["1- أ"], ["بلا"], ["1- أ", "2- ب"]]


def test_chunks(spark, pages):
    chunks, terms, _ = chunk_pages(pages, CONFIG)
    rows = chunks.orderBy("chunk_order").collect()
    kinds = [(r.node_id, r.node_type) for r in rows]
    assert kinds[:5] == [("xx-law-1-art001", "Article"), ("xx-law-1-def-001", "Definition"), ("xx-law-1-def-002", "Definition"), ("xx-law-1-def-003", "Definition"), ("xx-law-1-def-004", "Definition")]
    assert ("xx-law-1-art003-seg02", "ArticleSegment") in kinds
    assert {r.term: r.node_id for r in terms.collect()} == {"العامل": "xx-law-1-def-001", "الأجر": "xx-law-1-def-002", "المتدرج": "xx-law-1-def-003", "صاحب العمل": "xx-law-1-def-004"}
    by_id = {r.node_id: r for r in rows}
    assert by_id["xx-law-1-art001"].text.startswith("الكتاب 1: أحكام عامة ← الباب 1: تعريفات ← المادة (1)\n\n")
    assert by_id["xx-law-1-art003-seg02"].text.split("\n\n")[0].endswith(" → جزء 2/2")
    assert by_id["xx-law-1-art004"].cross_refs == [2]  # what is joined to "and" is no reference
    assert by_id["xx-law-1-art004"].external_refs == ["قانون العمل رقم 12 لسنة 2003"]
    assert by_id["xx-law-1-art004"].defined_terms_used == ["العامل"]
    assert by_id["xx-law-1-def-001"].defined_terms_used == []
    assert "صاحب العمل" not in [t for r in rows for t in r.defined_terms_used]
    assert by_id["xx-law-1-art001"].char_count == len(by_id["xx-law-1-art001"].text)


def test_references(spark):
    df = spark.createDataFrame([("والمادة 5", 1), ("للمادة 7", 1), ("المـواد (١، ٢٠ 3) والمادة 9", 3)], "t string, own int")
    got = [r[0] for r in df.select(annotate.cross_refs(F.col("t"), F.lit(50), F.col("own"))).collect()]
    assert got == [[], [7], [1, 2]]


def test_stages_graph_and_answers(spark, pages, tmp_path):
    path = str(tmp_path / "index")
    counts = stage_chunk(pages, path, CONFIG).first()
    assert (counts.pages, counts.articles, counts.definitions) == (3, 7, 4)
    with pytest.raises(Exception):
        stage_load(spark, path, CONFIG)
    stage_embed(spark, path)
    tables = stage_load(spark, path, CONFIG)
    edges = {(r.src, r.dst, r.type) for r in tables["edges"].collect()}
    assert ("xx-law-1-art003", "xx-law-1-art003-seg01", "HAS_SEGMENT") in edges
    assert ("xx-law-1-art002", "xx-law-1-art003", "REFERENCES") in edges
    assert ("xx-law-1-art004", "xx-law-1-def-001", "USES_TERM") in edges
    assert ("xx-law-1-art001", "xx-law-1-art002", "NEXT") in edges
    assert tables["Article"].count() == 6  # the number 2 came twice, the last one stays
    assert tables["Article"].filter("node_id = 'xx-law-1-art002'").first().book_number if "book_number" in tables["Article"].columns else True
    assert not [e for e in edges if e[1] == "xx-law-1-art002" and e[2] == "HAS_ARTICLE" and e[0].startswith("book")]
    questions = spark.createDataFrame([(1, "ما تنص عليه المادة 4؟", None, None), (2, "العامل", "x", 1)], "qid long, question string, mode string, primary_k int")
    asked, found = retrieve(questions, tables)
    rows = [r for r in found.orderBy("qid", "rank").collect() if r.qid == 1]
    assert rows[0].source == "explicit" and rows[0].article_number == 4 and rows[0].score == 1.0
    assert len(rows) == len({r.node_id for r in rows}) <= 12
    answers = {r.qid: r for r in answer_batch(questions, tables).collect()}
    assert answers[1].detected_refs == [4] and answers[1].answer == rows[0].text
    assert answers[1].sources[0].excerpt == rows[0].text[:300]
    report = {r["check"]: r for r in quality.validate(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/glossary")).collect()}
    lines, status = quality.verdict(quality.validate(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/glossary")))
    assert status == 1 and "FAIL article gaps (1)" in lines and "PASS glossary consistency (0)" in lines and len(lines) == 7
    assert quality.verdict(spark.createDataFrame([("a", True, 0)], "check string, ok boolean, n long")) == (["PASS a (0)"], 0)
    assert not report["article gaps"].ok and report["article gaps"].n == 1 and report["glossary consistency"].ok


def test_a_book_alone_holds_no_article(spark):
    rows = [("a", "Article", "L", 1, None, None, 1), ("b", "Article", "L", 1, 2, None, 2), ("c", "Article", "L", 1, 2, 3, 3)]
    df = spark.createDataFrame(rows, "node_id string, node_type string, law_id string, book_number int, part_number int, chapter_number int, article_number int")
    got = {(r.src, r.dst) for r in graph.hierarchy_edges(df).filter("type = 'HAS_ARTICLE'").collect()}
    assert got == {("part:L/1/2/", "b"), ("chapter:L/1/2/3/", "c")}


def test_bodies_of_one_document_stand_alone(spark):
    alone = [(1, 0, "1- الأول: أ 2- الثاني: ب")]
    both = [*alone, (1, 500, "7- السابع: ج - الثامن: د 9- التاسع: ه")]
    schema = "doc_id long, char_start int, body_text string"
    got = chunking.definitions(spark.createDataFrame(both, schema)).orderBy("char_start", "idx").collect()
    assert [(r.char_start, r.number, r.term) for r in got] == [(0, 1, "الأول"), (0, 2, "الثاني"), (500, 7, "السابع"), (500, 8, "الثامن"), (500, 9, "التاسع")]
    first = chunking.definitions(spark.createDataFrame(alone, schema)).orderBy("idx").collect()
    assert [(r.number, r.term, r.definition) for r in first] == [(r.number, r.term, r.definition) for r in got[:2]]
    offsets = spans.scan(spark.createDataFrame([(1, 0, "ab ab"), (1, 9, "x ab")], "doc_id long, char_start int, text string"), "ab").orderBy("char_start", "pos")
    assert [(r.char_start, r.start) for r in offsets.collect()] == [(0, 0), (0, 3), (9, 2)]


def test_terms_of_a_long_body_stay_in_order(spark):
    body = " ".join(f"{i % 90 + 1}- حد{chr(0x621 + i % 20)}: نص." for i in range(1500))
    rows = spark.createDataFrame([(1, 1, body, 0), (1, 2, "نص", 1)], "doc_id long, article_number int, body_text string, char_start int")
    rows = rows.withColumn("char_end", F.col("char_start") + F.length("body_text"))
    for level in ("book", "part", "chapter"):
        rows = rows.withColumn(f"{level}_number", F.lit(None).cast("int")).withColumn(f"{level}_title", F.lit(""))
    pages = spark.createDataFrame([(1, 1, "x")], "doc_id long, page_num int, cleaned_text string")
    chunks = chunking.build_chunks(rows, spans.page_offsets(pages), CONFIG).orderBy("chunk_order").collect()
    assert chunks[-1].article_number == 2 and [c.node_type for c in chunks[1:-1]] == ["Definition"] * 1500
    assert len({c.chunk_order for c in chunks}) == len(chunks)


def test_several_laws_keep_their_articles_terms_and_references(spark):
    texts = {1: "مادة (1): 1- العامل: كل شخص. مادة (2): العامل وفق المادة (3)", 2: "مادة (1): 1- الأجر: مال. مادة (2): العامل والأجر وفق المادة (1) والمادة 3"}
    pages = spark.createDataFrame([(d, 1, t) for d, t in texts.items()], "doc_id long, page_num int, cleaned_text string")
    chunks, terms, _ = chunk_pages(pages, EACH)
    rows = {r.node_id: r for r in chunks.collect()}
    alone, _, _ = chunk_pages(pages.filter("doc_id = 1"), EACH)  # a document has the same ids in every load
    assert {r.node_id for r in alone.collect()} == {k for k, r in rows.items() if r.doc_id == 1}
    assert len(rows) == chunks.count() == 6 and {r.law_id for r in rows.values()} == {"XX-LAW-1-1", "XX-LAW-1-2"}
    assert rows["xx-law-1-1-art002"].cross_refs == [] and rows["xx-law-1-2-art002"].cross_refs == [1]
    assert rows["xx-law-1-1-art002"].defined_terms_used == ["العامل"] and rows["xx-law-1-2-art002"].defined_terms_used == ["الأجر"]
    assert {(r.law_id, r.term) for r in terms.collect()} == {("XX-LAW-1-1", "العامل"), ("XX-LAW-1-2", "الأجر")}
    tables = graph.build_graph(chunks, EACH)
    assert tables["Article"].count() == 4 and tables["Law"].count() == 2
    named, _, _ = chunk_pages(pages.withColumn("law_id", F.concat(F.lit("L"), "doc_id")), EACH)
    assert {r.law_id for r in named.select("law_id").distinct().collect()} == {"L1", "L2"}


def test_an_infinite_vector_takes_no_neighbours_along(spark):
    rows = [(i, "a", [1.0, i / 10]) for i in range(5)] + [(9, "a", [float("inf"), 1.0]), (10, "a", [float("nan"), 1.0]), (11, "a", None)]
    nodes = spark.createDataFrame(rows, "node_id long, label string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 0.0])], "qid long, embedding array<double>")
    for k in (1, 2, 5, 7):
        assert [r.node_id for r in vector.topk(asked, nodes, k).orderBy("rank").collect()] == list(range(5))[:k]


def test_answers_know_their_prompts_limits_errors_and_times(spark, pages, tmp_path):
    path = str(tmp_path / "index")
    stage_chunk(pages, path, CONFIG)
    stage_embed(spark, path)
    tables = stage_load(spark, path, CONFIG)
    questions = spark.createDataFrame([(1, "ما تنص عليه المادة 4؟", "lawyer", None), (2, "العامل", None, None)], "qid long, question string, mode string, primary_k int")

    def call(prompt, system, limit):
        if prompt.startswith("السؤال: العامل"):
            raise ValueError("refused")
        return f"{system[:7]} {limit}"

    rows = {r.qid: r for r in answer_timed(questions, tables, answer=answering(call, 2, 0.0)).collect()}
    assert (rows[1].answer, rows[1].error) == ("Analyse 4096", None)
    assert (rows[2].answer, rows[2].error) == ("", "ValueError: refused")
    assert set(rows[1].elapsed_ms) == {"route", "embed", "retrieve", "generate"} and min(rows[1].elapsed_ms.values()) >= 1
    assert rows[1].log_line.startswith(f"question={rows[1].question} refs=[4] chunks={len(rows[1].sources)} route_ms=") and " generate_ms=" in rows[1].log_line
    waits = []
    with pytest.raises(RuntimeError):
        with_retries(lambda: (_ for _ in ()).throw(RateLimited()), sleep=waits.append)
    assert waits == [2.0, 4.0, 8.0, 16.0, 32.0]


def test_sources_go_round(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Article", 1), ("b", None, None)], "node_id string, node_type string, article_number int")
    files.write_jsonl(rows, str(tmp_path / "rows"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "rows"), "node_id string, node_type string, article_number int").collect()) == sorted(rows.collect())
    (tmp_path / "g.json").write_text('{\n "a b": "x-1",\n "c": "x-2"\n}', encoding="utf-8")
    assert {(r.term, r.node_id) for r in files.read_glossary(spark, str(tmp_path / "g.json")).collect()} == {("a b", "x-1"), ("c", "x-2")}
    (tmp_path / "law.txt").write_text("first\fsecond", encoding="utf-8")
    assert [(r.page_num, r.raw_text) for r in files.read_pages(spark, str(tmp_path / "law.txt")).orderBy("page_num").collect()] == [(1, "first"), (2, "second")]
    files.write_tables({"t": rows}, str(tmp_path / "tables"))
    assert files.read_tables(spark, str(tmp_path / "tables"), ["t"])["t"].count() == 2


def test_gaps_of_large_numbers(spark):
    got = quality.gaps(spark.createDataFrame([(1,), (200_000,), (None,)], "n long"), "n")
    assert got.count() == 199_998 and got.filter("number IN (1, 200000)").count() == 0
    assert quality.gaps(spark.createDataFrame([(0,), (-3,)], "n long"), "n").count() == 0


def test_numbers_without_patterns(spark):
    inputs = ["٤١", "۴۱", "٤1", "", "5", "٥", "१२", None]
    assert values(spark, T.digits_int, inputs) == values(spark, T.page_int, inputs)


def test_ties_fall_the_same_way_however_rows_are_dealt(spark):
    kinds = [("Article", 0.2), ("Definition", 0.2), ("Article", 0.5), (None, None)]
    rows = [(q, "n1", kinds[(i * 7 + q) % 4][0], i % 3, "b", f"t{i % 5}", kinds[(i * 7 + q) % 4][1], "primary", 1) for q in range(3) for i in range(40)]
    rows += [(q, None, "Article", 1, "b", "x", 0.1, s, 2) for q in range(3) for s in ("primary", "explicit", None)]
    schema = "qid long, node_id string, node_type string, article_number int, breadcrumb string, text string, score double, source string, pos int"
    found = spark.createDataFrame(rows, schema)
    seen = {str(sorted(map(str, retrieval.dedupe_and_cap(found.repartition(n, F.rand(n)), 12).collect()))) for n in (1, 3, 8, 40)}
    assert len(seen) == 1
    first = retrieval.dedupe_and_cap(found, 12).filter("node_id = 'n1' AND qid = 0").collect()
    assert [(r.node_type, r.score) for r in first] == [("Article", 0.5)]


def test_scratch_blocks_of_two_threads_leave_each_other_alone(spark):
    opened, written = threading.Event(), threading.Event()
    got: list = []

    def other():
        opened.wait()
        got.append(session.cut(spark.range(7)))
        written.set()

    worker = threading.Thread(target=other)
    worker.start()
    with session.scratch(spark) as keep:
        mine = session.cut(spark.range(3))
        kept = keep(session.cut(spark.range(4)))
        opened.set()
        written.wait()
    worker.join()
    assert got[0].count() == 7 and kept.count() == 4
    with pytest.raises(Exception):
        mine.count()


def test_adaptive_execution_is_set_back_by_threads(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    workers = [threading.Thread(target=lambda: session.cut(spark.range(50).repartition(4, "id"), placed=True)) for _ in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def clustered(spark, n, dim, centres, seed=5):
    import numpy as np

    r = np.random.default_rng(seed)
    at = r.standard_normal((centres, dim))
    x = at[r.integers(0, centres, n)] + 0.35 * r.standard_normal((n, dim))
    rows = [(i, ("a", "b", None)[i % 3], v) for i, v in enumerate(x.astype("float32").tolist())]
    return spark.createDataFrame(rows, "node_id long, label string, embedding array<float>")


def ranks(df):
    return sorted((r.qid, r.label or "", r["rank"], r.node_id, round(r.score, 9)) for r in df.collect())


def test_a_stored_index_with_all_lists_is_the_exact_search(spark, tmp_path):
    path = str(tmp_path / "index")
    nodes = clustered(spark, 1500, 12, 20)
    odd = spark.createDataFrame([(9000, "a", [0.0] * 12), (9001, "a", None), (9002, "a", [1.0] * 5), (9003, "new", [1.0, 2.0, 3.0] * 4), (3, "a", [0.5] * 12)], nodes.schema)
    every = nodes.union(odd)
    asked = nodes.filter("node_id % 50 = 0").select(F.col("node_id").alias("qid"), "embedding", F.when(F.col("node_id") % 100 == 0, 4).otherwise(700).alias("k"))
    asked = asked.union(spark.createDataFrame([(-1, [1.0] * 5, 3), (-2, None, 3), (-3, [1.0] * 12, 0)], asked.schema))
    vector_index.build(nodes.filter("node_id < 1000"), path, lists=16, parts=4, codewords=32)
    vector_index.add(nodes.filter("node_id >= 1000").union(odd), path, parts=4, codewords=32)
    want = ranks(vector.topk(asked, every, F.col("k")))
    assert ranks(vector_index.search(asked, path, F.col("k"), None, None)) == want and len(want) > 20_000
    some = vector_index.search(asked, path, F.col("k"), 1, 2)
    assert {r[:2] for r in ranks(some)} <= {r[:2] for r in want}
    vector_index.build(nodes.limit(0), str(tmp_path / "none"))
    assert vector_index.search(asked, str(tmp_path / "none"), 3).count() == 0


def test_recall_of_a_stored_index_and_the_lists_it_reads(spark, tmp_path):
    path = str(tmp_path / "index")
    nodes = clustered(spark, 50_000, 32, 400).withColumn("label", F.lit("a"))
    asked = nodes.filter("node_id % 500 = 0").select(F.col("node_id").alias("qid"), "embedding")
    vector_index.build(nodes, path, lists=200)
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/vectors").groupBy("list").count().collect()]
    assert len(sizes) >= 190 and max(sizes) <= 3 * 50_000 / len(sizes)
    exact = {(r.qid, r.node_id) for r in vector.topk(asked, nodes, 10).collect()}
    found = {(r.qid, r.node_id) for r in vector_index.search(asked, path, 10, probe=16).collect()}
    assert len(exact & found) >= 0.9 * len(exact)  # of each query under a tenth of the lists is read
    one = vector_index.search(asked.filter("qid = 0"), path, 10, probe=16)
    plan = one._jdf.queryExecution().explainString(one.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [(space" in plan.replace("isnotnull(space", "(space") or "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:200]


def test_headers_are_tried_at_letters_that_begin_one(spark):
    flagged = f"(?U){structure.NOT_INSIDE}(?:{structure.ARTICLE.removeprefix('(?U)')}|({'|'.join(structure.LEVELS.values())})\\s+({'|'.join(p for _, p in structure.ORDINALS)}))"
    assert structure.HEADER.startswith("(?=[ما])") and "(?U)" not in structure.HEADER
    inputs = [*TEXT, "الكتاب\u00a0الأولى الكتاب الأولX الباب الثانيَ و مادة (1): بمادة (2). م ا د ة\u2003)٣( الفصل الثان ي", ""]
    marked = lambda p: values(spark, lambda x: F.regexp_replace(x, p, "|$1|$2|$3|$0|"), inputs)
    assert marked(structure.HEADER) == marked(flagged) != inputs


def test_runs_of_digits_of_all_matches_at_once(spark):
    inputs = ["المادة 12 المواد (3، ٤١ ۱۲) x7", "", None, "٤1 99999999999 ٣"]
    assert values(spark, T.digits_ints, inputs) == [[12, 3, 14, 12, 7], [], None, [41, None, 3]]
    lines = QUERIES["annotate_references"](spark, "/root/testdata/sf0.1")
    assert "RebalancePartitions" in lines._jdf.queryExecution().toString()  # the rows of one row group are dealt over the cores


def test_a_hop_over_more_partitions_finds_the_same(spark):
    from lexmill.session import parts_for

    seeds = spark.range(60).select((F.col("id") % 7).alias("qid"), (F.col("id") % 11).alias("node_id"), (F.col("id") % 4).cast("int").alias("per")).distinct()
    edges = spark.range(3000).select((F.col("id") % 13).alias("src"), (F.col("id") * 7919 % F.when(F.col("id") % 13 == 3, 250).otherwise(6)).alias("dst"), F.lit("R").alias("type"))
    assert parts_for(seeds, edges) is None and parts_for(edges, edges, rows=700) == 9
    rows = lambda df: sorted(map(tuple, df.collect()))
    for cap in (100, 20, None):
        got = rows(retrieval.hop(seeds, edges, F.col("per"), cap, parts=9))
        assert got == rows(retrieval.hop(seeds, edges, F.col("per"), cap)) and got
    nodes = edges.select(F.col("dst").alias("node_id")).distinct().select("node_id", F.lit("Article").alias("node_type"), F.lit(1).alias("article_number"), F.lit("a").alias("text"))
    ask = lambda **how: retrieval.expand(seeds, edges, nodes, "R", F.col("per"), "cross_ref", **how)
    assert rows(ask(parts=9)) == rows(ask())
    # each row of the hop lies in one of so many partitions, whatever the session's number
    assert retrieval.hop(seeds, edges, 3, parts=9).rdd.getNumPartitions() == 9


def test_queries_meet_a_whole_index_in_blocks(spark, tmp_path):
    path, nodes = str(tmp_path / "index"), clustered(spark, 600, 8, 9)
    asked = nodes.filter("node_id % 20 = 0").select(F.col("node_id").alias("qid"), "embedding")
    vector_index.build(nodes, path, lists=8, parts=2, codewords=16)
    spaces = vector_index.load(spark, path)[1]
    blocks = vector_index.probes(asked, spaces, 3, None)
    assert blocks.count() <= len(spaces) * asked.hint("rebalance").rdd.getNumPartitions()  # not a row for each query and list
    assert ranks(vector_index.search(asked, path, 3, None, None)) == ranks(vector.topk(asked, nodes, 3))
    # copies lie in blocks of different places and size, and still tie
    copies = nodes.filter("node_id < 5").crossJoin(spark.range(300)).select((F.col("node_id") + 1000 * F.col("id") + 1000).alias("node_id"), "label", "embedding")
    vector_index.add(copies.repartition(7), path)
    assert ranks(vector_index.search(asked, path, 7, None, None)) == ranks(vector.topk(asked, nodes.union(copies), 7))


def test_training_holds_distances_of_a_block_only():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40_000, 4))
    tracemalloc.start()
    space = vector_index.train(x, "a", 200, 2, 16, 0.1, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert space.centres.shape == (200, 4) and space.weights.min() == 0 and peak < 8 * 40_000 * 200  # a matrix of all distances


def test_no_key_of_the_exact_search_is_constant(spark):
    nodes = clustered(spark, 4000, 8, 9).repartition(12)
    asked = nodes.filter("node_id % 40 = 0").select(F.col("node_id").alias("qid"), "embedding")
    got = vector.topk(asked, nodes, 3)
    assert got.count() == 100 * 3 * 3
    slots = vector._blocks(nodes.select(F.col("node_id").alias("id"), F.lit(8).alias("dim"), "label", F.col("embedding").cast("array<double>").alias("v")), "bigint", vector.ARROW["bigint"], 128)
    assert slots.select(F.pmod(F.xxhash64("block", "label"), F.lit(8))).distinct().count() == 8


def statute_text(seed, n, gap=40):
    """A law with headers of all kinds, numbers that jump, are missing or come again, words that only look like headers."""
    r = random.Random(seed)
    eastern = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    names = ["الأول", "الثاني", "الثالث", "الحادي عشر", "غير"]
    out = ["ديباجة"]
    for i in range(n):
        if r.random() < 0.2:
            out.append(f"{r.choice(list(structure.LEVELS.values()))} {r.choice(names)} {'عنوان ' * r.randrange(4)}")
        read = r.choice([str(i + 1), str(i + 1), "", str(r.randrange(1, n + 9)), "0", str(i + 3)])
        out.append(f"مادة ({read if r.random() < 0.5 else read[::-1].translate(eastern)}) {'نص' * r.randrange(gap)} ومادة (1) {r.choice(['', 'كلمة ' * r.randrange(gap)])}")
    return " ".join(out)


def by_fold(text):
    """The articles of a text by one loop over its headers."""
    word = r"(?<![اوفبلكم])"
    head = re.compile(word + r"(?:(?P<a>م\s?ا\s?د\s?ة\s*[()]\s*([\d٠-٩]*)\s*[():.،])|(?P<l>الكتاب|الباب|الفصل)\s+(?P<o>الأول|الثاني|الثالث|الحادي\s*عشر)\b)")
    number = {"الأول": 1, "الثاني": 2, "الثالث": 3, "الحادي عشر": 11}
    found = list(head.finditer(text))
    expected, places, out = 1, [(None, ""), (None, ""), (None, "")], []
    for m, until in zip(found, [*(m.start() for m in found[1:]), len(text)], strict=False):
        body = text[m.end() : until].strip(" :-–،.()")
        if m["l"]:
            i = list(structure.LEVELS.values()).index(m["l"])
            places = places[:i] + [(number[m["o"]], body.split("مادة")[0].strip()[:100])] + [(None, "")] * (2 - i)
            continue
        token = m[2][::-1] if len(m[2]) > 1 and m[2][0] in "٠١٢٣٤٥٦٧٨٩" else m[2]
        read = int(token) if token else None
        expected = (read if read is not None and 1 <= read <= expected + 3 else expected) + 1
        out.append((expected - 1, body, *(x for p in places for x in p), m.start(), until))
    return out


def in_pages(spark, texts, size):
    """Texts as pages cut at their blanks, so that the pages joined by one give the text again."""
    rows = []
    for d, text in texts.items():
        words, page, n = text.split(" "), [], 1
        for w in words:
            page.append(w)
            if sum(map(len, page)) >= size:
                rows.append((d, n, " ".join(page)))
                page, n = [], n + 1
        rows.append((d, n, " ".join(page)))
    return spark.createDataFrame(rows, "doc_id long, page_num int, cleaned_text string").repartition(3)


def test_articles_of_a_document_in_many_ranges_and_partitions(spark, monkeypatch):
    texts = {d: statute_text(d, n) for d, n in ((1, 150), (2, 2), (3, 60), (4, 0))} | {5: "", 6: "مادة (1) " + "طويل " * 900 + "مادة (2) آخر"}
    want = sorted(((d, *a) for d, t in texts.items() for a in by_fold(t)), key=repr)
    for size, width, behind, parts in ((50, 1 << 16, 1 << 10, None), (300, 700, 300, 9), (7, 400, 200, 23), (10_000, 333, 250, 60)):
        monkeypatch.setattr(structure, "RANGE", width)
        monkeypatch.setattr(structure, "BEHIND", behind)
        got = structure.parse_pages(in_pages(spark, texts, size), parts=parts)
        rows = ((r.doc_id, r.article_number, r.body_text, r.book_number, r.book_title, r.part_number, r.part_title, r.chapter_number, r.chapter_title, r.char_start, r.char_end) for r in got.collect())
        assert sorted(rows, key=repr) == want


def test_scans_of_one_key_run_in_many_tasks(spark):
    r = random.Random(8)
    kinds = [("article", None), ("article", 1), ("book", 2), ("part", 3), ("chapter", 4), (None, None)]
    rows = []
    for i in range(4000):
        level, number = r.choice(kinds)
        number = r.choice([None, i // 6, r.randrange(1, 900), 5]) if level == "article" else number
        rows.append((None if i < 90 else 7 if i < 3900 else i // 20, i, level, number, f"t{i}" if level not in (None, "article") else None, i, i + 2))
    df = spark.createDataFrame(rows, "doc_id long, at int, level string, number int, title string, start long, end long").repartition(5)
    machine, want, now, state = structure.Places(), [], "none", None
    for k, at, *row in rows:
        if k != now:
            now, state = k, machine.start()
        state, made = machine.step(state, tuple(row))
        want.append((at, *made))
    for parts in (1, 16, 50):
        out = scan.segmented(df, "doc_id", ["at"], machine, parts)
        got = sorted(tuple(r)[1:2] + tuple(r)[7:] for r in out.collect())
        assert got == want
        assert parts == 1 or out.filter("doc_id = 7").select(F.spark_partition_id()).distinct().count() >= parts * 0.8


@given(st.lists(st.one_of(st.none(), st.integers(-1, 14)), max_size=30))
@settings(max_examples=300, deadline=None)
def test_renumbering_as_a_function_of_what_is_expected(reads):
    numbers = structure.Renumbering()
    for read in reads:
        numbers.push(read)
    for first in range(1, 30):
        expected = first
        for read in reads:
            expected = (read if read is not None and 1 <= read <= expected + structure.NEAR else expected) + 1
        assert structure.expected_after(numbers.function(), first) == expected


def test_page_violations_across_stretches(spark):
    r = random.Random(2)
    rows = [("L", n, n, [] if r.random() < 0.4 else sorted({n // 9 + r.randrange(-4, 4), n // 9})) for n in r.sample(range(90_000), 700)] + [("M", 5, 1, [9]), ("M", 6, 2, [7]), (None, 7, 1, [9]), (None, None, 1, [1])]
    df = spark.createDataFrame(rows, "law_id string, article_number int, chunk_order long, source_pages array<int>")
    want = set()
    for law in {x[0] for x in rows}:
        before = 0
        for _, n, o, pages in sorted((x for x in rows if x[0] == law), key=lambda x: (-1 if x[1] is None else x[1], x[2])):
            if pages and pages[0] < before - 1:
                want.add((law, n, o))
            before = max(pages) if pages else before
    assert {(x.law_id, x.article_number, x.chunk_order) for x in quality.page_violations(df).collect()} == want and len(want) > 20


def some_chunks(spark, r, docs):
    rows = []
    for d in docs:
        numbers = [r.choice([i, i, i + 300, 3]) for i in range(1, r.randrange(2, 9))]
        for i, n in enumerate(numbers):
            place = [r.choice([None, 1, 2]) for _ in range(3)]
            refs, terms, laws = r.sample(range(1, 9), 2) + [301], r.sample(["t1", "t2", "t3"], 2), r.sample(["x", "y", "z"], r.randrange(3))
            common = (d, f"L{d % 3}", f"L{d % 3}-art{n:03}", "Article", *place, r.choice(["a", "b"]), n, None, None, None, refs, laws, terms, f"text {r.randrange(3)}", 100 * i)
            rows.append(common)
            if r.random() < 0.5:
                rows.append((*common[:2], f"{common[2]}-seg01", "ArticleSegment", *common[4:9], None, 1, 1, *common[12:16], 100 * i + 1))
            if r.random() < 0.3:
                t = r.choice(["t1", "t2", "t3"])
                rows.append((*common[:2], f"L{d % 3}-def-{t}", "Definition", *common[4:9], t, None, None, [], [], [], "def", 100 * i + 2))
    schema = "doc_id long, law_id string, node_id string, node_type string, book_number int, part_number int, chapter_number int, book_title string, article_number int, defined_term string, segment_index int, segment_total int, cross_refs array<int>, external_refs array<string>, defined_terms_used array<string>, text string, chunk_order long"
    df = spark.createDataFrame(rows, schema)
    none = F.lit(None)
    return df.withColumns({"part_title": F.col("book_title"), "chapter_title": F.col("book_title"), "term_variants": F.array("text"), "text_normalized": F.col("text"), "char_count": F.length("text"), "token_count_est": F.lit(1), "source_pages": F.array(F.lit(1)), "embedding": none.cast("array<float>")})


def test_loads_one_after_the_other_equal_a_build_from_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "BUCKET", 2)
    monkeypatch.setattr(delta, "PARTS", 4)
    r, path = random.Random(11), str(tmp_path / "graph")
    chunks = session.cut(some_chunks(spark, r, range(5)))
    delta.store(graph.build_graph(chunks, EACH), path)
    for step, (docs, dropped) in enumerate((((1, 7), None), ((4,), 2))):
        new = session.cut(some_chunks(spark, r, docs))
        gone = None if dropped is None else spark.createDataFrame([(dropped,)], "doc_id long")
        chunks, touched = delta.load(chunks, new, path, EACH, gone)
        chunks = session.cut(chunks)
        assert touched["edges"] > 0
        for name, want in graph.build_graph(chunks, EACH).items():
            have = spark.read.schema(want.schema).parquet(f"{path}/{name}").select(want.columns)
            assert sorted(map(str, have.collect())) == sorted(map(str, want.collect())), (step, name)
    again = chunks.filter("doc_id = 3")
    assert set(delta.load(chunks, again, path, EACH)[1].values()) == {0}


def test_rows_touched_follow_the_change(spark, tmp_path):
    def law(n, moved):
        rows = [(1, "L", f"L-art{i:05}", "Article", 1, 1, 1, i + (10_000 if i == moved else 0), [i % 97 + 1], i) for i in range(1, n)]
        df = spark.createDataFrame(rows, "doc_id long, law_id string, node_id string, node_type string, book_number int, part_number int, chapter_number int, article_number int, cross_refs array<int>, chunk_order long")
        text = {"text": F.lit("x"), "text_normalized": F.lit("x"), "char_count": F.lit(1), "token_count_est": F.lit(1), "source_pages": F.array(F.lit(1)), "embedding": F.lit(None).cast("array<float>"), "defined_term": F.lit(None).cast("string"), "term_variants": F.array().cast("array<string>")}
        more = {f"{x}_title": F.lit("t") for x in ("book", "part", "chapter")} | {"segment_index": F.lit(None).cast("int"), "segment_total": F.lit(None).cast("int"), "external_refs": F.array().cast("array<string>"), "defined_terms_used": F.array().cast("array<string>")}
        return session.cut(df.withColumns(text | more))

    for n in (400, 900):
        before, after = law(n, None), law(n, 333)
        path = str(tmp_path / str(n))
        delta.store(graph.build_graph(before, EACH), path)
        touched = delta.load(before, after, path, EACH)[1]
        assert touched["edges"] <= 8 and touched["Article"] == 2


def counting(folder):
    """A provider that notes what it is sent, and fails while a file says so; and what it was sent so far."""

    def provider(texts):
        if os.path.exists(f"{folder}/broken") and any(t.startswith("late") for t in texts):
            raise ValueError("down")
        with open(f"{folder}/{uuid.uuid4().hex}.sent", "w", encoding="utf-8") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    return provider, lambda: [x for p in glob.glob(f"{folder}/*.sent") for x in open(p, encoding="utf-8").read().split("\n")]


def test_embedding_is_taken_up_where_it_broke_off(spark, tmp_path):
    (provider, sent), path = counting(str(tmp_path)), str(tmp_path / "store")
    texts = [f"{'late' if i % 10 == 0 else 'text'} {i % 60}" for i in range(120)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    (tmp_path / "broken").touch()
    with pytest.raises(Exception):
        embed_stored(df, "t", provider, path, batch=2, per_round=7, attempts=1, delay=0.0).count()
    stood = spark.read.schema("key string").parquet(path).count() if os.path.exists(path) else 0
    os.remove(tmp_path / "broken")
    before = len(sent())
    rows = embed_stored(df, "t", provider, path, batch=2, per_round=7, attempts=1, delay=0.0, calls_per_minute=60_000).collect()
    assert len(rows) == 122 and all(r.embedding == [float(len(r.t or "")), 1.0] for r in rows)
    assert len(sent()) - before == 61 - stood  # what stands isn't sent again, and equal texts are sent once
    again = len(sent())
    assert embed_stored(df, "t", provider, path).count() == 122 and len(sent()) == again
    assert embed_stored(df.limit(0), "t", provider, str(tmp_path / "none")).count() == 0


def test_calls_keep_their_distance():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    paced = Paced(lambda texts: texts, 3.0, sleep, lambda: now[0])
    for _ in range(3):
        paced(["x"])
        now[0] += 1.0
    assert waits == [2.0, 2.0]

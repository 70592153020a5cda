"""Schemas of the records that operators exchange, as DDL."""

CHUNK = """node_id STRING, node_type STRING, law_id STRING, law_title STRING, book_number INT, book_title STRING,
part_number INT, part_title STRING, chapter_number INT, chapter_title STRING, article_number INT, is_definition BOOLEAN,
defined_term STRING, term_variants ARRAY<STRING>, segment_index INT, segment_total INT, text STRING, text_normalized STRING,
char_count INT, token_count_est INT, cross_refs ARRAY<INT>, external_refs ARRAY<STRING>, defined_terms_used ARRAY<STRING>,
source_pages ARRAY<INT>, embedding ARRAY<FLOAT>, doc_id BIGINT, chunk_order BIGINT"""
GLOSSARY = "term STRING, node_id STRING"
PAGES = "doc_id BIGINT, page_num INT, raw_text STRING, cleaned_text STRING"
QUESTIONS = "qid BIGINT, question STRING, mode STRING, primary_k INT"
RETRIEVED = "qid BIGINT, node_id STRING, node_type STRING, article_number INT, breadcrumb STRING, text STRING, score DOUBLE, source STRING, pos INT"
EDGES = "src STRING, dst STRING, type STRING, idx INT, total INT"

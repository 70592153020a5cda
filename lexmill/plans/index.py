"""Building an index in stages, each over the Parquet tables of the one before, so it can be started again anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import CorpusConfig
from lexmill.functions import spans, text
from lexmill.operators import annotate, chunking, graph, quality, structure, vector
from lexmill.providers import HashEmbedding, embed_stored
from lexmill.plans.stages import Stages, of_rows
from lexmill.session import cut
from lexmill.sources.files import read_tables, write_tables

GRAPH = ("Law", "Book", "Part", "Chapter", "Article", "ArticleSegment", "Definition", "ExternalLaw", "edges")


def chunk_pages(pages: DataFrame, config: CorpusConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks with annotations, glossary and articles of ``pages(doc_id, page_num, cleaned_text)``.

    Articles and chunks are written once: chunks, glossary and counters start from the former, annotation and glossary from the latter.
    """
    articles = cut(structure.parse_pages(pages, config.max_title))
    if "law_id" in pages.columns:
        articles = articles.join(pages.groupBy("doc_id").agg(F.min("law_id").alias("law_id")), "doc_id")
    chunks = cut(chunking.build_chunks(articles, spans.page_offsets(pages), config))
    terms = chunking.glossary(chunks)
    return annotate.annotate(chunks, terms), terms, articles


def stage_chunk(pages: DataFrame, path: str, config: CorpusConfig) -> DataFrame:
    """Write chunks and glossary; returns the counters."""
    chunks, terms, articles = chunk_pages(pages, config)
    write_tables({"chunks": chunks, "glossary": terms}, path)
    return quality.counters(pages, articles, pages.sparkSession.read.parquet(f"{path}/chunks"))


def stage_embed(spark: SparkSession, path: str, provider: Callable[[list[str]], list[list[float]]] = HashEmbedding()) -> None:
    """Write the chunks with their embeddings; vectors are kept by text, so a run that died, or a changed chunk, costs only what is new."""
    chunks = read_tables(spark, path, ["chunks"])["chunks"]
    write_tables({"embedded": embed_stored(chunks, "text_normalized", provider, f"{path}/vectors_by_text")}, path)


def stage_load(spark: SparkSession, path: str, config: CorpusConfig) -> dict[str, DataFrame]:
    """Write the graph of the embedded chunks; an error if no chunk has an embedding."""
    chunks = spark.read.parquet(f"{path}/embedded")
    vector.dimension(chunks.select(F.col("node_id"), "embedding")).first()
    write_tables(graph.build_graph(chunks, config), f"{path}/graph")
    return read_tables(spark, f"{path}/graph", GRAPH)


def build_index(pages: DataFrame, path: str, config: CorpusConfig, provider: Callable[[list[str]], list[list[float]]] = HashEmbedding(), model: str = "hash") -> dict[str, bool]:
    """Bring the stages chunk, embed and graph under ``path`` up to date; returns which of them were stale.

    A stage is stale if its input, settings or code changed since its tables were written, and its tables change at once
    when it ends. ``model`` names what ``provider`` asks; another name makes all vectors anew. Read with ``read_index``.
    """
    spark, ran = pages.sparkSession, {}
    at = Stages(spark, path)

    def chunked() -> dict[str, DataFrame]:
        chunks, terms, _ = chunk_pages(pages, config)
        return {"chunks": chunks, "glossary": terms}

    def embedded() -> dict[str, DataFrame]:
        return {"embedded": embed_stored(at.read("chunk")["chunks"], "text_normalized", provider, f"{path}/vectors_by_text/{model}")}

    def loaded() -> dict[str, DataFrame]:
        chunks = at.read("embed")["embedded"]
        vector.dimension(chunks.select(F.col("node_id"), "embedding")).first()
        return graph.build_graph(chunks, config)

    ran["chunk"] = at.run("chunk", chunked, [of_rows(pages)], config, [chunk_pages, structure, chunking, annotate, spans, text])
    ran["embed"] = at.run("embed", embedded, [at.fingerprint("chunk")], model, [embed_stored])
    ran["graph"] = at.run("graph", loaded, [at.fingerprint("embed")], config, [graph])
    return ran


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the stage graph as the last run that ended left them."""
    return Stages(spark, path).read("graph")

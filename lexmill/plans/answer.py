"""Answering a batch of questions as one plan."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.config import RouteConfig
from lexmill.operators import context, retrieval
from lexmill.providers import HashEmbedding, embed, extractive_answer
from lexmill.session import cut, parts_for

log = logging.getLogger(__name__)
Answer = Callable[[Column, Column, Column], Column]


def routed(questions: DataFrame, config: RouteConfig) -> DataFrame:
    """``questions(qid, question, mode, primary_k)`` with their profile and the articles that they name."""
    return retrieval.resolved(questions).withColumn("refs", retrieval.route(F.col("question"), config))


def found_for(asked: DataFrame, graph: dict[str, DataFrame], config: RouteConfig) -> DataFrame:
    """The chunks of embedded questions after expansion, deduplication and the cap."""
    nodes = retrieval.node_view(graph)
    named, near = retrieval.explicit(asked, nodes), retrieval.primary(asked, nodes, config)
    start = retrieval.seeds(named.union(near)).join(asked.select("qid", "definitions_per_article", "crossrefs_per_article"), "qid")
    cap, parts = config.global_row_cap, parts_for(graph["edges"])
    terms = retrieval.expand(start, graph["edges"], nodes, "USES_TERM", F.col("definitions_per_article"), "definition", cap, parts)
    refs = retrieval.expand(start, graph["edges"], nodes.filter("node_type = 'Article'"), "REFERENCES", F.col("crossrefs_per_article"), "cross_ref", cap, parts)
    found = reduce(DataFrame.unionByName, [named, near, terms, refs]).join(asked.select("qid", "max_context_chunks"), "qid")
    return retrieval.dedupe_and_cap(found, F.col("max_context_chunks"))


def retrieve(questions: DataFrame, graph: dict[str, DataFrame], embedder: Callable = HashEmbedding(), config: RouteConfig = RouteConfig()) -> tuple[DataFrame, DataFrame]:
    """Questions with refs and profile, and their chunks."""
    asked = embed(routed(questions, config), "question", embedder)
    return asked, found_for(asked, graph, config)


def generate(asked: DataFrame, found: DataFrame, answer: Answer) -> DataFrame:
    """qid, question, answer, error, sources, detected_refs.

    ``answer`` is given the prompt, the system prompt of the question's mode and the token limit of its profile; it
    returns a text, or a struct of answer and error.
    """
    told = context.prompts(asked, found).join(asked.select("qid", "mode", "max_tokens"), "qid")
    told = told.withColumn("said", answer(F.col("prompt"), context.system_prompt(F.col("mode")), F.col("max_tokens")))
    failed = isinstance(told.schema["said"].dataType, StructType)
    text, error = (F.col("said.answer"), F.col("said.error")) if failed else (F.col("said"), F.lit(None).cast("string"))
    told = told.select("qid", F.coalesce(text, F.lit("")).alias("answer"), error.alias("error"))
    out = asked.select("qid", "question", F.col("refs").alias("detected_refs")).join(told, "qid").join(context.sources(found), "qid", "left")
    return out.select("qid", "question", "answer", "error", "sources", "detected_refs")


def answer_batch(questions: DataFrame, graph: dict[str, DataFrame], embedder: Callable = HashEmbedding(), answer: Answer = extractive_answer, config: RouteConfig = RouteConfig()) -> DataFrame:
    """qid, question, answer, error, sources, detected_refs per row of ``questions(qid, question, mode, primary_k)``."""
    asked, found = retrieve(questions, graph, embedder, config)
    return generate(asked, found, answer)


def answer_timed(questions: DataFrame, graph: dict[str, DataFrame], embedder: Callable = HashEmbedding(), answer: Answer = extractive_answer, config: RouteConfig = RouteConfig()) -> DataFrame:
    """``answer_batch`` stage by stage, each written, with elapsed_ms (of the batch, by stage), one line in the log for the
    batch, and log_line for each question: what was asked, the articles it names, the chunks found and the times."""
    took: dict[str, int] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        began = time.monotonic()
        df = cut(df)
        took[name] = max(1, round(1000 * (time.monotonic() - began)))
        return df

    asked = stage("route", routed(questions, config))
    asked = stage("embed", embed(asked, "question", embedder))
    found = stage("retrieve", found_for(asked, graph, config))
    out = stage("generate", generate(asked, found, answer))
    log.info("answered a batch: %s", ", ".join(f"{k} {v} ms" for k, v in took.items()))
    times = F.lit(" ".join(f"{k}_ms={v}" for k, v in took.items()))
    refs = F.array_join(F.transform("detected_refs", lambda n: n.cast("string")), ",")
    line = F.format_string("question=%s refs=[%s] chunks=%d %s", F.coalesce("question", F.lit("")), refs, F.when(F.col("sources").isNull(), 0).otherwise(F.size("sources")), times)
    return out.withColumn("elapsed_ms", F.create_map(*(F.lit(x) for pair in took.items() for x in pair))).withColumn("log_line", line)

"""Sources and sinks: paged documents, JSON lines, the glossary file, graph tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions.text import clean_page
from lexmill.sources import pdf

FORM_FEED = b"\x0c"


def form_feed_pages(content: bytes) -> list[str]:
    """The default page parser: text with form feeds between pages."""
    return [p.decode("utf-8", "replace") for p in content.split(FORM_FEED)]


def _read(files: DataFrame, parser: Callable[[bytes], Iterable[str]], stop: type[Exception] | tuple[type[Exception], ...]) -> DataFrame:
    """A row a page of each file, in small batches; an error of a kind in ``stop`` is a row and ends its file."""

    def rows(doc: int, content: bytes) -> Iterator[tuple]:
        number = 0
        try:
            for number, text in enumerate(parser(content), 1):
                yield doc, number, text, None
        except stop as error:
            yield doc, number + 1, None, str(error)

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = (r for doc, content in zip(p.doc_id, p.content, strict=True) for r in rows(doc, bytes(content)))
            while batch := list(islice(found, 64)):
                yield pd.DataFrame(batch, columns=["doc_id", "page_num", "raw_text", "error"])

    out = files.mapInPandas(run, "doc_id long, page_num int, raw_text string, error string")
    return out.withColumn("cleaned_text", clean_page(F.col("raw_text"))).select("doc_id", "page_num", "raw_text", "cleaned_text", "error")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "content")


def read_pages(spark: SparkSession, path: str, parser: Callable[[bytes], Iterable[str]] = form_feed_pages) -> DataFrame:
    """doc_id (a hash of the path), page_num from 1, raw_text, cleaned_text of all files; a missing path is an error."""
    return _read(_files(spark, path), parser, ()).drop("error")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), page_num from 1, raw_text, cleaned_text and error of all PDF files; a missing path is an error.

    A file that can't be read, or not to its end, gives the pages before that and then one row with its error and no
    text; empty files give no rows. A file is a row (under 2 GiB) and is read by one task, page by page.
    """
    return _read(_files(spark, path), pdf.pages, pdf.PdfError)


def pages_of(documents: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """Documents as pages, split at a separator."""
    rows = documents.select("doc_id", F.posexplode(F.split(text, separator)).alias("i", "raw_text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("page_num"), "raw_text", clean_page(F.col("raw_text")).alias("cleaned_text"))


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.CHUNK) -> DataFrame:
    """One record per line that isn't blank; the schema is given, never inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """term and node_id from one JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "node_id"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}

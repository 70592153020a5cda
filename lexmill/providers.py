"""Embedding and answer providers: what remote services do, behind an interface, with local defaults."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

ATTEMPTS, DELAY, BATCH = 5, 2.0, 16


class RateLimited(Exception):
    """The service asks to wait; always worth another attempt."""


def with_retries(call: Callable[[], list], attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> list:
    """Up to ``attempts`` calls with doubling delays; other errors are raised on the last, rate limits become a RuntimeError."""
    for attempt in range(attempts):
        try:
            return call()
        except RateLimited:
            sleep(delay * 2**attempt)
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(delay * 2**attempt)
    raise RuntimeError(f"rate limited {attempts} times")


class HashEmbedding:
    """Deterministic unit vectors from hashed words; for tests and offline use."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                row[int.from_bytes(h[:4], "little") % self.dim] += 1 if h[4] & 1 else -1
            if (n := np.sqrt(row @ row)) > 0:
                row /= n
        return out.tolist()


class Paced:
    """A provider that keeps to a rate: its calls begin at least ``gap`` seconds apart in each task."""

    def __init__(self, provider: Callable[[list[str]], list], gap: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.provider, self.gap, self.sleep, self.clock, self.free = provider, gap, sleep, clock, 0.0

    def __call__(self, texts: list[str]) -> list:
        if (wait := self.free - self.clock()) > 0:
            self.sleep(wait)
        self.free = self.clock() + self.gap
        return self.provider(texts)


def embed(
    df: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], out: str = "embedding", batch: int = BATCH, attempts: int = ATTEMPTS, delay: float = DELAY
) -> DataFrame:
    """``df`` with the embedding of a column, in batches of the provider's size; the provider is pickled to tasks."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in with_retries(lambda i=i: provider(texts[i : i + batch]), attempts, delay)], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def embed_stored(
    df: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], path: str, out: str = "embedding", batch: int = BATCH, per_round: int = 100_000, calls_per_minute: float | None = None, **retries
) -> DataFrame:
    """``df`` with the embedding of a column, by way of a table of vectors by text under ``path``.

    Only texts that the table lacks are sent, each once, in rounds of about ``per_round`` texts; a round's vectors stand
    once it ends, so a run that dies is taken up at the round it was in. A rate of calls is shared out over the tasks of a
    round. Null texts count as empty ones.
    """
    spark = df.sparkSession
    schema = "key string, vector array<float>"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    have = spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
    wanted = df.select(F.coalesce(text, F.lit("")).alias("t")).distinct().withColumn("key", text_key(F.col("t")))
    left = cut(wanted.join(have, "key", "left_anti"))
    n = left.count()
    rounds = -(-n // per_round)
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // max(rounds, 1) // batch)))
    paced = Paced(provider, 60 * tasks / calls_per_minute) if calls_per_minute else provider
    for i in range(rounds):
        part = left.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == i).repartition(tasks, "key")
        embed(part, "t", paced, "vector", batch, **retries).select("key", "vector").write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path) if exists or rounds else have
    return df.withColumn("_key", text_key(F.col(text))).join(known.select(F.col("key").alias("_key"), F.col("vector").alias(out)), "_key", "left").drop("_key")


def answering(call: Callable[[str, str, int], str], attempts: int = ATTEMPTS, delay: float = DELAY) -> Callable[[Column, Column, Column], Column]:
    """An answer provider from ``call(prompt, system prompt, max_tokens)``, with retries; a row whose call fails in the end
    gets the error in place of an answer, and the others go on."""

    @F.pandas_udf("struct<answer string, error string>")
    def run(prompts: pd.Series, systems: pd.Series, limits: pd.Series) -> pd.DataFrame:
        rows = []
        for prompt, system, limit in zip(prompts, systems, limits, strict=True):
            try:
                rows.append((with_retries(lambda p=prompt, s=system, n=limit: call(p, s, int(n)), attempts, delay), None))
            except Exception as error:  # whatever a service raises, it is the row's
                rows.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["answer", "error"])

    return run


def extractive_answer(prompt: Column, system: Column | None = None, max_tokens: Column | None = None) -> Column:
    """The default answer: the first reference text of a prompt, empty if there is none."""
    return F.coalesce(F.regexp_extract(prompt, "(?s)\n\n\\[[^\\]]+\\]\n(.*?)\n---", 1), F.lit(""))

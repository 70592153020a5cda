"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of a stream of batches, one at a time."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            yield dict(zip(batch.schema.names, row, strict=True))


def release() -> None:
    """Give freed memory back to the system. Python workers live on between tasks, and what their allocators hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving its memory back at the end of each task."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def free_names(df: DataFrame, made: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` without the names that an operator makes: such columns get ``_input`` appended, as often as needed.

    Also returns the new names by the old ones. Names differ if they do in more than case, as in Spark.
    """
    taken = {c.lower() for c in df.columns} | {c.lower() for c in made}
    moved = {}
    for c in df.columns:
        if c.lower() in {m.lower() for m in made}:
            new = c + "_input"
            while new.lower() in taken:
                new += "_input"
            taken.add(new.lower())
            moved[c] = new
    return df.withColumnsRenamed(moved), moved

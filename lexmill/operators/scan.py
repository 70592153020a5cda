"""Scans in order over rows of a key, where a key may hold more rows than a task can.

Rows are dealt by ranges of (key, order), so a large key lies in many partitions. In a first pass each partition
sums up what its rows of its last key do to a state, as a function; one row a partition. Going through those in order gives
every partition the state in which its first key arrives. In a second pass each partition steps through its rows from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut


class Builder(Protocol):
    def push(self, row: tuple) -> None:
        """The next row."""

    def function(self) -> Any:
        """What the rows so far do to a state, as JSON."""


class Machine(Protocol):
    """A state that rows change, and what it puts beside each row. States and functions are JSON values."""

    reads: tuple[str, ...]
    adds: str  # the columns put beside each row, as DDL

    def start(self) -> Any: ...

    def builder(self) -> Builder: ...

    def after(self, function: Any, state: Any) -> Any:
        """The state after the rows of a function."""

    def step(self, state: Any, row: tuple) -> tuple[Any, tuple]:
        """The state after a row, and the row's new columns."""


def segmented(rows: DataFrame, key: str, order: list[str], machine: Machine, parts: int | None = None) -> DataFrame:
    """``rows`` with what ``machine`` adds to each, as it steps through the rows of each key in order.

    ``parts`` fixes the number of ranges. Null keys are one key, first in order; nulls in ``order`` come first. Rows of equal
    key and order lie in one range and are taken in any order, so ``order`` should tell them apart.
    """
    ranged = rows.repartitionByRange(parts, key, *order) if parts else rows.repartitionByRange(key, *order)
    dealt = cut(ranged.sortWithinPartitions(key, *order))
    kind, arrow = rows.schema[key].dataType.simpleString(), None
    added = [c.split() for c in machine.adds.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    arrow = types[kind]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = now = builder = None
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in (key, *machine.reads)), strict=True):
                if builder is None or k != now:
                    first = (k,) if builder is None else first
                    now, builder = k, machine.builder()
                builder.push(tuple(row))
        if builder is not None:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first[0]], arrow), pa.array([now], arrow), pa.array([json.dumps(builder.function())])]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "last", "function"])

    def states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, machine.start()
        for b in batches:
            out = []
            for first, last, function in zip(*(b.column(c).to_pylist() for c in ("first", "last", "function")), strict=True):
                if now is None or now[0] != first:
                    state = machine.start()
                out.append(json.dumps(state))
                state = machine.after(json.loads(function), state if last == first else machine.start())
                now = (last,)
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(out, pa.string())], names=["_part", "_state"])

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for b in batches:
            out = []
            for k, given, *row in zip(*(b.column(c).to_pylist() for c in (key, "_state", *machine.reads)), strict=True):
                if now is None or k != now[0]:
                    state = json.loads(given) if now is None else machine.start()
                    now = (k,)
                state, made = machine.step(state, tuple(row))
                out.append(made)
            made = [pa.array([o[c] for o in out], types[t]) for c, (_, t) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + made, names=[*columns, *(n for n, _ in added)])

    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    functions = dealt.select(key, *machine.reads).mapInArrow(sums, f"part int, first {kind}, last {kind}, function string")
    carried = functions.repartition(1).sortWithinPartitions("part").mapInArrow(states, "_part int, _state string")  # a row a partition
    met = dealt.withColumn("_part", F.spark_partition_id()).join(F.broadcast(carried), "_part")
    return met.mapInArrow(steps, f"{schema}, {machine.adds}")

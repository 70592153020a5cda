"""Histories of sessions: turns are added, a clear empties the history, and so does a long silence.

An event is (session, at, seq, kind); kind 'clear' empties, every other kind is a turn. Beside each event stand the time and
seq of the first turn of the history it is in (``began_at``, ``began_seq``) and ``turn``, its number in it: what is on show
after the event are that many turns. A clear has turn 0. Turns are rows of a table, and the state of a session is four
values, however long it goes on.

Defined cases: events go by (at, seq, kind), nulls first, then by their other columns; a null time is that of 1970; an event
comes after a silence if its time is more than ``idle_seconds`` after that of the event before it, clears included; null
sessions are one session; a null kind is a turn; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampNTZType

from lexmill.operators import scan

CLEAR = "clear"
NO_SEQ = -(1 << 63)  # stands for a null


class Histories:
    """A machine for ``scan.segmented``. A state is the time of the last event, the beginning of the history as (time, seq),
    and its turns; a function is the first and the last time of its rows, the state they end in if one of them empties the
    history, else how many turns they are and where the first one is."""

    reads = ("_us", "_seq", "kind")
    adds = "_began long, _began_seq long, turn long"

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * 1_000_000

    def start(self) -> list:
        return [None, None, None, 0]

    def builder(self) -> _Stretch:
        return _Stretch(self)

    def after(self, function: list, state: list) -> list:
        first, last, emptied, turns, began = function
        if emptied is not None:
            return emptied
        before, *beginning, n = state
        if before is not None and first - before > self.idle:
            n = 0
        return [last, *(began if turns and not n else beginning), n + turns]

    def step(self, state: list, row: tuple) -> tuple[list, tuple]:
        before, began, began_seq, turn = state
        now, seq, kind = row
        if before is not None and now - before > self.idle:
            turn = 0
        before = now if before is None else max(before, now)
        if kind == CLEAR:
            return [before, None, None, 0], (None, None, 0)
        if not turn:
            began, began_seq = now, seq
        return [before, began, began_seq, turn + 1], (began, began_seq, turn + 1)


class _Stretch:
    def __init__(self, machine: Histories):
        self.machine, self.first, self.emptied, self.state = machine, None, False, machine.start()

    def push(self, row: tuple) -> None:
        self.first = row[0] if self.first is None else self.first
        silent = self.state[0] is not None and row[0] - self.state[0] > self.machine.idle
        self.emptied = self.emptied or silent or row[2] == CLEAR
        self.state = self.machine.step(self.state, row)[0]

    def function(self) -> list:
        last, *began, turns = self.state
        return [self.first, last, self.state if self.emptied else None, turns, began]


def micros(df: DataFrame, at: str = "at") -> Column:
    """Microseconds since 1970; of times without a zone as they stand, whatever the session's zone."""
    if df.schema[at].dataType != TimestampNTZType():
        return F.unix_micros(at)
    since = F.col(at) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    part = lambda unit, seconds: F.extract(F.lit(unit), since).cast("decimal(14,6)") * F.lit(seconds * 1_000_000).cast("long")
    return (part("DAY", 86_400) + part("HOUR", 3_600) + part("MINUTE", 60) + part("SECOND", 1)).cast("long")


def _keyed(events: DataFrame) -> DataFrame:
    return events.withColumns({"_us": F.coalesce(micros(events), F.lit(0)), "_seq": F.coalesce(F.col("seq").cast("long"), F.lit(NO_SEQ))})


def _named(told: DataFrame, columns: list[str]) -> DataFrame:
    seq = F.nullif(F.col("_began_seq"), F.lit(NO_SEQ))
    began = F.timestamp_micros("_began")
    if told.schema["at"].dataType == TimestampNTZType():
        began = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.col("_began") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return told.select(*columns, began.alias("began_at"), seq.alias("began_seq"), "turn")


def replay(events: DataFrame, idle_seconds: int, parts: int | None = None) -> DataFrame:
    """``events(session, at, seq, kind, ...)`` with began_at, began_seq and turn, as one batch. A session may hold more
    events than a task can; ``parts`` fixes the number of ranges they are dealt over."""
    rest = [c for c in events.columns if c not in ("session", "at", "seq", "kind")]
    keyed = _keyed(events).withColumn("_rest", F.xxhash64(*rest) if rest else F.lit(0).cast("long"))
    return _named(scan.segmented(keyed, "session", ["_us", "_seq", "kind", "_rest"], Histories(idle_seconds), parts), events.columns)


def shown(told: DataFrame) -> DataFrame:
    """session, events, began_at, began_seq and turns after its last event, of what ``replay`` or a stream has told."""
    at = F.struct(F.coalesce(micros(told), F.lit(0)), "seq", "kind", "turn")
    last = F.max_by(F.struct("began_at", "began_seq", "turn"), at).alias("l")
    return told.groupBy("session").agg(F.count("*").alias("events"), last).select("session", "events", "l.began_at", "l.began_seq", F.col("l.turn").alias("turns"))


def stream(events: DataFrame, idle_seconds: int, late: str = "1 hour") -> DataFrame:
    """``replay`` of a stream of ``events(session, at, seq, kind, body)``: the same rows for events that come in the order of
    their session, however they fall into micro-batches.

    A session's events of one micro-batch are put in order by one task; bound them by the source's rate. An event older
    than what its session had before is numbered as it arrives. A session's state is dropped once the watermark (the
    latest time seen, less ``late``) is past the silence that empties its history anyway.
    """
    machine = Histories(idle_seconds)
    made = ["_began", "_began_seq", "turn"]
    columns = ["session", "at", "seq", "kind", "body"]

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["_us", "_seq", "kind", "body"], na_position="first", kind="stable").reset_index(drop=True)
        now, out = list(state.get) if state.exists else machine.start(), []
        for row in zip(rows["_us"].tolist(), rows["_seq"].tolist(), rows["kind"], strict=True):
            now, told = machine.step(now, row)
            out.append(told)
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(now[0] // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        for j, name in enumerate(made):
            rows[name] = pd.array([o[j] for o in out], dtype="Int64")
        yield rows[["session", "at", "_seq", "kind", "body", *made]]

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"session {kinds['session']}, at timestamp, _seq long, kind string, body string, {Histories.adds}"
    rows = _keyed(events.select(*columns)).withWatermark("at", late).select("session", "at", "_us", "_seq", "kind", "body")
    told = rows.groupBy("session").applyInPandasWithState(run, schema, "last long, began long, began_seq long, turn long", "append", GroupStateTimeout.EventTimeTimeout)
    return _named(told.withColumn("seq", F.nullif(F.col("_seq"), F.lit(NO_SEQ))), columns)

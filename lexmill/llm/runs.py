"""Periodic runs of words, found on a harmonic grid.

A run is a stretch of consecutive words with smallest period q, no shorter than ``least`` words and ``times`` periods,
that no neighbouring word extends. Words q apart then agree over at least (times - 1) q words, so a grid of that step
meets every run of period q; over all periods that is a harmonic sum, n log n grid points. All (period, point) pairs
whose words agree are extended both ways at once: a binary search on the length of the common extension compares
prefix hashes. Pairs that give the same stretch are one run, with its smallest period (a stretch of two periods or more
has as periods only multiples of the smallest). In the end the words of each run are compared; if a hash deceived,
which only lengthens an extension, the text is done again with other hashes. Results are exact.

Defined cases: null and empty texts have no words and no runs; rows stand alone, so repeated and null ids don't matter;
columns whose names clash with those made are moved aside; an empty table gives an empty one. A text is one row, so it
has to fit a task several times; pairs are handled at most PAIRS at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import free_names, lean

MADE = ("n_words", "runs", "strongest", "collapsed_text")
NAMES = ("start", "length", "period")
RUN = "struct<start:long,length:long,period:long>"
#: Grid points handled at once; words of several texts searched together; bytes of a text split, and handed on, at once.
PAIRS, WORDS, SLICE, SENT = 1 << 18, 1 << 16, 1 << 20, 4 << 20
PRIME = (1 << 31) - 1
BASES = (1_003_957_217, 741_103_597, 1_664_525_009, 950_706_376)


def _words(text: str) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as codes, and the distinct words. In UTF-8 the separators are what bytes.split() takes."""
    raw = text.encode("utf-8", "surrogatepass")
    codes: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(np.array([codes.setdefault(w, len(codes)) for w in raw[at:end].split()], np.int64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(codes)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo PRIME."""
    have = _powers.get(base, np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * (int(have[-1]) * base % PRIME) % PRIME])
    if len(have) <= PAIRS:
        _powers[base] = have
    return have


class Hashes:
    """Prefix hashes of a sequence; equal stretches have equal hashes."""

    def __init__(self, x: np.ndarray, salt: int):
        base = BASES[salt % len(BASES)] + salt // len(BASES)
        self.power = _power(base, len(x) + 1)
        # a code's value: two rounds of multiplication spread neighbouring codes over the field
        value = (x + 1 + salt) * 48_271 % PRIME
        value = (value ^ (value >> 13)) * 69_621 % PRIME + 1
        self.at = np.concatenate([[0], np.cumsum(value * self.power[: len(x)] % PRIME) % PRIME])

    def agree(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` at i and i + q have equal hashes."""
        at, j = self.at, i + q
        return (at[i + length] - at[i]) * self.power[q] % PRIME == (at[j + length] - at[j]) % PRIME

    def ahead(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the sequences at i and i + q agree, by binary search for all pairs at once."""
        lo, hi = np.zeros_like(i), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            ok = self.agree(i, q, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def back(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the sequences before i and i + q agree."""
        lo, hi = np.zeros_like(i), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            ok = self.agree(i - mid, q, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo


def _grid(begins: np.ndarray, sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Periods and grid points of all texts, with where each point's text begins and ends; at most about PAIRS at once."""
    many = sizes // times
    of = np.repeat(np.arange(len(sizes)), many)
    periods = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + 1
    steps = (times - 1) * periods
    counts = (sizes[of] - 1 - periods) // steps + 1
    upto = np.cumsum(counts)
    first = 0
    while first < len(periods):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        total = int(upto[last - 1] - before)
        for at in range(0, total, PAIRS):  # several times only for one period with many points
            points = np.arange(at, min(at + PAIRS, total))
            here = np.repeat(np.arange(first, last), counts[first:last]) if last > first + 1 else np.full(len(points), first)
            text = of[here]
            yield periods[here], begins[text] + (points - (upto[here] - counts[here] - before)) * steps[here], begins[text], begins[text] + sizes[text]
        first = last


def runs(x: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """start, length and period of every run, by start, then period, of texts laid end to end.

    ``x`` are words as codes, no code in two texts; ``sizes`` are the texts' numbers of words.
    """
    begins, salt = np.cumsum(sizes) - sizes, 0
    while True:
        found, hashes = [np.zeros((0, 3), np.int64)], None
        for q, i, begin, end in _grid(begins, sizes, times):
            same = np.flatnonzero(x[i] == x[i + q])
            if not len(same):
                continue
            hashes = hashes or Hashes(x, salt)
            q, i, begin, end = q[same], i[same], begin[same], end[same]
            b = hashes.back(i, q, i - begin)
            f = hashes.ahead(i, q, end - i - q)
            long = b + f + q >= np.maximum(least, times * q)
            if long.any():
                found.append(np.unique(np.stack([(i - b)[long], (b + f + q)[long], q[long]], axis=1), axis=0))
        rows = np.unique(np.concatenate(found), axis=0)
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of one stretch the smallest period
        rows = rows[first]
        if all(np.array_equal(x[s : s + size - p], x[s + p : s + size]) for s, size, p in rows.tolist()):
            return rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        salt += 1


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest exponent; of equal ones that of smallest start, then period."""
    if not len(found):
        return None
    rough = found[:, 1] / found[:, 2]
    near = found[rough >= rough.max() * (1 - 1e-9)].tolist()
    return tuple(max(near, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])))


def covered(found: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def _joined(x: np.ndarray, words: list[bytes]) -> str:
    return b" ".join(map(words.__getitem__, x.tolist())).decode("utf-8", "surrogatepass")


def collapse_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """``docs(text, ...)`` with n_words, runs (by start, then period), the strongest of them (null without any), and
    collapsed_text: the words joined by one space, each run cut down to its first period."""
    own, moved = free_names(docs, MADE)
    text = moved.get("text", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([(c, pa.int64()) for c in NAMES])
        kinds = (pa.int64(), pa.list_(one), one, pa.string())

        def part(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            made = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *MADE])

        def rows_of(held: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[tuple]:
            sizes = np.array([len(x) for x, _ in held], np.int64)
            shift = np.cumsum([0, *(len(w) for _, w in held)])  # no code in two texts
            found = runs(np.concatenate([x + k for (x, _), k in zip(held, shift, strict=False)]), sizes, least, times)
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(found[:, 0], ends)
            for (x, words), begin, lo, hi in zip(held, ends - sizes, [0, *cuts[:-1]], cuts, strict=True):
                own = found[lo:hi] - np.array([begin, 0, 0])
                best = strongest(own)
                kept = _joined(x[~covered(own, len(x))] if hi > lo else x, words)
                named = [dict(zip(NAMES, r, strict=True)) for r in own.tolist()]
                yield len(x), named, best and dict(zip(NAMES, best, strict=True)), kept

        for b in batches:
            at, rows, sent, held, size = 0, [], 0, [], 0
            for i, value in enumerate(b.column(text)):
                held.append(_words(value.as_py() or ""))
                size += len(held[-1][0])
                if size >= WORDS or i + 1 == b.num_rows:
                    for row in rows_of(held):
                        rows.append(row)
                        sent += len(row[3]) + 32 * len(row[1])
                        if sent >= SENT:
                            yield part(b.slice(at, len(rows)), rows)
                            at, rows, sent = at + len(rows), [], 0
                    held, size = [], 0
            if rows:
                yield part(b.slice(at, len(rows)), rows)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(lean(run), f"{schema}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed_text string")


def disturbed(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of them made periodic from some word on, as the query's contract asks; the others and
    rows without an id stay as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size, texts = 0, 0, []
            for i, (key, value) in enumerate(zip(b.column("doc_id"), b.column("text"), strict=True)):
                key, text = key.as_py(), value.as_py()
                h = 1 if key is None else zlib.crc32(str(key).encode())
                if h % 10 == 0 and text:
                    x, words = _words(text)
                    if n := len(x):
                        g = h // 10
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        text = _joined(np.concatenate([x[:a], x[a + np.arange(n - a) % p]]), words)
                texts.append(text)
                size += len(text or "")
                if size >= SENT or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(texts, pa.string())], names=["doc_id", "text"])
                    at, size, texts = i + 1, 0, []

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns of each document's runs and collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return collapse_runs(disturbed(docs)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period", F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )

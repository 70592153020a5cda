"""Removal of repeated passages, found by recompression.

Rounds rename the words of all documents at once: a run of equal symbols gets one name from the symbol and its
length, then each adjacent pair whose first symbol falls on the left and whose second on the right side of the
round's division of names gets one name from both. Names and sides depend on content alone, so all chunks agree on
them without being told, and equal passages get equal symbols except near their ends.

Symbols reveal repeats: each carries the stretch of words that decides it, a window that repeats can only hold decided
symbols that the corpus has twice, and one question about the symbols of an early round, counted over all documents,
clears nearly all other windows. Symbols also verify them: a window is spelled by what its surroundings can't change,
round by round until nothing is left inside: the cut runs at its ends and the symbols there that might pair outwards.
Equal windows have one spelling and different ones differ; their 96-bit names are compared over the corpus and every
occurrence but the first is marked.

Defined cases: null texts have no words; documents of fewer words than a window keep all; rows that repeat an id
are ordered by their text's hash (equal rows by place); a null id comes before all others; other columns are kept,
those named like a column that is made (MADE) with ``_input`` appended.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import chunks
from lexmill.llm.chunks import mix
from lexmill.llm.common import free_names, lean

MADE = ("n_words", "n_removed", "removed", "kept_text")
WINDOW, ROUNDS, LEAST, FAR = 20, 2, 2, 1 << 40
#: Multipliers of the two hashes of a spelling, and of a run's length in it.
ODD, COUNT = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)), np.uint64(0xD6E8FEB86659FD93)
#: A window as it is asked: 96 bits of its name, then where the chunk has it first.
ASK = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<i4")])


class Round(NamedTuple):
    """A round over a sequence of symbols: its runs, then the symbols made of them."""

    at: np.ndarray  # first symbol of each run
    size: np.ndarray  # symbols in it
    runs: tuple[np.ndarray, ...]  # its names
    right: np.ndarray  # its side
    heads: np.ndarray  # whether it begins a symbol of the next sequence
    names: tuple[np.ndarray, ...]  # the next sequence
    doc: np.ndarray


def one_round(names: tuple[np.ndarray, ...], doc: np.ndarray, r: int) -> Round:
    """``names`` hold one or more independent hashes per symbol, of which the first decides; ``doc`` its document."""
    salt = np.uint64(0x51 + 2 * r)
    joins = (names[0][1:] == names[0][:-1]) & (doc[1:] == doc[:-1])
    at = np.flatnonzero(np.concatenate([[True], ~joins]))
    size = np.diff(at, append=len(doc))
    long = np.flatnonzero(size > 1)
    doc, runs, out = doc[at], tuple(x[at] for x in names), []
    for x in runs:
        x[long] = mix(x[long] + mix(size[long].astype(np.uint64) * salt))
    right = (mix(runs[0] * salt) >> np.uint64(63)).astype(bool)
    pair = np.flatnonzero(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]))
    heads = np.ones(len(at), bool)
    heads[pair + 1] = False
    for x in runs:
        y = x.copy()
        y[pair] = mix(x[pair] * np.uint64(3) + x[pair + 1] * salt)
        out.append(y[heads])
    return Round(at, size, runs, right, heads, tuple(out), doc[heads])


def recompress(name: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Symbols after ``rounds``: names, first and end word, first and end word of the stretch that decides them.

    ``name`` holds a hash per word, ``doc`` the number of its document; a symbol that a document's end decides
    has a stretch that reaches far beyond it.
    """
    start = np.arange(len(name))
    stop, lo, hi = start + 1, start.copy(), start + 1
    for r in range(rounds if len(name) else 0):
        step = one_round((name,), doc, r)
        # runs; each is as long as it is only beside its neighbours
        at, last = step.at, step.at + step.size - 1
        same = doc[at[1:]] == doc[last[:-1]]
        before = np.concatenate([[-FAR], np.where(same, lo[last[:-1]], -FAR)])
        after = np.concatenate([np.where(same, hi[at[1:]], FAR), [FAR]])
        start, stop, lo, hi = start[at], stop[last], np.minimum(lo[at], before), np.maximum(hi[last], after)
        # pairs of a left and a right symbol
        second = ~step.heads
        pair = np.concatenate([second[1:], [False]])
        next_hi = np.concatenate([np.where(same, hi[1:], FAR), [FAR]])
        past_lo = np.concatenate([[-FAR], np.where(same, lo[:-1], -FAR)])
        alone = ~pair & ~second
        hi = np.where(pair | (alone & ~step.right), np.maximum(hi, next_hi), hi)
        lo = np.where(alone & step.right, np.minimum(lo, past_lo), lo)
        lo[:-1] = np.where(pair[:-1], np.minimum(lo[:-1], lo[1:]), lo[:-1])
        stop = np.where(pair, np.roll(stop, -1), stop)
        start, stop, lo, hi = (x[step.heads] for x in (start, stop, lo, hi))
        name, doc = step.names[0], step.doc
    return name, start, stop, lo, hi


def spelled(names: tuple[np.ndarray, ...], doc: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, ...]:
    """A hash, for each of ``names``, of the spelling of each window of ``width`` words at ``starts``.

    Each round spells the runs at both ends by symbol and length inside the window, and, of what is then left, a first
    symbol of the right side and a last one of the left side, as those might belong to a pair that begins or ends
    outside. All between is named alike wherever the window stands and goes on to the next round, until nothing is left:
    at least a run goes in each. Only words that a window covers take part.
    """
    covered = _covered(starts, len(doc), width)
    at = np.flatnonzero(covered)
    stretch = at + doc[at] - np.arange(len(at))  # one number for words of a document that follow each other
    names, doc, starts = tuple(x[at] for x in names), stretch, (np.cumsum(covered) - 1)[starts]
    out = tuple(np.zeros(len(starts), np.uint64) for _ in names)
    live, i, j, r = np.arange(len(starts)), starts, starts + width, 0
    sums = list(out)
    while len(live):
        step = one_round(names, doc, r)
        run, top = np.repeat(np.arange(len(step.at)), step.size), len(step.at) - 1
        first, last = run[i], run[j - 1]
        left, rest = np.minimum(step.at[first] + step.size[first], j) - i, np.where(first < last, j - step.at[last], 0)
        a, b = first + 1, last  # the runs that are whole
        pop_a = (a < b) & step.right[np.minimum(a, top)]
        a = a + pop_a
        pop_b = (a < b) & ~step.right[b - 1]
        for k, (name, own) in enumerate(zip(names, step.runs, strict=True)):
            odd = ODD[k]
            s = sums[k] * odd + name[i] + left.astype(np.uint64) * COUNT
            s = s * odd + np.where(rest > 0, name[j - 1] + rest.astype(np.uint64) * COUNT, np.uint64(0))
            s = s * odd + np.where(pop_a, own[a - 1], np.uint64(0))
            sums[k] = s * odd + np.where(pop_b, own[b - 1], np.uint64(0))
        b = b - pop_b
        more = a < b
        for k, s in enumerate(sums):
            out[k][live[~more]] = mix(s[~more])
            sums[k] = s[more]
        number = np.cumsum(step.heads) - 1
        live, i, j = live[more], number[a[more]], number[b[more] - 1] + 1
        names, doc, r = step.names, step.doc, r + 1
    return out


class _Work:
    """The words of a chunk and its symbols worth a question."""

    def __init__(self, batch: pa.RecordBatch, symbols: bool = True):
        self.batch = batch
        self.bounds, codes, distinct = chunks.words(batch.column("text"))
        self.hash = chunks.hashes(distinct)[codes] if len(codes) else np.zeros((0, 2), np.uint64)
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(self.bounds))
        if symbols:
            name, start, stop, self.lo, self.hi = recompress(self.hash[:, 0], self.doc)
            use = (stop - start >= LEAST) & (self.hi - self.lo <= WINDOW)
            self.lo, self.hi = self.lo[use], self.hi[use]
            self.names, self.of, n = np.unique(name[use] >> np.uint64(16), return_inverse=True, return_counts=True)
            self.twice = n > 1

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows whose decided symbols all are shared."""
        n = len(self.hash)
        rare = ~shared[self.of]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.maximum(self.hi[rare] - WINDOW, 0), 1)
        np.add.at(edge, self.lo[rare] + 1, -1)
        free = np.cumsum(edge[:n]) == 0
        ends = self.bounds[1:][self.doc] if n else np.zeros(0, np.int64)
        return np.flatnonzero(free & (np.arange(n) + WINDOW <= ends))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of the windows at ``starts``, where each is first, and each window's number among them."""
        a, b = spelled(tuple(np.ascontiguousarray(self.hash.T)), self.doc, starts)
        key = np.zeros(len(starts), np.dtype([("a", "<u8"), ("b", "<u4")]))
        key["a"], key["b"] = a, b.astype(np.uint32)
        order = np.lexsort((starts, key["b"], key["a"]))
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
        number = np.empty(len(starts), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return key[order][fresh], starts[order][fresh], number


def _symbols_twice(rows: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Which names occur twice; the lowest bit of a row tells that its own chunk has it twice."""
    names, of = np.unique(rows >> np.uint64(1), return_inverse=True)
    return (np.bincount(of, 1 + (rows & np.uint64(1)).astype(np.int64), len(names)) > 1)[of]


def _windows_first(rows: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Which rows are the first occurrence of their window."""
    order = np.lexsort((chunk, rows["start"], rows["tie"], rows["doc"], rows["b"], rows["a"]))
    a, b = rows["a"][order], rows["b"][order]
    out = np.empty(len(rows), bool)
    out[order] = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return out


def _covered(starts: np.ndarray, n: int, width: int = WINDOW) -> np.ndarray:
    """Words within the windows at ``starts``, all different."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:n]) > 0


def _results(batch: pa.RecordBatch, bounds: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """The rows of a chunk with n_words, n_removed, removed (word spans) and kept_text."""
    n, removed, spans, kept = np.diff(bounds), [], [], []
    texts = batch.column("text").to_pylist()
    for text, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        words = (text or "").encode().split()
        mask = gone[a:b]
        if mask.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans.append([{"start": x, "stop": y} for x, y in edges.reshape(-1, 2).tolist()])
            words = [words[i] for i in np.flatnonzero(~mask).tolist()]
        else:
            spans.append([])
        removed.append(int(mask.sum()))
        kept.append(b" ".join(words).decode())
    more = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "n_words", "n_removed", "removed", "kept_text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs(doc_id, text, ...)`` with n_words, n_removed, removed (spans of words) and kept_text."""
    docs, moved = free_names(docs, (*MADE, "_tie"))
    packed = chunks.pack(docs)
    n = chunks.partitions(docs)
    buckets = n * chunks.PER_PARTITION

    def ask_symbols(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunks.each(batches):
            w = _Work(chunks.unpacked(row["payload"]))
            yield from chunks.ask(row["chunk"], w.names << np.uint64(16), w.names << np.uint64(1) | w.twice.astype(np.uint64), buckets)

    symbols = chunks.answers(packed.mapInArrow(lean(ask_symbols), chunks.ASKED), np.dtype("<u8"), _symbols_twice)
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of the candidates, a bit per word."""
        for row in chunks.each(batches):
            w = _Work(chunks.unpacked(row["payload"]))
            starts = w.candidates(w.twice | chunks.marked(w.names << np.uint64(16), row["answer"], buckets))
            places = np.zeros(len(w.hash), bool)
            places[starts] = True
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([np.packbits(places).tobytes()], pa.binary())], names=["chunk", "places"])

    places = chunks.cut(packed.join(symbols.hint("shuffle_hash"), "chunk", "left").mapInArrow(lean(find), "chunk long, places binary"))
    placed = packed.join(places.hint("shuffle_hash"), "chunk")

    def candidates(row: dict) -> tuple[_Work, np.ndarray]:
        w = _Work(chunks.unpacked(row["payload"]), symbols=False)
        return w, np.flatnonzero(np.unpackbits(np.frombuffer(row["places"], np.uint8), count=len(w.hash)))

    def ask_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunks.each(batches):
            w, starts = candidates(row)
            key, first, _ = w.windows(starts)
            rows = np.zeros(len(key), ASK)
            ids = w.batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            ties = w.batch.column("_tie").to_numpy(zero_copy_only=False)
            rows["a"], rows["b"], rows["doc"], rows["tie"], rows["start"] = key["a"], key["b"], ids[w.doc[first]], ties[w.doc[first]], first - w.bounds[w.doc[first]]
            yield from chunks.ask(row["chunk"], key["a"], rows, buckets)

    windows = chunks.answers(placed.mapInArrow(lean(ask_windows), chunks.ASKED), ASK, _windows_first)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunks.each(batches):
            w, starts = candidates(row)
            key, first, number = w.windows(starts)
            keeps = chunks.marked(key["a"], row["answer"], buckets)
            gone = starts[~(keeps[number] & (first[number] == starts))]
            yield _results(w.batch, w.bounds, _covered(gone, len(w.hash)))

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string"
    return placed.join(windows.hint("shuffle_hash"), "chunk", "left").mapInArrow(lean(finish), schema).withColumnsRenamed({new: old for old, new in moved.items() if old.lower() == "_tie"})


def digests(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
k AS (SELECT w.doc_id, u.i, ws[u.i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i) u ANTI JOIN c ON c.doc_id = w.doc_id AND c.i = u.i),
g AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(g.n, 0))::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)
"""

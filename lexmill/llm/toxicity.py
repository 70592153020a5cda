"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Fit: numbers of toxic and other labelled documents with a word or a word's beginning (the first STEM letters of
longer words), in 2**BITS hash cells each, and of all documents as the background. A cell's score is the difference of
its log-odds under Dirichlet priors in proportion to the background; it counts where it is Z standard errors from
zero, a beginning where the word itself doesn't. Every token also costs DRIFT. Scan: the linear-time search for all
maximal segments (every one that can't be lengthened or shortened to score more) over the runs of equal sign. The
scale of the scores (the root of the expected exponential) and the extreme-value constant, fitted on documents that
aren't toxic, turn a segment's score into bits beyond chance; a document's bits, summed over its segments, give
the probability by a logistic fit.

The labelled rows are a sample by hash of at most about ``max_labelled``, which bounds the broadcast; background,
scale and scores cover all documents. Score and scan see texts only.

Defined cases: null and empty texts have no segment and get the score of no evidence; a document with several
labels is toxic if one says so; rows that repeat an id are scored one by one; without any toxic or any other label
every score is 0; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import chunks
from lexmill.llm.common import free_names, lean
from lexmill.session import cut

BITS, STEM, Z, DRIFT, PRIOR = 18, 5, 4.0, 0.05, 0.05
CELLS = 1 << BITS
SLICES = 128
STRIP = ".,;:!?\"'()[]{}<>«»„“”‘’…*_-"
BINS, BIN = 400, 0.25


def cells(words: list[str]) -> np.ndarray:
    """Per word its cell and its beginning's cell (-1: none, for short words or none at all)."""
    out = np.empty((len(words), 2), np.int64)
    for i, w in enumerate(words):
        w = w.strip(STRIP)
        out[i, 0] = zlib.crc32(w.encode()) & (CELLS - 1) if w else -1
        out[i, 1] = CELLS + (zlib.crc32(w[:STEM].encode()) & (CELLS - 1)) if len(w) > STEM else -1
    return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bounds of each text's words in the flat sequence, the words as codes, and the distinct words."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    return np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64), flat.indices.to_numpy(), flat.dictionary.to_pylist()


def _parts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded text."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts in all cells, three rows of totals: background, toxic, other; as slices."""
    sums = np.zeros((3, 2 * CELLS))
    for b in batches:
        for p in _parts(b):
            bounds, codes, words = _words(p.column("text"))
            where = cells(words)
            label = p.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
            once = np.unique(np.repeat(np.arange(p.num_rows), np.diff(bounds)) * max(len(words), 1) + codes)  # a word counts once a document
            of, codes = label[once // max(len(words), 1)], once % max(len(words), 1)
            for row, mask in ((0, slice(None)), (1, of == 1), (2, of == 0)):
                n = np.bincount(codes[mask], minlength=len(words))
                for k in (0, 1):
                    ok = (where[:, k] >= 0) & (n > 0)
                    sums[row] += np.bincount(where[ok, k], n[ok], 2 * CELLS)
    yield chunks.sliced(sums, SLICES)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Scores of all cells, 0 where a cell isn't Z standard errors from zero."""
    score = np.zeros(2 * CELLS)
    for part in (slice(0, CELLS), slice(CELLS, 2 * CELLS)):
        base, yes, no = counts[:, part]
        if not yes.sum() or not no.sum():
            continue
        prior = base / base.sum()
        a, b = yes.sum() * PRIOR * prior, no.sum() * PRIOR * prior
        y, n, ny, nn = yes + a, no + b, yes.sum() * (1 + PRIOR), no.sum() * (1 + PRIOR)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.log(y / (ny - y)) - np.log(n / (nn - n))
            z = d / np.sqrt(1 / y + 1 / n)
        score[part] = np.where(np.isfinite(z) & (np.abs(z) >= Z) & (yes + no >= 5), d, 0)
    return score


def scale_of(score: np.ndarray, base: np.ndarray) -> float:
    """The positive root x of sum p exp(x s) = 1 over the background's word scores."""
    p, s = base[:CELLS] / max(base[:CELLS].sum(), 1), score[:CELLS] - DRIFT
    if not (s[p > 0] > 0).any() or (p * s).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * s, 600))).sum() > 1 else (mid, hi)
    return lo


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Runs of equal sign are joined first; a stack holds candidates with the sums before and after them.
    """
    up = score > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(up)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(score)]])
    sums = np.concatenate([[0.0], np.cumsum(score)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for a, b in zip(starts[up[starts]].tolist(), ends[up[starts]].tolist(), strict=True):
        left, right = float(sums[a]), float(sums[b])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                # what lies between can't join anything later only if it is below; it stays as it is
                stack.append((a, b, left, right))
                break
            a, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - lo) for a, b, lo, r in stack]


@dataclass
class Model:
    score: np.ndarray
    scale: float = 1.0
    constant: float = 0.1
    slope: float = 0.0
    intercept: float = -20.0

    def token_scores(self, words: list[str]) -> np.ndarray:
        where = cells(words)
        own = np.where(where[:, 0] >= 0, self.score[where[:, 0]], 0)
        stem = np.where(where[:, 1] >= 0, self.score[where[:, 1]], 0)
        return np.where(own != 0, own, stem) - DRIFT

    def spans(self, batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Per row its number of words and its maximal segments."""
        for p in _parts(batch):
            bounds, codes, words = _words(p.column("text"))
            s = self.token_scores(words)[codes] if len(codes) else np.zeros(0)
            risen = np.concatenate([[0], np.cumsum(s > 0)])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield b - a, segments(s[a:b]) if risen[b] > risen[a] else []

    def bits(self, n: int, found: Iterable[float]) -> float:
        """What a document's segments score beyond chance, in units of the scale."""
        chance = math.log(max(self.constant * max(n, 1), 1e-9))
        return sum(max(0.0, self.scale * x - max(chance, 0.0)) for x in found)

    def probability(self, bits: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * math.log1p(bits) + self.intercept))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit with a small ridge."""
    at, ridge = np.zeros(2), np.diag([1e-3, 1e-3])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        gradient = design.T @ (w * (y - p)) - ridge @ at
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge, gradient)
        at += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 60_000) -> Model:
    """Fit on documents whose label may be learned; only tables of a fixed size reach the driver."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = usable.count()
    share = min(1.0, max_labelled / max(n, 1))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")  # at most about max_labelled rows of two numbers
    counts = chunks.totals(known.select("text", "label").mapInArrow(lean(_count), chunks.SLICED), (3, 2 * CELLS), SLICES)
    model = Model(log_odds(counts))
    model.scale = scale_of(model.score, counts[0])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, [x for *_, x in found]) for n, found in shared.value.spans(b)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["label", "n", "found"])

    shared = docs.sparkSession.sparkContext.broadcast(model)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")
    scanned = cut(labelled.mapInArrow(lean(scan), "label int, n long, found array<double>"))
    chance = scanned.filter("label = 0").agg(F.count("*").alias("k"), F.sum(F.col("n") * F.exp(F.lit(-model.scale) * F.coalesce(F.array_max("found"), F.lit(0.0)))).alias("e")).first()
    if chance.k and chance.e:
        model.constant = float(chance.k / chance.e)
    limit = F.greatest(F.log(F.greatest(F.lit(model.constant) * F.greatest("n", F.lit(1)), F.lit(1e-9))), F.lit(0.0))
    bits = F.aggregate(F.transform("found", lambda x: F.greatest(F.lit(0.0), x * model.scale - limit)), F.lit(0.0), lambda a, x: a + x)
    bins = scanned.select("label", F.least(F.floor(F.log1p(bits) / BIN), F.lit(BINS)).alias("bin")).groupBy("label", "bin").count().collect()
    if len({r["label"] for r in bins}) == 2:
        x = np.array([r["bin"] for r in bins]) * BIN + BIN / 2 * np.array([r["bin"] > 0 for r in bins])
        model.slope, model.intercept = _logistic(x, np.array([float(r["label"]) for r in bins]), np.array([float(r["count"]) for r in bins]))
    return model


MADE = ("toxicity", "toxic_spans")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with toxicity (the probability) and toxic_spans (first and last word, bits) added.

    Null texts are scored as empty ones. Columns of ``docs`` with a name of MADE get ``_input`` appended.
    """
    docs, _ = free_names(docs, (*MADE, "toxicity_made"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<p double, spans array<struct<start:long,stop:long,bits:double>>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        m, p, spans = shared.value, [], []
        for n, found in m.spans(pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])):
            p.append(m.probability(m.bits(n, (x for *_, x in found))))
            spans.append([{"start": a, "stop": b, "bits": v} for a, b, x in found if (v := m.bits(n, [x])) > 0])
        return pd.DataFrame({"p": p, "spans": spans})

    made = docs.withColumn("toxicity_made", scored("text"))
    return made.withColumn("toxicity", F.col("toxicity_made.p")).withColumn("toxic_spans", F.col("toxicity_made.spans")).drop("toxicity_made")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_spans of every row of ``docs``."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_spans")

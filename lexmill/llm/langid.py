"""Language identification by rank-order profiles of character n-grams.

A text's words (runs of letters, in lower case) are set between blanks; its n-grams are stretches of one to three
characters inside a word and the blanks beside it. A profile is the PROFILE most frequent n-grams in order. The distance
of a text from a language is out of place: for each n-gram of the text's profile how far its rank there is from its rank
in the language's, or PROFILE if that has it not. The nearest language is predicted, ties by name; the score is one less
the share of the greatest possible distance.

N-grams are numbers: three code points of 21 bits, so they are exact. Ties in frequency go by that number. Counts cover
all labelled documents: tasks count their own, and are summed over all of them by language and n-gram. Profiles are a few
hundred rows a language; they go to tasks in parts of LANGUAGES languages, each part a pass over the texts.

Defined cases: null texts, and texts without a letter, are ``und`` with score 0, as is every text where nothing could
be learned; null languages teach nothing; rows are scored one by one; columns whose names clash with those made are moved
aside; an empty table gives an empty one. Texts of any length are read in slices.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.common import free_names, lean

MADE = ("lang_pred", "score")
#: N-grams of a profile; languages of a pass; characters read at once; different n-grams that a task holds before it sends them on.
PROFILE, LANGUAGES, SLICE, HELD = 400, 500, 1 << 18, 1 << 21
BLANK, BITS = 1, 21

_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a worker."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letter[0]


def _slices(text: str) -> Iterator[np.ndarray]:
    """A text as code points: letters in lower case, one blank before, between and after its words. Pieces overlap by
    the two that n-grams reach back."""
    is_letter = letters()
    last = np.array([BLANK], np.int64)
    for at in range(0, len(text), SLICE):
        # the one letter whose lower case depends on its place gets one form
        low = text[at : at + SLICE].replace("Σ", "σ").lower()
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.concatenate([last, np.where(is_letter[codes], codes, BLANK)])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
        keep[: len(last)] = True
        codes = codes[keep]
        yield codes
        last = codes[-2:]
    if last[-1] != BLANK:
        yield np.append(last, BLANK)


def _grams(codes: np.ndarray, back: int) -> np.ndarray:
    """The n-grams that end after the first ``back`` code points."""
    one = codes[back:]
    two = (codes[max(back - 1, 0) : -1] << BITS) | codes[max(back, 1) :]
    begin = max(back - 2, 0)
    mid = codes[begin + 1 : -1]
    three = ((codes[begin:-2] << 2 * BITS) | (mid << BITS) | codes[begin + 2 :])[mid != BLANK]
    return np.concatenate([one[one != BLANK], two, three])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, ascending, and how often each occurs."""
    parts = []
    back = 1
    for codes in _slices(text):
        if len(codes) > back:
            parts.append(np.unique(_grams(codes, back), return_counts=True))
        back = min(2, len(codes))
    return _summed(parts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(grams), np.int64)
    np.add.at(n, at, np.concatenate([p[1] for p in parts]))
    return grams, n


def ranked(grams: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The profile: the most frequent n-grams in order."""
    return grams[np.argsort(-n, kind="stable")[:size]]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram and n of a task's labelled texts."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            grams, n = _summed(held.pop(lang))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
        sizes.clear()

    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            lang, (grams, n) = lang.as_py(), counted(text.as_py() or "")
            held.setdefault(lang, []).append((grams, n))
            sizes[lang] = sizes.get(lang, 0) + len(grams)
            if sizes[lang] >= HELD:
                held[lang] = [_summed(held[lang])]
                sizes[lang] = len(held[lang][0][0])
            if sum(sizes.values()) >= 2 * HELD:
                for k in held:
                    held[k] = [_summed(held[k])]
                    sizes[k] = len(held[k][0][0])
                if sum(sizes.values()) >= HELD:
                    yield from sent()
    yield from sent()


@dataclass
class Profiles:
    """Languages in order of their names, and the rank of each n-gram that one of them has (``size`` where it has not)."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @staticmethod
    def of(rows: list[tuple[str, int, int]], size: int) -> Profiles:
        languages = sorted({r[0] for r in rows})
        grams = np.unique(np.array([r[1] for r in rows], np.int64))
        ranks = np.full((len(languages), len(grams) + 1), size, np.int64)
        place = {lang: i for i, lang in enumerate(languages)}
        for lang, gram, rank in rows:
            ranks[place[lang], np.searchsorted(grams, gram)] = rank
        return Profiles(languages, grams, ranks, size)

    def nearest(self, text: str) -> tuple[str | None, float]:
        """The nearest language and the distance as a share of the greatest possible one; none without letters."""
        own = ranked(*counted(text), self.size)
        if not len(own) or not self.languages:
            return None, 1.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.ranks[:, np.where(self.grams[at] == own, at, len(self.grams))]
        far = np.where(known < self.size, np.abs(known - np.arange(len(own))), self.size).sum(axis=1)
        best = int(far.argmin())
        return self.languages[best], int(far[best]) / (len(own) * self.size)


def profiles(labelled: DataFrame, size: int = PROFILE) -> list[Profiles]:
    """The profiles of all languages of ``labelled(lang, text)``, in parts of LANGUAGES languages."""
    counts = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(lean(_count), "lang string, gram long, n long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # each partition keeps its first rows of a language before they meet
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))
    rows = sorted(map(tuple, top.collect()))
    names = sorted({r[0] for r in rows})
    parts = [set(names[i : i + LANGUAGES]) for i in range(0, len(names), LANGUAGES)]
    return [Profiles.of([r for r in rows if r[0] in part], size) for part in parts]


def identify(docs: DataFrame, learned: list[Profiles]) -> DataFrame:
    """``docs(text, ...)`` with lang_pred and score."""
    own, moved = free_names(docs, (*MADE, "_far"))
    text, columns = moved.get("text", "text"), own.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def told(part: Profiles):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pred, far = b.column("lang_pred").to_pylist(), b.column("_far").to_pylist()
                for i, value in enumerate(b.column(text)):
                    name, d = part.nearest(value.as_py() or "")
                    if name is not None and (pred[i] is None or (d, name) < (far[i], pred[i])):
                        pred[i], far[i] = name, d
                made = [pa.array(pred, pa.string()), pa.array(far, pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + made, names=[*columns, "lang_pred", "_far"])

        return run

    out = own.withColumn("lang_pred", F.lit(None).cast("string")).withColumn("_far", F.lit(1.0))
    for part in learned:
        out = out.mapInArrow(lean(told(part)), f"{schema}, lang_pred string, _far double")
    return out.select(*columns, F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(F.col("lang_pred").isNull(), 0.0).otherwise(1 - F.col("_far")).alias("score"))


def held_out(folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept from learning; one without an id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the others than those held out."""
    learned = profiles(docs.filter(~held_out()).select("lang", "text"))
    return identify(docs.select("doc_id", "text"), learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

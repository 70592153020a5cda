"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct n-grams, as 64-bit hashes. One order of all n-grams, rare ones first (by counts of
all documents in 2**BITS cells, then by hash), is cut into fragments by hash. Documents with equal sets form a class
and go on as one.

Candidates. A set of PIECE n-grams or more is cut by hash into as many pieces as its size has doublings above that; two
sets of Jaccard similarity s have it, or more, in at least one piece, since overlaps and sizes both add up over pieces.
Within a piece such sets share an n-gram among the first few of each, so these beginnings go to their fragments and
meet there, and the first one shared lies so early that each set has enough n-grams left; places, sizes and parity
sketches of the pieces drop nearly all other meetings. Larger sets take part in the pieces of every size they can link
with, so a pair meets in those of the smaller set.

Decision. For the pairs left the sets are cut at the fragments, every fragment counts its part of a pair's overlap, and
the parts are summed per pair.

A group around an n-gram first tries its documents against one member and their neighbours in size. After that a join
tries every other pair of a group that places, sizes and sketches leave possible, and returns every link. Where only
the components are asked for, it tries just the pairs that verified links leave in different components: components
stay exact, links inside one may be missing, and a group of near copies doesn't become all its pairs. Large groups are
dealt over tasks by pairs of salts, GROUP rows or so a salt.

Defined cases: null and empty texts and texts without words have no set and link with nothing; a text of fewer words
than n has one n-gram, the whole; rows that repeat a doc_id share its links, each with its own set; rows with a null
doc_id link with nothing and have no component; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import chunks
from lexmill.llm.chunks import mix
from lexmill.llm.common import lean
from lexmill.llm.components import components
from lexmill.session import cut, scratch, tidy

BITS, SLICES, CUTS, SPREAD = 18, 64, 4, 8
#: Sets of less than twice as many n-grams are one piece; rows of a group that one task compares with each other.
PIECE, GROUP = 256, 1024
#: Sets with more rows than HOT are looked up in SALTS tasks.
HOT, SALTS = 256, 64
#: Bits of a piece's parity sketch, and 64-bit words of its short form: two pieces differ in at least as many n-grams as
#: their sketches, or short forms, in bits.
SKETCH, FOLD = 1024, 8
WORDS = SKETCH // 64
#: An n-gram of a piece's beginning as it is sent: its place in the order, the document, the sizes of its set and of the
#: piece, its place in the piece, the piece (2**level + number).
SENT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("size", "<u4"), ("own", "<u4"), ("at", "<u4"), ("part", "<u4")])
FIELDS = ("doc", "size", "own", "at", "part")
#: What deals the rows of groups over tasks: the n-gram and two salts; rows that a task holds before it pairs them.
DEALT, HELD = ("key", "lo", "hi"), 1 << 16


def sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the distinct n-grams of a batch's documents, sorted by row and hash."""
    bounds, codes, distinct = chunks.words(batch.column("text"), lower=True)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = chunks.hashes(distinct)[codes, 0]
    length = np.diff(bounds)
    doc = np.repeat(np.arange(batch.num_rows), length)
    # each word with the n - 1 that follow it in its document; short texts as a whole
    rows, gram = doc[: len(h) - n + 1], np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        gram = mix(gram * np.uint64(5) + h[j : j + len(gram)])
    inside = rows == doc[n - 1 :]
    rows, gram = rows[inside], gram[inside]
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = length[short] > j
            more[has] = mix(more[has] * np.uint64(5) + h[bounds[short[has]] + j])
        rows, gram = np.concatenate([rows, short]), np.concatenate([gram, mix(more + np.uint64(1))])
    order = chunks.order_by(rows, gram)
    rows, gram = rows[order], gram[order]
    fresh = np.concatenate([[True], (rows[1:] != rows[:-1]) | (gram[1:] != gram[:-1])])
    return rows[fresh], gram[fresh]


def _cell(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - BITS)).astype(np.int64)


def _ordered(rows: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets in the order of all n-grams; its keys hold the rank of the n-gram's cell, then its hash."""
    key = rank[_cell(gram)] << np.uint64(56) | gram >> np.uint64(8)
    order = chunks.order_by(rows, key)
    return rows[order], key[order]


def _hash_of(key: np.ndarray) -> np.ndarray:
    return key << np.uint64(8)


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a.astype(np.int64) + b.astype(np.int64)) // (100 + percent))


def _level(size: np.ndarray) -> np.ndarray:
    """Doublings of a set's size above PIECE; its pieces are 2**level."""
    return np.maximum(np.frexp(size / PIECE)[1] - 1, 0).astype(np.int64)


def pieces(rows: np.ndarray, gram: np.ndarray, n: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each n-gram's place in the input and its piece, level after level; larger sets come with each level that a set
    they can link with may have."""
    size = np.bincount(rows, minlength=n)
    high, low = _level(size), _level(-(-percent * size // 100))
    for back in range(int((high - low).max(initial=0)) + 1):
        level = high - back
        use = np.flatnonzero((level >= low)[rows])
        at = level[rows[use]].astype(np.uint64)
        yield use, (np.uint64(1) << at) + np.where(at > 0, gram[use] >> (np.uint64(64) - np.maximum(at, np.uint64(1))), np.uint64(0))


def _may_link(rows: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair of sent n-grams can be the first that the pieces of a link share, in pieces of the smaller set's level."""
    a, b = rows["size"][x].astype(np.int64), rows["size"][y].astype(np.int64)
    own_a, own_b = rows["own"][x].astype(np.int64), rows["own"][y].astype(np.int64)
    left = np.minimum(own_a - rows["at"][x], own_b - rows["at"][y])
    level = np.frexp(rows["part"][x].astype(float))[1] - 1
    fits = (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (_level(np.minimum(a, b)) == level)
    return (rows["doc"][x] != rows["doc"][y]) & fits & (left >= _needed(own_a, own_b, percent))


def _sketches(unit: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """Parity sketches of ``n`` units, WORDS numbers each; ``unit`` ascending."""
    out = np.zeros((n, WORDS), np.int64)
    for lo in range(0, n, 1024):
        a, b = np.searchsorted(unit, [lo, min(lo + 1024, n)])
        m = min(1024, n - lo)
        odd = np.bincount((unit[a:b] - lo) * SKETCH + (gram[a:b] % np.uint64(SKETCH)).astype(np.int64), minlength=m * SKETCH).astype(np.uint8) & 1
        out[lo : lo + m] = np.packbits(odd).view(np.int64).reshape(m, WORDS)
    return out


def _piece_sketches(rows: np.ndarray, gram: np.ndarray, n: int, percent: int) -> pa.Array:
    """For each of ``n`` rows the sketches of its pieces, one after the other, each behind the piece's number; ``gram`` ascending in each row."""
    of, parts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, WORDS), np.int64)]
    for use, part in pieces(rows, gram, n, percent):
        if len(use):
            fresh = np.concatenate([[True], (rows[use][1:] != rows[use][:-1]) | (part[1:] != part[:-1])])
            unit = np.cumsum(fresh) - 1
            of.append(rows[use][fresh])
            parts.append(part[fresh].astype(np.int64))
            found.append(_sketches(unit, gram[use], int(unit[-1]) + 1))
    doc = np.concatenate(of)
    order = np.argsort(doc, kind="stable")
    flat = np.concatenate([np.concatenate(parts)[:, None], np.concatenate(found)], axis=1)[order]
    ends = np.searchsorted(doc[order], np.arange(n + 1)) * (WORDS + 1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.reshape(-1)))


def _meet(rows: np.ndarray, percent: int) -> np.ndarray:
    """Pairs to try first in one bucket of sent n-grams: each row with its group's smallest document and with the next in size."""
    rows = rows[np.lexsort((rows["doc"], rows["size"], rows["key"]))]
    fresh = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])
    starts = np.flatnonzero(fresh)
    leader = np.repeat(np.lexsort((rows["doc"], rows["key"]))[starts], np.diff(np.concatenate([starts, [len(rows)]])))
    next_to = np.flatnonzero(~fresh)
    found = []
    for x, y in ((np.arange(len(rows)), leader), (next_to - 1, next_to)):
        ok = _may_link(rows, x, y, percent)
        found.append(_as_pairs(rows, x[ok], y[ok]))
    return np.unique(np.concatenate(found), axis=0)


def _useful(rows: np.ndarray, percent: int) -> np.ndarray:
    """The rows of groups of three and more (two have met already) that some partner of their group's sizes could link."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    starts = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    n = np.diff(np.concatenate([starts, [len(rows)]]))
    own = rows["own"].astype(np.int64)
    least = np.maximum(np.repeat(np.minimum.reduceat(own, starts), n), -(-percent * own // 100))
    return rows[(np.repeat(n, n) > 2) & (own - rows["at"] >= _needed(own, least, percent))]


def _meet_others(table: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of the rows (of DEALT, FIELDS, label, salt, fold) of each group, of one salt or of two, whose documents have
    different labels and whose short sketches don't show that they differ too much."""
    n = len(DEALT) + len(FIELDS)
    doc, size = table[:, len(DEALT)], table[:, len(DEALT) + 1]
    group = np.cumsum(np.concatenate([[False], (table[1:, : len(DEALT)] != table[:-1, : len(DEALT)]).any(axis=1)]))
    table = table[np.lexsort((doc, size, group))]
    rows = np.zeros(len(table), SENT)
    for i, f in enumerate(FIELDS):
        rows[f] = table[:, len(DEALT) + i]
    label, salt, fold, within = table[:, n], table[:, n + 1], table[:, n + 2 :].view(np.uint64), table[:, 1] == table[:, 2]
    size, own = rows["size"].astype(np.int64), rows["own"].astype(np.int64)
    found, x, step = [np.zeros((0, 7), np.int64)], np.arange(len(rows)), 0
    while len(x):  # each row with the first, second, ... after it, as long as that is in its group and small enough
        step += 1
        x = x[x + step < len(rows)]
        y = x + step
        on = (group[y] == group[x]) & (size[x] * 100 >= size[y] * percent)
        x, y = x[on], y[on]
        try_ = (label[y] != label[x]) & (within[x] | (salt[y] != salt[x]))
        i, j = x[try_], y[try_]
        may = _may_link(rows, i, j, percent)
        i, j = i[may], j[may]
        # unsigned, as of a negative number numpy counts the bits of its absolute value
        close = np.bitwise_count(fold[i] ^ fold[j]).sum(axis=1) <= own[i] + own[j] - 2 * _needed(own[i], own[j], percent)
        found.append(_as_pairs(rows, i[close], j[close]))
    return np.unique(np.concatenate(found), axis=0)


def _as_pairs(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """a, b, size_a, size_b, own_a, own_b, part; a < b."""
    columns = (rows[f][i] for f in ("doc", "size", "own") for i in (x, y))
    pairs = np.stack([*columns, rows["part"][x]], 1).astype(np.int64).reshape(-1, 7)
    swap = pairs[:, 0] > pairs[:, 1]
    pairs[swap] = pairs[swap][:, [1, 0, 3, 2, 5, 4, 6]]
    return pairs


class Join:
    """The steps of a join over one table; ``classes`` and ``links`` give its result."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.n, self.percent = n, percent
        self.packed = chunks.pack(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")))
        self.parts = chunks.partitions(docs)
        self.buckets = self.parts * chunks.PER_PARTITION

    def rank(self) -> np.ndarray:
        """A rank per cell of n-grams, higher for those in more documents; 2**BITS numbers whatever the corpus."""
        n = self.n

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(1 << BITS)
            for row in chunks.each(batches):
                sums += np.bincount(_cell(sets(chunks.unpacked(row["payload"]), n)[1]), minlength=1 << BITS)
            yield chunks.sliced(sums, SLICES)

        counts = chunks.totals(self.packed.mapInArrow(lean(count), chunks.SLICED), (1 << BITS,), SLICES)
        return np.clip(np.floor(4 * np.log2((counts + 1) / (counts.mean() + 1))), 0, 255).astype(np.uint64)

    def digests(self) -> DataFrame:
        """chunk, row, doc_id, mark (of the text), n_shingles, name (of the set; null without one) and sketch of every row."""
        n, percent = self.n, self.percent

        def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in chunks.each(batches):
                batch = chunks.unpacked(row["payload"])
                rows, gram = sets(batch, n)
                bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                names = [xxhash.xxh3_128_digest(gram[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(batch.num_rows, row["chunk"])),
                        pa.array(np.arange(batch.num_rows)),
                        batch.column("doc_id"),
                        batch.column("mark"),
                        pa.array(np.diff(bounds)),
                        pa.array(names, pa.binary()),
                        _piece_sketches(rows, gram, batch.num_rows, percent),
                    ],
                    names=["chunk", "row", "doc_id", "mark", "n_shingles", "name", "sketch"],
                )

        return cut(self.packed.mapInArrow(lean(digest), "chunk long, row long, doc_id long, mark long, n_shingles long, name binary, sketch array<long>"))

    def classes(self, digests: DataFrame) -> DataFrame:
        """chunk, row, doc_id, mark, n_shingles, class_id (smallest doc_id with the same set; null without a set) of every row."""
        every = digests.drop("sketch")
        several = every.filter("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").withColumnRenamed("name", "of")
        # names of many rows are met in SALTS tasks, not in one; what needs no partner gets a key of its own
        salt = F.pmod(F.xxhash64("chunk", "row"), F.lit(SALTS))
        hot = several.filter(F.col("n") > HOT).select(F.col("of").alias("hot"), F.col("least").alias("hot_least"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        alone = F.concat(F.lit("-"), F.hex("chunk"), F.lit("-"), F.hex("row")).cast("binary")
        found = every.withColumn("at", salt).withColumn("key", F.coalesce("name", alone))
        found = found.join(hot, (F.col("key") == F.col("hot")) & (F.col("at") == F.col("salt")), "left")
        found = found.withColumn("key", F.when(F.col("hot").isNotNull(), alone).otherwise(F.col("key")))
        found = found.join(several.filter(F.col("n") <= HOT), F.col("key") == F.col("of"), "left")
        own = F.when(F.col("name").isNotNull(), F.coalesce("hot_least", F.when(F.col("n") > 1, F.col("least")).otherwise(F.col("doc_id"))))
        return cut(found.select("chunk", "row", "doc_id", "mark", "n_shingles", own.alias("class_id")))

    def sketches(self, digests: DataFrame) -> DataFrame:
        """doc_id, part and sketch (WORDS numbers) of the pieces of every set."""
        step = WORDS + 1
        entry = lambda i: F.struct(F.element_at("sketch", i * step + 1).alias("part"), F.slice("sketch", i * step + 2, WORDS).alias("sketch"))
        each = F.transform(F.sequence(F.lit(0), (F.size("sketch") / step).cast("int") - 1), entry)
        return digests.filter("doc_id IS NOT NULL AND size(sketch) > 0").select("doc_id", F.explode(each).alias("p")).select("doc_id", "p.part", "p.sketch")

    def sent(self, members: DataFrame, rank: np.ndarray) -> DataFrame:
        """Beginnings of the pieces of the sets of ``members(chunk, row)``, as messages to the fragments, written in their order."""
        n, percent, buckets = self.n, self.percent, self.buckets
        shared = members.sparkSession.sparkContext.broadcast(rank)
        rows = members.groupBy("chunk").agg(F.collect_list("row").alias("members"))  # rows of one chunk

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in chunks.each(batches):
                batch = chunks.unpacked(row["payload"])
                picked = np.zeros(batch.num_rows, bool)
                picked[row["members"]] = True
                rows, key = _ordered(*sets(batch, n), shared.value)
                size = np.bincount(rows, minlength=batch.num_rows)
                ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                found = [np.zeros(0, SENT)]
                for use, part in pieces(rows, _hash_of(key), batch.num_rows, percent):
                    unit = rows[use] << 32 | part.astype(np.int64)
                    if (unit[1:] < unit[:-1]).any():  # in the order of all n-grams inside each piece
                        order = np.argsort(unit, kind="stable")
                        use, unit = use[order], unit[order]
                    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
                    length = np.diff(np.concatenate([starts, [len(unit)]])).astype(np.int64)
                    own, at = np.repeat(length, length), np.arange(len(unit)) - np.repeat(starts, length)
                    first = (at <= own - -(-percent * own // 100)) & picked[rows[use]]
                    out = np.zeros(int(first.sum()), SENT)
                    use, unit = use[first], unit[first]
                    out["part"] = unit & 0xFFFFFFFF
                    out["key"] = key[use] ^ (np.frexp(out["part"].astype(float))[1] - 1).astype(np.uint64)  # levels don't meet
                    out["doc"], out["size"], out["own"], out["at"] = ids[rows[use]], size[rows[use]], own[first], at[first]
                    found.append(out)
                out = np.concatenate(found)
                out = out[np.argsort(out["key"], kind="stable")]
                yield from chunks.ask(row["chunk"], _hash_of(out["key"]), out, buckets)

        asked = self.packed.join(rows.hint("shuffle_hash"), "chunk").mapInArrow(lean(send), chunks.ASKED)
        return cut(asked.repartition(self.parts, "bucket").sortWithinPartitions("bucket"))

    def pairs(self, sent: DataFrame) -> DataFrame:
        """The first pairs that meet in the fragments."""
        percent = self.percent

        def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _buckets(batches):
                yield _pairs(_meet(rows, percent))

        return sent.mapInArrow(lean(meet), PAIRS).distinct()

    def other_pairs(self, sent: DataFrame, groups: DataFrame | None, sketches: DataFrame) -> DataFrame:
        """All pairs that meet and, with ``groups(id, component_id)``, are in different components.

        Rows carry their piece's sketch, folded to FOLD words, so that only pairs that may link leave a group.
        """
        percent = self.percent

        def useful(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _buckets(batches):
                rows = _useful(rows, percent)
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"].view(np.int64)), *(pa.array(rows[f].astype(np.int64)) for f in FIELDS)], names=["key", *FIELDS])

        rows = sent.mapInArrow(lean(useful), "key long, " + ", ".join(f"{f} long" for f in FIELDS))
        if groups is None:
            rows = rows.withColumn("label", F.col("doc"))
        else:
            rows = rows.join(groups, F.col("doc") == F.col("id"), "left").withColumn("label", F.coalesce("component_id", "doc")).drop("id", "component_id")
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / GROUP).alias("salts")).filter("low < high").select("key", "salts")
        folded = F.array(*(reduce(Column.bitwiseXOR, [F.col("sketch")[i] for i in range(k, WORDS, FOLD)]) for k in range(FOLD)))
        rows = rows.join(mixed, "key").join(sketches.select(F.col("doc_id").alias("doc"), "part", folded.alias("fold")), ["doc", "part"])
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")))
        other = F.when(F.col("salts") > 1, F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array("salt"))
        rows = rows.withColumn("_t", F.explode(other)).withColumn("lo", F.least("salt", "_t")).withColumn("hi", F.greatest("salt", "_t"))
        columns = (*DEALT, *FIELDS, "label", "salt")
        rows = rows.select(*columns, "fold").repartition(self.parts, *DEALT).sortWithinPartitions(*DEALT)

        def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for b in batches:
                own = np.stack([b.column(c).to_numpy() for c in columns], 1)
                held.append(np.concatenate([own, b.column("fold").flatten().to_numpy().reshape(-1, FOLD)], 1))
                if sum(map(len, held)) >= HELD:  # all groups but the last are complete
                    table = np.concatenate(held)
                    last = int(np.argmax((table[:, : len(DEALT)] == table[-1, : len(DEALT)]).all(axis=1)))
                    yield _pairs(_meet_others(table[:last], percent))
                    held = [table[last:]]
            if held:
                yield _pairs(_meet_others(np.concatenate(held), percent))

        return rows.mapInArrow(lean(others), PAIRS).distinct()

    def likely(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs whose pieces' sketches don't already show that they differ too much: a, b, size_a, size_b."""
        sketch = lambda side: sketches.select(F.col("doc_id").alias(side), "part", F.col("sketch").alias(f"sketch_{side}"))
        apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = F.col("own_a") + F.col("own_b")
        allowed = both - 2 * F.ceil(both * self.percent / (100 + self.percent))
        return cut(pairs.join(sketch("a"), ["a", "part"]).join(sketch("b"), ["b", "part"]).filter(apart <= allowed).select("a", "b", "size_a", "size_b").distinct())

    def verified(self, pairs: DataFrame, members: DataFrame, rank: np.ndarray) -> DataFrame:
        """a and b of the pairs that link: overlaps counted per fragment and summed per pair.

        Pairs are dealt over blocks by their first document and a salt, so one document with many partners is
        spread; each block gets the parts of its own documents' sets, once.
        """
        n, percent = self.n, self.percent
        shared = pairs.sparkSession.sparkContext.broadcast(rank)
        block = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(SPREAD))), F.lit(self.buckets)).cast("int")
        dealt = pairs.withColumn("block", block)
        wanted = dealt.select("block", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        wanted = wanted.join(members.select("chunk", "row", "doc_id"), "doc_id").groupBy("chunk").agg(F.collect_list(F.struct("row", "block")).alias("wanted"))  # of the rows of one chunk

        def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in chunks.each(batches):
                batch = chunks.unpacked(row["payload"])
                want = sorted((w["row"], w["block"]) for w in row["wanted"])
                some = np.unique([r for r, _ in want])
                rows, key = _ordered(*sets(batch.take(pa.array(some)), n), shared.value)
                cut_of = (_hash_of(key) >> np.uint64(48)) * np.uint64(CUTS) >> np.uint64(16)
                at = np.searchsorted(rows, np.arange(len(some) + 1))
                where, ids = {r: i for i, r in enumerate(some.tolist())}, batch.column("doc_id").to_pylist()
                out: dict[str, list] = {"cut": [], "block": [], "a": [], "b": [], "part": []}
                for r, blk in want:
                    i = where[r]
                    own, cuts = key[at[i] : at[i + 1]], cut_of[at[i] : at[i + 1]]
                    for c in range(CUTS):
                        out["cut"].append(c)
                        out["block"].append(blk)
                        out["a"].append(ids[r])
                        out["b"].append(None)
                        out["part"].append(np.sort(own[cuts == c]).tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("cut", pa.int32()), ("block", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.binary())]))

        schema = "cut int, block int, a long, b long, part binary"
        segments = self.packed.join(wanted.hint("shuffle_hash"), "chunk").mapInArrow(lean(parts), schema)
        asked = dealt.select(F.explode(F.array(*(F.lit(c) for c in range(CUTS)))).alias("cut"), "block", "a", "b", F.lit(None).cast("binary").alias("part"))
        # a block's parts come before its pairs
        met = segments.union(asked).repartition(self.parts, "cut", "block").sortWithinPartitions("cut", "block", F.col("b").asc_nulls_first(), "a")

        def overlap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, {}
            for b in batches:
                found = []
                for c, blk, x, y, part in zip(*(b.column(k).to_pylist() for k in ("cut", "block", "a", "b", "part")), strict=True):
                    if (c, blk) != now:
                        now, held = (c, blk), {}
                    if y is None:
                        held.setdefault(x, []).append(np.frombuffer(part, np.uint64))
                    else:  # rows that repeat an id: the closest two count
                        found.append((x, y, max((len(p) + len(q) - len(np.unique(np.concatenate([p, q]))) for p in held.get(x, ()) for q in held.get(y, ())), default=0)))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["a", "b", "shared"])

        sums = met.mapInArrow(lean(overlap), "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        linked = sums.join(pairs, ["a", "b"]).filter(F.col("shared") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * percent)
        return linked.select("a", "b").distinct()


PAIRS = "a long, b long, size_a long, size_b long, own_a long, own_b long, part long"


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The sent n-grams of one bucket after the other."""
    held, now = [], None
    for b in batches:
        for own, raw in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist(), strict=True):
            if own != now and held:
                yield np.concatenate(held)
                held = []
            now = own
            held.append(chunks.decoded(raw, SENT))
    if held:
        yield np.concatenate(held)


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    names = PAIRS.replace(" long", "").split(", ")
    return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(len(names))], names=names)


def join(docs: DataFrame, n: int = 5, percent: int = 80, every_link: bool = True) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets with their component, and the verified links between class representatives.

    Returns ``doc_id, mark, n_shingles, class_id, component_id`` per row of ``docs(doc_id, text)`` (mark is Spark's
    xxhash64 of the text, to tell rows that repeat an id apart) and ``a, b`` per link, a < b. Components are exact;
    without ``every_link`` only those links inside a component are found that are needed to know it.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        work = Join(docs, n, percent)
        rank = work.rank()
        digests = work.digests()
        tidy(spark)
        every, sketches = keep(work.classes(digests)), work.sketches(digests)
        members = every.filter("class_id = doc_id").select("chunk", "row", "doc_id")
        sent = work.sent(members, rank)
        tidy(spark)
        tried = work.likely(work.pairs(sent), sketches)
        tidy(spark)
        links = cut(work.verified(tried, members, rank))
        tidy(spark)
        groups = None if every_link else components(links)
        others = work.other_pairs(sent, groups, sketches).join(tried.select("a", "b"), ["a", "b"], "left_anti")
        more = work.likely(others, sketches)
        del others, groups  # their shuffles go with them
        tidy(spark)
        links = keep(cut(links.union(work.verified(more, members, rank)).distinct()))
        tidy(spark)
        groups = keep(cut(components(links)))
    out = every.join(groups, every.class_id == groups.id, "left")
    return out.select("doc_id", "mark", "n_shingles", "class_id", F.coalesce("component_id", "class_id", "doc_id").alias("component_id")), links


def link_counts(classes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id and n_links, the other documents it links with, of every row of a join with every link.

    Documents of the same class link with each other. Meant for doc_ids that don't repeat; a null one links with nothing.
    """
    size = classes.filter("doc_id IS NOT NULL AND class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("size"))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(size, F.col("b") == F.col("class_id")).groupBy("a").agg(F.sum("size").alias("others"))
    per_class = size.join(linked, F.col("class_id") == F.col("a"), "left").select("class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    n = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links")
    return classes.join(per_class, "class_id", "left").select("doc_id", n)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
c AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT e.* FROM e SEMI JOIN c USING (g)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9 GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * i >= 90 * (na + nb - i)),
r(id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, (SELECT min(reach) FROM r WHERE r.id = s.doc_id) AS component_id FROM s
"""

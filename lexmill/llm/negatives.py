"""Hard negatives by a full sort of each anchor's scores.

Components become integers, floor(scale * x), so a score, the inner product with the anchor, is exact. Rows are dealt to
runs that fit a task; the anchors stream past each run twice. First the best rows of the anchor's own label are found,
its positives. Then all scores of a run are put in order by ``lexsort`` (score, then id), each positive's upper limit is
found by binary search, and the entries of other labels are read from there down to its lower limit. What the runs give
for an anchor is merged in the same order.

Defined cases: rows without an id, label or vector, or with a null or non-finite component, take no part, nor do vectors
of different length together; an empty vector scores 0. Rows that repeat an id are rows of their own, an anchor's too.
Ties go by the smaller id. Other columns don't matter. An empty table gives no rows. Scores that a long can't hold are
an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.common import lean
from lexmill.session import cut

#: Bytes of the vectors of a run, which a task holds, and its rows at least; rows and bytes of a block at most; anchors scored at once.
RUN_BYTES, LEAST_RUN, BLOCK, BLOCK_BYTES, AT_ONCE = 64 << 20, 2048, 4096, 4 << 20, 16
BLOCKS = "slot int, side int, dim int, rows binary, ids binary, vectors binary, labels array<string>, limits array<array<array<long>>>"


def quantised(table: DataFrame, label: Column, scale: int) -> DataFrame:
    """_row, vec_id, label (as text), dim and v (integers) of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = table.select("vec_id", label.cast("string").alias("label"), "embedding").filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~odd)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "label", F.size("embedding").alias("dim"), whole.alias("v"))


def _blocks(rows: DataFrame, side: int, slots: int) -> DataFrame:
    """Rows as blocks of one length; the index (side 0) stays in the slot of its partition, anchors (side 1) go to each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            row, ids, labels, vectors, limits = zip(*held.pop(dim), strict=True)
            raw = [np.array(x, t).tobytes() for x, t in ((row, np.int64), (ids, np.int64), (vectors, np.float64))]
            columns = [pa.array([n], pa.int32()) for n in (TaskContext.get().partitionId(), side, dim)]
            columns += [pa.array([x], pa.binary()) for x in raw] + [pa.array([labels], pa.list_(pa.string())), pa.array([limits], pa.list_(pa.list_(pa.list_(pa.int64()))))]
            return pa.RecordBatch.from_arrays(columns, names=["slot", "side", "dim", "rows", "ids", "vectors", "labels", "limits"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("_row", "vec_id", "label", "v", "limits")), strict=True):
                dim = len(row[3])
                held.setdefault(dim, []).append(row)
                if len(held[dim]) >= min(BLOCK, BLOCK_BYTES // (8 * max(dim, 1)) + 1):
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    made = rows.select("_row", "vec_id", "label", "v", "limits").mapInArrow(lean(run), BLOCKS)
    return made.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))) if side else made


class Run:
    """The rows of one length that a task holds."""

    def __init__(self, blocks: list[dict]):
        self.rows = np.concatenate([np.frombuffer(b["rows"], np.int64) for b in blocks])
        self.ids = np.concatenate([np.frombuffer(b["ids"], np.int64) for b in blocks])
        self.vectors = np.concatenate([np.frombuffer(b["vectors"]).reshape(len(b["labels"]), b["dim"]) for b in blocks])
        self.codes: dict[str, int] = {}
        self.labels = np.array([self.codes.setdefault(x, len(self.codes)) for b in blocks for x in b["labels"]], np.int64)
        self.of = {label: np.flatnonzero(self.labels == code) for label, code in self.codes.items()}
        self.top = float(np.abs(self.vectors).max(initial=0.0))

    def scores(self, anchors: np.ndarray, among: np.ndarray | slice) -> np.ndarray:
        """Exact inner products: in floats while they hold every partial sum, else in longs."""
        most = anchors.shape[1] * self.top * float(np.abs(anchors).max(initial=0.0))
        if most < 2.0**53:
            return (anchors @ self.vectors[among].T).astype(np.int64)
        if most < 2.0**62:
            return anchors.astype(np.int64) @ self.vectors[among].astype(np.int64).T
        raise OverflowError("scores don't fit into a long")

    def positives(self, anchors: dict, k: int) -> Iterator[tuple]:
        """(anchor's row, score, id) of the first ``k`` other rows of each anchor's label."""
        vectors = np.frombuffer(anchors["vectors"]).reshape(len(anchors["labels"]), anchors["dim"])
        for i, (row, label) in enumerate(zip(np.frombuffer(anchors["rows"], np.int64).tolist(), anchors["labels"], strict=True)):
            own = self.of.get(label)
            if own is not None:
                own = own[self.rows[own] != row]
                s = self.scores(vectors[i : i + 1], own)[0]
                for j in np.lexsort((self.ids[own], -s))[:k].tolist():
                    yield row, int(s[j]), int(self.ids[own[j]])

    def negatives(self, anchors: dict, k: int) -> Iterator[tuple]:
        """(anchor's row, place of the positive, score, id) of the first ``k`` rows of other labels within its limits."""
        vectors = np.frombuffer(anchors["vectors"]).reshape(len(anchors["labels"]), anchors["dim"])
        rows = np.frombuffer(anchors["rows"], np.int64).tolist()
        for at in range(0, len(rows), AT_ONCE):
            for i, s in enumerate(self.scores(vectors[at : at + AT_ONCE], slice(None)), at):
                order = np.lexsort((self.ids, -s))
                falling = -s[order]
                others = np.flatnonzero(self.labels[order] != self.codes.get(anchors["labels"][i], -1))
                for place, (low, high) in enumerate(zip(*anchors["limits"][i], strict=True)):
                    begin, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                    first = np.searchsorted(others, begin)
                    for j in others[first : first + k].tolist():
                        if j < end:
                            yield rows[i], place, -int(falling[j]), int(self.ids[order[j]])


def _met(index: DataFrame, anchors: DataFrame, slots: int, find: str, k: int, schema: str, types: list) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[dict]] = {}
        runs: dict[int, Run] = {}
        now = None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["slot"] != now:
                    now, blocks, runs = r["slot"], {}, {}
                if r["side"] == 0:
                    blocks.setdefault(r["dim"], []).append(r)
                    continue
                if blocks:
                    runs, blocks = {d: Run(x) for d, x in blocks.items()}, {}
                if r["dim"] in runs:
                    found = list(getattr(runs[r["dim"]], find)(r, k))
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(types)], names=names)

    # the index stays where it is and the anchors, a stated set, go to each slot
    placed = index.union(_blocks(anchors, 1, slots)).repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "side")
    return placed.mapInArrow(lean(run), schema)


def hard_negatives(
    table: DataFrame, is_anchor: Column, label: Column | None = None, k: int = 10, positives: int = 5, share: tuple[int, int] = (30, 90), scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows of ``table(vec_id, label, embedding)`` that ``is_anchor`` (of vec_id) names. Negatives have a
    score of ``share`` percent of the positive's, both ends included; rank counts those of each positive from 1.
    """
    spark = table.sparkSession
    rows = cut(quantised(table, F.col("label") if label is None else label, scale))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = min(max(-(-size["n"] // parts), LEAST_RUN), max(1, RUN_BYTES // (8 * max(size["dim"], 1))))
    slots = max(1, -(-size["n"] // each))
    none = F.lit(None).cast("array<array<long>>").alias("limits")
    index = cut(_blocks(rows.select("*", none).repartition(slots, "_row"), 0, slots))
    anchors = rows.filter(is_anchor)

    near = _met(index, anchors.select("*", none), slots, "positives", positives, "_row long, score long, vec_id long", [pa.int64()] * 3)
    order = W.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    # limits without a product that a long can't hold: ceiling and floor of score * percent / 100
    whole, rest = F.expr("score div 100"), F.expr("score % 100")
    low, high = whole * share[0] + F.ceil(rest * share[0] / 100), whole * share[1] + F.floor(rest * share[1] / 100)
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
    one = F.struct("n", "score", "vec_id", low.cast("long").alias("low"), high.cast("long").alias("high"))
    found = near.groupBy("_row").agg(F.array_sort(F.collect_list(one)).alias("p"))  # few an anchor
    limits = F.array(F.transform("p", lambda x: x["low"]), F.transform("p", lambda x: x["high"])).alias("limits")
    asked = cut(anchors.join(found, "_row").select("_row", "vec_id", "label", "v", limits, "p"))

    far = _met(index, asked, slots, "negatives", k, "_row long, place int, score long, negative_id long", [pa.int64(), pa.int32(), pa.int64(), pa.int64()])
    rank = F.row_number().over(W.partitionBy("_row", "place").orderBy(F.desc("score"), "negative_id"))
    best = far.withColumn("rank", rank).filter(F.col("rank") <= k)
    out = best.join(asked.select("_row", F.col("vec_id").alias("anchor_id"), "p"), "_row").withColumn("of", F.get("p", F.col("place")))
    return out.select("anchor_id", F.col("of.vec_id").alias("positive_id"), "rank", "negative_id", F.col("of.score").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""

"""Exact nearest vectors of a query set, per index and merged, in blocks of both sides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK, SLOT = 4096, 1024


def dimension(nodes: DataFrame) -> DataFrame:
    """One row: the length of the first embedding by node order that isn't empty; an error if there is none."""
    found = nodes.filter("size(embedding) > 0").agg(F.min_by(F.size("embedding"), "node_id").alias("dim"))
    return found.select(F.coalesce("dim", F.raise_error(F.lit("no embedding")).cast("int")).alias("dim"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _blocks(df: DataFrame, id_type: str, arrow: pa.DataType, rows: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, {}
        for b in batches:
            for key, dim, label, v in zip(*(b.column(c).to_pylist() for c in ("id", "dim", "label", "v")), strict=True):
                ids, vs = held.setdefault((dim, label), ([], []))
                ids.append(key)
                vs.append(v)
                if len(ids) == rows:
                    n += 1
                    yield out((dim, label), n, *held.pop((dim, label)))
        for k, (ids, vs) in held.items():
            n += 1
            yield out(k, n, ids, vs)

    def out(k: tuple, n: int, ids: list, vs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"dim": pa.array([k[0]], pa.int32()), "label": pa.array([k[1]], pa.string()), "block": pa.array([(TaskContext.get().partitionId() << 32) + n], pa.int64()), "ids": pa.array([ids], pa.list_(arrow)), "vs": [np.array(vs, float).tobytes()]})

    return df.mapInArrow(run, f"dim int, label string, block long, ids array<{id_type}>, vs binary")


def topk(queries: DataFrame, nodes: DataFrame, k: Column | int) -> DataFrame:
    """The k nearest nodes per query and label: qid, label, node_id, score ((1 + cosine) / 2), rank.

    ``queries(qid, k, embedding)``, ``nodes(node_id, label, embedding)``; vectors that are null, zero or broken are in
    no index, and queries without a positive k find nothing. Blocks of nodes are dealt evenly over slots, one a shuffle
    partition; blocks of queries go to each. What a block gives for a query is its k best, and those are merged.
    """
    spark = queries.sparkSession
    asked_k = (F.lit(k) if isinstance(k, int) else k).cast("int").alias("k")
    ask = queries.filter(usable(F.col("embedding"))).select(F.struct("qid", asked_k).alias("id"), F.size("embedding").alias("dim"), F.lit("").alias("label"), F.col("embedding").cast("array<double>").alias("v")).filter("id.k > 0")
    have = nodes.filter(usable(F.col("embedding"))).select(F.col("node_id").alias("id"), F.size("embedding").alias("dim"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = nodes.schema["node_id"].dataType.simpleString()
    qid_type = queries.schema["qid"].dataType.simpleString()
    asked = _blocks(ask, f"struct<qid:{qid_type},k:int>", pa.struct([("qid", ARROW[qid_type]), ("k", pa.int32())]), SLOT).select("dim", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    index = _blocks(have, id_type, ARROW[id_type], BLOCK).withColumn("slot", F.pmod(F.xxhash64("block", "label"), F.lit(slots)).cast("int"))
    met = index.join(asked, ["slot", "dim"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda raw, d: (lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True)))(np.frombuffer(raw).reshape(-1, d))
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                scores = (1 + unit(r["q_vs"], r["dim"]) @ unit(r["vs"], r["dim"]).T) / 2
                n, most = scores.shape[1], max(q["k"] for q in r["q_ids"])
                least = np.partition(scores, n - most, axis=1)[:, n - most] if most < n else np.full(len(scores), -1.0)
                rows, found = np.nonzero(scores >= least[:, None] - 1e-12)  # ties, also those that rounding parts, are settled after the merge
                ids, asked = r["ids"], r["q_ids"]
                columns = [[asked[q]["qid"] for q in rows], [asked[q]["k"] for q in rows], [r["label"]] * len(rows), [ids[j] for j in found], scores[rows, found]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["qid", "k", "label", "node_id", "score"])

    types = [ARROW[qid_type], pa.int32(), pa.string(), ARROW[id_type], pa.float64()]
    found = met.mapInArrow(search, f"qid {qid_type}, k int, label string, node_id {id_type}, score double")
    w = W.partitionBy("qid", "label").orderBy(F.desc(F.round("score", 12)), "node_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k"))


def topk_merged(queries: DataFrame, nodes: DataFrame, k: Column | int, labels: tuple[str, ...]) -> DataFrame:
    """The k best over all indexes of each query's k best per index; ties go by the order of the indexes, then node."""
    best = topk(queries, nodes, k)
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), order, "node_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k"))

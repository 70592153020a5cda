"""A stored index of vectors per label: balanced lists, residual codes, exact ranks.

Vectors of one label and length form a space. Training takes a sample of at most about ``sample`` vectors of each space, in one
task a space: k-means whose lists carry additive weights, raised for full lists and lowered for empty ones, so lists come
out of like size; then a product code of what is left after the list's centre. Every row is then assigned and coded in
tasks and written to Parquet partitioned by space and list; weights and codes belong to the model, so rows that are added
later fall into the same lists without a rebuild.

A search picks each query's nearest lists and reads those partitions only. Blocks of rows meet blocks of the queries that are
owed them, and one product of matrices compares the two. With ``refine=None`` the vectors themselves are compared, so no row of
the lists read can be lost, and with all lists read the result is that of the exact search. A number for ``refine`` keeps so
many times k candidates by their codes instead, and only their vectors are read and ranked by exact cosine.

Defined cases: vectors that are null, empty, zero or broken are in no index; a null label is a label; an id that is added
again is another row, as in the exact search; an empty table gives an empty index.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.operators.vector import ARROW, cosine, usable
from lexmill.session import cut

MODEL = "kind string, id_type string, space int, label string, dim int, number int, sub int, weight double, centre array<double>"
#: Rows and queries of a block; rows that a task holds before it lets go of blocks that aren't full; the tasks that share a list
#: that many rows fall into; bytes of a model, which goes to every task, at most.
BLOCK, SLOT, HOLDS, SHARES, MODEL_BYTES = 4096, 1024, 1 << 16, 8, 512 << 20
#: Stands for all lists of a space.
ALL = -1


@dataclass
class Space:
    """The model of one label and length."""

    label: str | None
    dim: int
    centres: np.ndarray  # a row a list
    weights: np.ndarray
    books: list[np.ndarray]  # per part of the vector its codewords

    def bounds(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres and the lists' weights, but for what all lists share."""
        return (self.centres * self.centres).sum(axis=1) - 2 * x @ self.centres.T + self.weights

    def own(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        return np.concatenate([self.distances(x[i : i + BLOCK]).argmin(axis=1) for i in range(0, len(x), BLOCK)])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """list and codes."""
        lists = self.own(x)
        left = x - self.centres[lists]
        codes, cut_at = np.zeros((len(x), len(self.books)), np.uint8), self.bounds()
        for j, book in enumerate(self.books):
            part = left[:, cut_at[j] : cut_at[j + 1]]
            codes[:, j] = ((book * book).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)
        return lists, codes

    def stood_for(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.centres[lists] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length."""
    return np.array(column.flatten().to_pylist() if pa.types.is_decimal(column.type.value_type) else column.flatten(), float).reshape(len(column), -1)


def _means(x: np.ndarray, n: int, rounds: int, balance: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and weights of ``n`` lists; empty ones begin anew at the rows that are farthest from their centre."""
    centres, weights = x[rng.choice(len(x), n, replace=False)].copy(), np.zeros(n)
    for r in range(rounds):
        size, own, gap = (centres * centres).sum(axis=1), np.zeros(len(x), np.int64), np.zeros(len(x))
        for i in range(0, len(x), BLOCK):  # distances to all centres are held for a block only
            part = x[i : i + BLOCK]
            far = size - 2 * part @ centres.T
            own[i : i + BLOCK] = (far + weights).argmin(axis=1)
            gap[i : i + BLOCK] = far[np.arange(len(part)), own[i : i + BLOCK]] + (part * part).sum(axis=1)
        sizes = np.bincount(own, minlength=n)
        for i, row in zip(np.flatnonzero(sizes == 0), np.argsort(-gap), strict=False):
            own[row], weights[i] = i, 0.0
        sizes = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        weights += balance * float(gap.mean()) * np.clip(sizes / (len(x) / n) - 1, -1, 2) / (1 + r / 4)
    return centres, weights - weights.min()


def train(x: np.ndarray, label: str | None, lists: int, parts: int, codewords: int, balance: float, seed: int) -> Space:
    """A space from a sample of its vectors."""
    rng, x = np.random.default_rng(seed), _unit(x)
    centres, weights = _means(x, min(lists, len(x)), 20, balance, rng)
    space = Space(label, x.shape[1], centres, weights, [])
    left = x - centres[space.own(x)]
    for part in np.array_split(left, min(parts, x.shape[1]), axis=1):
        space.books.append(_means(part, min(codewords, len(part)), 10, 0.0, rng)[0])
    return space


def _usable(nodes: DataFrame) -> DataFrame:
    return nodes.filter(usable(F.col("embedding"))).select("node_id", F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), "embedding")


def _trained(rows: DataFrame, known: dict[int, Space], lists: int | None, sample: int, parts: int, codewords: int, balance: float, seed: int) -> DataFrame:
    """Model rows of the spaces of ``rows`` that aren't known yet."""
    id_type = rows.schema["node_id"].dataType.simpleString()
    have = {(s.label, s.dim) for s in known.values()}
    sizes = [r for r in rows.groupBy("label", "dim").count().collect() if (r["label"], r["dim"]) not in have]  # a row a space
    sizes.sort(key=lambda r: (r["label"] is not None, r["label"] or "", r["dim"]))
    spark = rows.sparkSession
    if not sizes:
        return spark.createDataFrame([], MODEL)
    plan = [(max(known, default=-1) + 1 + i, r["label"], r["dim"], min(1.0, sample / r["count"]), lists or max(1, round(math.sqrt(r["count"])))) for i, r in enumerate(sizes)]
    wanted = spark.createDataFrame(plan, "space int, label string, dim int, share double, lists int")
    met = rows.join(F.broadcast(wanted), rows["label"].eqNullSafe(wanted["label"]) & (rows["dim"] == wanted["dim"])).select("space", wanted["label"], wanted["dim"], "share", "lists", "node_id", F.col("embedding").cast("array<double>").alias("v"))
    drawn = met.filter(F.pmod(F.xxhash64("node_id", "v"), F.lit(1 << 20)) <= F.col("share") * (1 << 20))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        label = None if pd.isna(first.label) else first.label
        group = group.sort_values("node_id", kind="stable")  # the sample in an order of its own
        made = train(np.stack(group.v.to_numpy()), label, int(first.lists), parts, codewords, balance, seed)
        out = [("list", id_type, int(first.space), label, made.dim, i, 0, float(w), c.tolist()) for i, (w, c) in enumerate(zip(made.weights, made.centres, strict=True))]
        out += [("code", id_type, int(first.space), label, made.dim, i, j, 0.0, c.tolist()) for j, book in enumerate(made.books) for i, c in enumerate(book)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return drawn.groupBy("space").applyInPandas(one, MODEL)


def load(spark: SparkSession, path: str) -> tuple[str, dict[int, Space]]:
    """The type of ids and the spaces of a stored index."""
    rows = spark.read.schema(MODEL).parquet(f"{path}/model")
    size = rows.agg(F.coalesce(F.sum(F.size("centre")), F.lit(0))).first()[0] * 8
    if size > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes doesn't fit a task: take fewer lists")
    of: dict[int, list] = {}
    id_type = "string"
    for r in rows.collect():  # bounded by MODEL_BYTES
        id_type = r["id_type"] if r["kind"] == "meta" else id_type
        of.setdefault(r["space"], []).append(r)
    out = {}
    for number, found in of.items():
        if number >= 0:
            lists = sorted((r for r in found if r["kind"] == "list"), key=lambda r: r["number"])
            books: dict[int, list] = {}
            for r in sorted((r for r in found if r["kind"] == "code"), key=lambda r: (r["sub"], r["number"])):
                books.setdefault(r["sub"], []).append(r["centre"])
            out[number] = Space(lists[0]["label"], lists[0]["dim"], np.array([r["centre"] for r in lists]), np.array([r["weight"] for r in lists]), [np.array(b) for _, b in sorted(books.items())])
    return id_type, out


def _assigned(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """space, list, node_id, codes and embedding of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(spaces)
    kind = rows.schema["embedding"].dataType.simpleString()
    id_type = rows.schema["node_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {(s.label, s.dim): n for n, s in shared.value.items()}
        for b in batches:
            of = np.array([number[k] for k in zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True)], np.int32)
            for n in np.unique(of):
                at = np.flatnonzero(of == n)
                part = b.take(pa.array(at))
                lists, codes = shared.value[n].coded(_unit(_matrix(part.column("embedding"))))
                made = [pa.array(np.full(len(at), n, np.int32)), pa.array(lists.astype(np.int32)), part.column("node_id"), pa.array([c.tobytes() for c in codes], pa.binary()), part.column("embedding")]
                yield pa.RecordBatch.from_arrays(made, names=["space", "list", "node_id", "codes", "embedding"])

    return rows.mapInArrow(run, f"space int, list int, node_id {id_type}, codes binary, embedding {kind}")


def _store(rows: DataFrame, spaces: dict[int, Space], path: str, mode: str) -> None:
    # lists are dealt to files of like size: full ones are split, small ones share a task
    _assigned(rows, spaces).hint("rebalance", "space", "list").write.mode(mode).partitionBy("space", "list").parquet(f"{path}/vectors")


def build(nodes: DataFrame, path: str, lists: int | None = None, sample: int = 50_000, parts: int = 16, codewords: int = 256, balance: float = 0.1, seed: int = 7) -> None:
    """Write an index of ``nodes(node_id, label, embedding)`` to ``path``, in place of what is there.

    ``lists`` (by default the root of its rows) of each space, codes of ``parts`` bytes with up to 256 ``codewords`` each.
    """
    spark, rows = nodes.sparkSession, _usable(nodes)
    model = _trained(rows, {}, lists, sample, parts, codewords, balance, seed)
    meta = spark.createDataFrame([("meta", nodes.schema["node_id"].dataType.simpleString(), -1, nodes.schema["embedding"].dataType.simpleString(), 0, 0, 0, 0.0, [])], MODEL)
    meta.unionByName(model).write.mode("overwrite").parquet(f"{path}/model")
    _store(rows, load(spark, path)[1], path, "overwrite")


def add(nodes: DataFrame, path: str, **how) -> None:
    """Add rows to a stored index: they fall into its lists; labels and lengths that it doesn't have get lists of their own."""
    spark, rows = nodes.sparkSession, _usable(nodes)
    settings = {"lists": None, "sample": 50_000, "parts": 16, "codewords": 256, "balance": 0.1, "seed": 7} | how
    model = cut(_trained(rows, load(spark, path)[1], **settings))
    if model.count():
        model.write.mode("append").parquet(f"{path}/model")
    _store(rows, load(spark, path)[1], path, "append")


def _read(spark: SparkSession, path: str) -> DataFrame:
    meta = spark.read.schema(MODEL).parquet(f"{path}/model").filter("kind = 'meta'").select("id_type", "label").first()
    return spark.read.schema(f"node_id {meta['id_type']}, codes binary, embedding {meta['label']}, space int, list int").parquet(f"{path}/vectors")


def probes(queries: DataFrame, spaces: dict[int, Space], k: Column | int, probe: int | None) -> DataFrame:
    """space, list, qids, ks and qs (the unit vectors): blocks of the queries that read a list, each the ``probe`` nearest of
    its lists in each space. With None they read all, and a row stands for all lists of a space."""
    qid_type = queries.schema["qid"].dataType.simpleString()
    shared = queries.sparkSession.sparkContext.broadcast(spaces)
    asked = queries.filter(usable(F.col("embedding"))).select("qid", (F.lit(k) if isinstance(k, int) else k).cast("int").alias("k"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("v")).filter("k > 0")

    def block(space: int, number: int, part: pa.RecordBatch, q: np.ndarray) -> pa.RecordBatch:
        made = [pa.array([space], pa.int32()), pa.array([number], pa.int32()), pa.array([part.column("qid").to_pylist()], pa.list_(ARROW[qid_type])), pa.array([np.array(part.column("k"), np.int32).tobytes()]), pa.array([q.tobytes()])]
        return pa.RecordBatch.from_arrays(made, names=["space", "list", "qids", "ks", "qs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array(b.column("dim"))
            for dim in np.unique(dims):
                every = np.flatnonzero(dims == dim)
                for at in (every[i : i + SLOT] for i in range(0, len(every), SLOT)):
                    part = b.take(pa.array(at))
                    q = _unit(_matrix(part.column("v")))
                    for number, space in shared.value.items():
                        if space.dim != dim:
                            continue
                        if probe is None:
                            yield block(number, ALL, part, q)
                            continue
                        lists = np.argsort(space.distances(q), axis=1, kind="stable")[:, :probe]
                        who = np.repeat(np.arange(len(q)), lists.shape[1])
                        order = np.argsort(lists.reshape(-1), kind="stable")
                        found, begins = np.unique(lists.reshape(-1)[order], return_index=True)
                        for one, rows in zip(found.tolist(), np.split(who[order], begins[1:]), strict=True):
                            yield block(number, one, part.take(pa.array(rows)), q[rows])

    # queries of many small partitions come together before they are packed
    return asked.hint("rebalance").mapInArrow(run, f"space int, list int, qids array<{qid_type}>, ks binary, qs binary")


def only_lists(stored: DataFrame, wanted: dict[int, list[int]]) -> DataFrame:
    """The partitions of some lists."""
    keep = F.lit(False)
    for space, lists in sorted(wanted.items()):
        keep = keep | ((F.col("space") == space) & F.col("list").isin(sorted(lists)))
    return stored.filter(keep)


def _packed(stored: DataFrame, vectors: bool, whole: bool, shares: int, id_type: str) -> DataFrame:
    """space, list, share, ids, lists and rows (vectors or codes): blocks of rows of a list, or of a space if it is read whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[pa.RecordBatch]] = {}
        n, kept = TaskContext.get().partitionId(), 0

        def block(key: tuple[int, int], rows: pa.Table) -> pa.RecordBatch:
            nonlocal n
            n += 1
            rows = rows.combine_chunks()
            own = rows.column("row").combine_chunks()
            raw = _matrix(own).tobytes() if vectors else b"".join(own.to_pylist())
            made = [*(pa.array([x], pa.int32()) for x in (*key, n % shares)), pa.array([rows.column("node_id").to_pylist()], pa.list_(ARROW[id_type])), pa.array([np.array(rows.column("list"), np.int32).tobytes()]), pa.array([raw])]
            return pa.RecordBatch.from_arrays(made, names=["space", "list", "share", "ids", "lists", "rows"])

        def full(key: tuple[int, int], least: int) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held.pop(key))
            for i in range(0, rows.num_rows, BLOCK):
                part = rows.slice(i, BLOCK)
                if part.num_rows >= least:
                    yield block(key, part)
                else:
                    held[key] = part.to_batches()

        for b in batches:
            spaces, lists = np.array(b.column("space")), np.array(b.column("list"))
            keys = spaces if whole else spaces.astype(np.int64) << 32 | lists
            for x in np.unique(keys).tolist():
                key = (x, ALL) if whole else (x >> 32, x & 0xFFFFFFFF)
                held.setdefault(key, []).append(b.take(pa.array(np.flatnonzero(keys == x))))
                if sum(p.num_rows for p in held[key]) >= BLOCK:
                    yield from full(key, BLOCK)
            kept = sum(p.num_rows for parts in held.values() for p in parts)
            for key in list(held) if kept > HOLDS else ():
                yield from full(key, 1)
        for key in list(held):
            yield from full(key, 1)

    rows = stored.select("space", "list", "node_id", F.col("embedding" if vectors else "codes").alias("row"))
    return rows.mapInArrow(run, f"space int, list int, share int, ids array<{id_type}>, lists binary, rows binary")


def search(queries: DataFrame, path: str, k: Column | int, probe: int | None = 16, refine: int | None = 8) -> DataFrame:
    """The k nearest nodes per query and label, of the lists read: qid, label, node_id, score ((1 + cosine) / 2), rank.

    What a block gives for a query is its k best (by codes: ``refine`` times k), and those are merged.
    """
    spark = queries.sparkSession
    id_type, spaces = load(spark, path)
    stored, shares = _read(spark, path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = cut(probes(queries, spaces, k, probe))
    if probe is not None:
        wanted: dict[int, list[int]] = {}
        for r in asked.select("space", "list").distinct().collect():  # a row a list, as many as the model has
            wanted.setdefault(r["space"], []).append(r["list"])
        stored, shares = only_lists(stored, wanted), SHARES
    shared = spark.sparkContext.broadcast(spaces)
    qid_type = queries.schema["qid"].dataType.simpleString()

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                space, lists = shared.value[r["space"]], np.frombuffer(r["lists"], np.int32)
                q, ks = np.frombuffer(r["qs"]).reshape(-1, space.dim), np.frombuffer(r["ks"], np.int32)
                if refine is None:
                    x = _unit(np.frombuffer(r["rows"]).reshape(-1, space.dim))
                    away, slack = -(q @ x.T), 1e-11  # ties, also those that rounding parts, are settled after the merge
                else:
                    x = space.stood_for(lists, np.frombuffer(r["rows"], np.uint8).reshape(len(lists), -1))
                    away, slack = (x * x).sum(axis=1) - 2 * q @ x.T, 0.0
                most = ks.astype(np.int64) * (refine or 1)
                reach = np.full(len(q), np.inf)
                for n in np.unique(most[most < len(x)]):
                    of = np.flatnonzero(most == n)
                    reach[of] = np.partition(away[of], n - 1, axis=1)[:, n - 1]
                rows, found = np.nonzero(away <= reach[:, None] + slack)
                # of pairs that stay the score is summed alike wherever they stand, so equal vectors have equal scores
                by = np.concatenate([(1 + (q[rows[j : j + BLOCK]] * x[found[j : j + BLOCK]]).sum(axis=1)) / 2 for j in range(0, len(rows), BLOCK)]) if refine is None else away[rows, found]
                qids = pa.array(r["qids"], ARROW[qid_type])
                made = [qids.take(pa.array(rows)), pa.array(ks[rows]), pa.array(np.full(len(rows), r["space"], np.int32)), pa.array(lists[found]), pa.array(r["ids"], ARROW[id_type]).take(pa.array(found)), pa.array(by)]
                yield pa.RecordBatch.from_arrays(made, names=["qid", "k", "space", "list", "node_id", "by"])

    shared_out = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    met = _packed(stored, refine is None, probe is None, shares, id_type).join(shared_out, ["space", "list", "share"])
    close = met.mapInArrow(near, f"qid {qid_type}, k int, space int, list int, node_id {id_type}, by double")
    if refine is None:
        scored = close.withColumnRenamed("by", "score")
    else:
        of = W.partitionBy("qid", "space").orderBy("by", "node_id")
        candidates = close.withColumn("_n", F.row_number().over(of)).filter(F.col("_n") <= refine * F.col("k")).select("qid", "k", "space", "list", "node_id").distinct()
        full = candidates.join(stored.select("space", "list", "node_id", "embedding"), ["space", "list", "node_id"])
        own = queries.select("qid", F.col("embedding").cast("array<double>").alias("_q"))
        scored = full.join(own, "qid").withColumn("score", (1 + cosine(F.col("_q"), F.col("embedding").cast("array<double>"))) / 2)
    names = spark.createDataFrame([(n, s.label) for n, s in spaces.items()], "space int, label string")
    best = W.partitionBy("qid", "space").orderBy(F.desc(F.round("score", 12)), "node_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.col("k"))
    # vectors of one label but several lengths are in several spaces, a query's length in one of them
    return ranked.join(F.broadcast(names), "space").select("qid", "label", "node_id", "score", "rank")

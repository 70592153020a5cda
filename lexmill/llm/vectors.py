"""Embedding near-dedup by an epsilon grid order join, and nearest neighbours by collision counting.

Both take ``vec_id``, ``embedding`` (and ``label``, of any type that compares) from a table; other columns don't matter.
Of rows that repeat a vec_id the one with the smallest label and vector counts. Vectors that are null, empty, all zero or
hold null or non-finite components take no part; vectors of different length are never compared. Rows without a vec_id
can't be named by a link: near-duplicates returns each once, unlinked and kept, and the search leaves them out.

Grid order join. Unit vectors are sorted by the cells of an epsilon grid on leading principal dimensions. Two sequences
are joined by halving their intervals, skipping those whose boxes lie more than epsilon apart. The recursion ends at
LEAF vectors, where the intervals of one vector are tested all at once: an interval of one is its own box, so one
product of the leading dimensions tells which lie within epsilon. Only those are compared in full.

Collision counting. A block of the index holds one sorted array per random line. Windows around the query's place on
each line widen with the radius (virtual rehashing); a vector that lies in at least a threshold of windows is verified
by its distance, and the search ends when the k-th verified distance lies within the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.common import lean
from lexmill.llm.components import components
from lexmill.session import cut

#: Vectors of the sample that orients the axes or scales the radii.
SAMPLE = 8000
#: Rows of a block and blocks of a run: a task holds one run and streams another past it.
BLOCK, RUN = 2048, 8
#: Leading principal dimensions of the grid; the recursion ends at intervals of LEAF vectors.
AXES, LEAF, SLACK = 16, 128, 1e-6
#: Rows of index blocks, at least and at most; index blocks of a task; rows of query blocks.
LEAST_INDEX, MOST_INDEX, HOLDS, QUERY_BLOCK = 2048, 16384, 4, 512


def usable() -> F.Column:
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def _unique(table: DataFrame, *more: str) -> DataFrame:
    return table.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct(*more, F.col("embedding").cast("array<double>").alias("embedding"))).alias("r")).select("vec_id", "r.*")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _sample(vectors: DataFrame) -> np.ndarray:
    """About SAMPLE vectors of the most frequent length."""
    size = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return np.zeros((0, 1))
    share = min(1.0, SAMPLE / size["count"])
    rows = vectors.filter((F.size("embedding") == size.d) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("embedding").toArrow()
    return _matrix(rows.column(0).combine_chunks()) if rows.num_rows else np.zeros((0, size.d))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# -- epsilon grid order ----------------------------------------------------------------------------------------


class Sequence:
    """Vectors in grid order, with their places on the leading dimensions."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, axes: np.ndarray):
        self.ids, self.own, self.unit = ids, own, _unit(own)
        self.grid = _project(self.unit, axes)
        self.squares = (self.grid * self.grid).sum(axis=1)


def _project(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return unit @ axes if unit.shape[1] == len(axes) else unit[:, :AXES]


def _links(a: Sequence, i: slice, b: Sequence, j: slice, least: float, eps: float, same: bool) -> tuple[np.ndarray, int]:
    """Which rows of two intervals have a cosine of at least ``least``, and how many pairs were compared in full."""
    near = a.squares[i][:, None] + b.squares[j][None] - 2 * (a.grid[i] @ b.grid[j].T) <= eps * eps
    if same:
        near = np.triu(near, 1)
    x, y = np.nonzero(near)
    s = (a.unit[i][x] * b.unit[j][y]).sum(axis=1)
    hit = s >= least
    for k in np.flatnonzero(np.abs(s - least) < 1e-9).tolist():  # close calls, from the vectors as they are
        v, w = a.own[i][x[k]], b.own[j][y[k]]
        hit[k] = v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= least
    out = np.zeros(near.shape, bool)
    out[x[hit], y[hit]] = True
    return out, len(x)


def _grow(hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of rows and columns that the marks of a matrix connect."""
    left = hit.any(axis=1)
    while left.any():
        rows = np.zeros(len(hit), bool)
        rows[np.argmax(left)] = True
        while True:
            columns = hit[rows].any(axis=0)
            more = hit[:, columns].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        left &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(columns)


def _join(a: Sequence, b: Sequence, least: float, eps: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """Join two sequences, halving intervals and skipping those whose boxes lie over eps apart.

    Returns the links of each row on either side, trees of linked ids, and the number of pairs compared in full.
    """
    same = a is b
    na, nb, trees, full = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64), [], 0

    def step(i: int, j: int, k: int, n: int) -> None:
        nonlocal full
        if same and k < i:
            return
        ga, gb = a.grid[i:j], b.grid[k:n]
        gap = np.maximum(0, np.maximum(ga.min(axis=0) - gb.max(axis=0), gb.min(axis=0) - ga.max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            return
        if j - i <= LEAF and n - k <= LEAF:
            hit, pairs = _links(a, slice(i, j), b, slice(k, n), least, eps, same and i == k)
            full += pairs
            if hit.any():
                na[i:j] += hit.sum(axis=1)
                nb[k:n] += hit.sum(axis=0)
                for rows, columns in _grow(hit):
                    ids = np.concatenate([a.ids[i:j][rows], b.ids[k:n][columns]])
                    trees.append(np.stack([ids, np.full(len(ids), ids.min())], 1))
            return
        if same and i == k:
            m = (i + j) // 2
            step(i, m, i, m)
            step(i, m, m, j)
            step(m, j, m, j)
        elif j - i >= n - k:
            step(i, (i + j) // 2, k, n)
            step((i + j) // 2, j, k, n)
        else:
            step(i, j, k, (k + n) // 2)
            step(i, j, (k + n) // 2, n)

    step(0, len(a.ids), 0, len(b.ids))
    return na, nb, trees, full


def _comparable(table: DataFrame) -> Column:
    """The label as a string that is equal where labels are."""
    kind = table.schema["label"].dataType.simpleString()
    label = F.col("label")
    if kind in ("double", "float"):
        label = F.when(label == 0, F.lit(0.0)).otherwise(label.cast("double"))  # of either sign
    if kind == "binary":
        return F.hex(label)
    return F.when(label.isNotNull(), F.to_json(F.struct(label.alias("l")))) if kind.startswith(("struct", "array", "map")) else label.cast("string")


def axes_of(seen: np.ndarray) -> np.ndarray:
    """Leading principal dimensions of a sample, as columns."""
    if len(seen) < 2:
        return np.eye(max(seen.shape[1], 1))[:, :AXES]
    return np.linalg.eigh(np.cov(_unit(seen).T).reshape(seen.shape[1], -1))[1][:, ::-1][:, :AXES]


def near_duplicates(table: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector of ``table(vec_id, label, embedding)``.

    Vectors of equal label link when their cosine is at least ``least``. Links are counted where they are found
    and leave a task only as trees, so a group of near copies costs rows in proportion to its size.
    """
    nameless = table.filter("vec_id IS NULL").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    every = cut(_unique(table.withColumn("label", _comparable(table)), "label"))
    vectors = every.filter(F.col("label").isNotNull() & usable()).withColumn("dim", F.size("embedding"))
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    axes = axes_of(_sample(vectors))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list = [None] * b.num_rows
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = _matrix(b.column("embedding").take(pa.array(at)))
                for i, key in zip(at.tolist(), np.floor(_project(_unit(own), axes) / eps).astype(np.int32).tolist(), strict=True):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*b.schema.names, "cell"])

    placed = vectors.select("vec_id", "label", "dim", "embedding").mapInArrow(lean(cells), "vec_id long, label string, dim int, embedding array<double>, cell array<int>")
    order = ["label", "dim", "cell", "vec_id"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a sorted sequence, none of two labels or lengths."""
        n, key, ids, rows = 0, None, [], []

        def block() -> pa.RecordBatch:
            nonlocal n, ids, rows
            own = np.array(rows, float)
            grid, n = _project(_unit(own), axes), n + 1
            out = {
                "block": pa.array([(TaskContext.get().partitionId() << 32) + n], pa.int64()),
                "label": [key[0]],
                "dim": pa.array([key[1]], pa.int32()),
                "ids": [np.array(ids, np.int64).tobytes()],
                "own": [own.tobytes()],
                "lo": [grid.min(axis=0).tolist()],
                "hi": [grid.max(axis=0).tolist()],
            }
            ids, rows = [], []
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            for vec_id, label, dim, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "dim", "embedding")), strict=True):
                if ids and (key != (label, dim) or len(ids) == BLOCK):
                    yield block()
                key = (label, dim)
                ids.append(vec_id)
                rows.append(v)
        if ids:
            yield block()

    schema = "block long, label string, dim int, ids binary, own binary, lo array<double>, hi array<double>"
    blocks = cut(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lean(pack), schema))
    # runs of neighbouring blocks meet in the cells of the first axis that both reach, if their boxes allow
    kind = W.partitionBy("label", "dim").orderBy("block")
    run = blocks.select("block", "label", "dim", "lo", "hi", F.floor((F.row_number().over(kind) - 1) / RUN).alias("run"))
    run = cut(run)
    depth = min(AXES, axes.shape[1])
    ends = run.groupBy("label", "dim", "run").agg(*(F.min(F.get("lo", F.lit(i))).alias(f"lo{i}") for i in range(depth)), *(F.max(F.get("hi", F.lit(i))).alias(f"hi{i}") for i in range(depth)))
    ends = ends.select("label", "dim", "run", F.array(*(f"lo{i}" for i in range(depth))).alias("lo"), F.array(*(f"hi{i}" for i in range(depth))).alias("hi"))
    ends = cut(ends.withColumn("from", F.floor(F.col("lo")[0] / eps)).withColumn("to", F.floor(F.col("hi")[0] / eps)))
    left = ends.select("*", F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("at")).alias("l")
    right = ends.select("*", F.explode(F.sequence("from", "to")).alias("at")).alias("r")
    gap = lambda x: F.coalesce(F.greatest(F.lit(0.0), x["lo"] - x["hi2"], x["lo2"] - x["hi"]), F.lit(0.0))
    gaps = F.transform(F.arrays_zip("l.lo", "l.hi", F.col("r.lo").alias("lo2"), F.col("r.hi").alias("hi2")), gap)
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(right, (F.col("l.label") == F.col("r.label")) & (F.col("l.dim") == F.col("r.dim")) & (F.col("l.at") == F.col("r.at")) & (F.col("l.run") <= F.col("r.run")) & (apart <= eps * eps))
    pairs = cut(pairs.select(F.col("l.label").alias("label"), F.col("l.dim").alias("dim"), F.col("l.run").alias("x"), F.col("r.run").alias("y")).distinct())
    # a pair's first run comes before its second; a run that meets itself is sent once
    sides = pairs.select("*", F.col("x").alias("run"), F.lit(0).alias("side")).union(pairs.filter("x < y").select("*", F.col("y").alias("run"), F.lit(1).alias("side")))
    dealt = sides.join(run.select("label", "dim", "run", "block"), ["label", "dim", "run"]).join(blocks.select("block", "ids", "own"), "block")
    pair = ["label", "dim", "x", "y"]
    met = dealt.select(*pair, "side", "block", "ids", "own").repartition(parts, *pair).sortWithinPartitions(*pair, "side", "block")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Sequence] = []
        now = None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if (key := tuple(row[c] for c in pair)) != now:
                    now, held = key, []
                mine = Sequence(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"]).reshape(-1, row["dim"]), axes)
                others = held
                if row["side"] == 0:
                    held.append(mine)
                    others = held if row["x"] == row["y"] else []
                for other in others:
                    yield _found(other, mine, *_join(other, mine, least, eps)[:3])

    found = cut(met.mapInArrow(lean(verify), "a long, n long, b long"))
    counts = found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    groups = components(found.select("a", "b")).withColumnRenamed("id", "vec_id")
    out = every.select("vec_id").join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).union(nameless)


def _found(a: Sequence, b: Sequence, na: np.ndarray, nb: np.ndarray, trees: list[np.ndarray]) -> pa.RecordBatch:
    """Links counted per id and, with no count, the edges of trees."""
    ids, n = np.concatenate([a.ids, b.ids]), np.concatenate([na, nb])
    tree = np.unique(np.concatenate(trees), axis=0) if trees else np.zeros((0, 2), np.int64)
    tree = tree[tree[:, 0] != tree[:, 1]]
    rows = [np.concatenate([ids[n > 0], tree[:, 0]]), np.concatenate([n[n > 0], np.zeros(len(tree), np.int64)]), np.concatenate([ids[n > 0], tree[:, 1]])]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["a", "n", "b"])


NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.reach) AS component_id, min(r.reach) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.id = e.vec_id GROUP BY e.vec_id
"""

# -- collision counting ----------------------------------------------------------------------------------------

#: Projections; half width of a window of radius 1; standard errors by which the threshold lies below the mean.
PROJECTIONS, HALF_WIDTH, ERRORS, SEED = 256, 1.36, 0.8, 7
#: Lines whose hits are summed in a byte.
TALLY = 64
#: The first radii, as shares of the sample's median distance; after the last each is STEP times the one before. A block
#: starts at START of the k-th distance that blocks before it gave.
RADII, STEP, START = (0.1, 0.25, 0.4, 0.5), 1.04, 0.85
THRESHOLD = math.ceil(PROJECTIONS * math.erf(HALF_WIDTH / math.sqrt(2)) - ERRORS * math.sqrt(PROJECTIONS * math.erf(HALF_WIDTH / math.sqrt(2)) * math.erfc(HALF_WIDTH / math.sqrt(2))))


class Index:
    """A block's vectors and their places on random lines, by line.

    Places are kept as bytes, in 255 steps of the block's widest line, so hits in a window are counted by whole lines at once.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        self.scale = max(float(np.abs(vectors).max(initial=0.0)), 1e-300)  # so that places stay finite
        places = (vectors / self.scale @ self.lines).T
        self.low = places.min(axis=1, initial=np.inf)
        self.step = max(float((places.max(axis=1, initial=-np.inf) - self.low).max(initial=0.0)) / 254, 1e-300)
        self.places = np.rint((places - self.low[:, None]) / self.step).astype(np.uint8, order="C")
        self.past, self.inside = np.empty((TALLY, len(ids)), np.uint8), np.empty((TALLY, len(ids)), bool)
        self.verified = 0

    def hits(self, centre: np.ndarray, width: float) -> np.ndarray:
        """In how many lines each vector lies within ``width`` of the query's place."""
        lo = np.clip(np.ceil((centre - width - self.low) / self.step), 0, 255)
        hi = np.clip(np.floor((centre + width - self.low) / self.step), -1, 254)
        lo = np.where(lo > hi, 255, lo)  # a window that holds nothing: places end at 254
        lo, wide = lo.astype(np.uint8)[:, None], np.maximum(hi - lo, 0).astype(np.uint8)[:, None]
        met = np.zeros(len(self.ids), np.int16)
        for i in range(0, PROJECTIONS, TALLY):
            # unsigned bytes wrap round below a window's beginning, so one comparison holds both its ends
            np.subtract(self.places[i : i + TALLY], lo[i : i + TALLY], out=self.past)
            np.less_equal(self.past, wide[i : i + TALLY], out=self.inside)
            met += np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8)
        return met

    def search(self, query_id: int, q: np.ndarray, k: int, typical: float, best: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """``best`` (the k nearest found so far, of other blocks) and those of this block: windows around the query
        widen until the k-th verified distance lies within the radius, or every vector is verified."""
        centre = np.clip(q / self.scale, -1e200, 1e200) @ self.lines
        done = self.ids == query_id
        radius, step, bound = 0.0, 0, best[k - 1][0] if len(best) >= k else math.inf
        while not done.all() and bound > radius:
            radius = max(typical * RADII[step], radius * STEP) if step < len(RADII) else radius * (STEP if step < 64 else 2)
            step += 1
            radius = max(radius, START * bound) if step == 1 and bound < math.inf else radius
            new = np.flatnonzero((self.hits(centre, HALF_WIDTH * radius / self.scale) >= THRESHOLD) & ~done)
            if len(new):
                done[new] = True
                self.verified += len(new)
                gap = self.vectors[new] - q
                far = np.sqrt((gap * gap).sum(axis=1))
                near = np.flatnonzero(far <= bound)
                best = sorted(best + list(zip(far[near].tolist(), self.ids[new[near]].tolist(), strict=True)))[:k]
                bound = best[k - 1][0] if len(best) >= k else math.inf
        return best


def scale_of(seen: np.ndarray) -> float:
    """The median distance in a sample of at most 1,000 vectors."""
    seen = seen[:1000]
    if len(seen) > 1:
        gaps = np.sqrt(np.maximum(0, (seen[:500, None] - seen[None, -500:]) ** 2).sum(axis=2))
        if (gaps > 0).any() and np.isfinite(m := float(np.median(gaps[gaps > 0]))):
            return m
    return 1.0


def _packed(vectors: DataFrame, rows_of: int, partitions: int) -> DataFrame:
    """block, dim, ids and own: the vectors in blocks of at most ``rows_of``, each of one length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        n = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal n
            ids, rows = held.pop(dim)
            n += 1
            number = pa.array([(TaskContext.get().partitionId() << 32) + n], pa.int64())
            return pa.RecordBatch.from_pydict({"block": number, "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "own": [np.array(rows, float).tobytes()]})

        for b in batches:
            for vec_id, dim, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "embedding")), strict=True):
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(vec_id)
                rows.append(v)
                if len(ids) == rows_of:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    spread = vectors.select("vec_id", "dim", "embedding").repartition(partitions, "vec_id")
    return cut(spread.mapInArrow(lean(run), "block long, dim int, ids binary, own binary"))


def nearest(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found for each query row.

    Every vector is indexed. A task holds HOLDS index blocks, builds their arrays once and streams the blocks of queries
    past them; each query's k best per task are merged. Radii follow the median distance in a sample of at most about
    SAMPLE vectors; a search with fewer than k vectors in reach goes on until all are verified.
    """
    spark = table.sparkSession
    vectors = cut(_unique(table).filter(usable()).withColumn("dim", F.size("embedding")))
    typical = scale_of(_sample(vectors))
    parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), vectors.count()
    rows = min(MOST_INDEX, max(LEAST_INDEX, -(-total // parts)))
    queries = vectors.filter(is_query)
    slots = max(1, -(-total // (rows * HOLDS)) if total > rows * parts else -(-total // rows))
    index = _packed(vectors, rows, slots)
    asked = _packed(queries, QUERY_BLOCK, max(1, min(parts, -(-queries.count() // QUERY_BLOCK))))
    # a slot is the index blocks of one task; queries, fewer than the index, go to each
    slotted = index.withColumn("slot", F.shiftright("block", 32).cast("int"))
    rows_of = lambda df, side: df.select("slot", F.lit(side).alias("side"), "block", "dim", "ids", "own")
    sent = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = rows_of(slotted, 0).union(rows_of(sent, 1)).repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "side", "block")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Index] = []
        now = None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if row["slot"] != now:
                    now, held = row["slot"], []
                ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"]).reshape(-1, row["dim"])
                if row["side"] == 0:
                    held.append(Index(ids, own))
                    continue
                found = []
                for query, q in zip(ids.tolist(), own, strict=True):
                    best: list[tuple[float, int]] = []
                    for built in held:
                        if built.vectors.shape[1] == len(q):
                            best = built.search(query, q, k, typical, best)
                    found += [(query, v, s) for s, v in best]
                columns = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    best = met.mapInArrow(lean(search), "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

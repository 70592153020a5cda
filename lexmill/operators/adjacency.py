"""Edges as sorted lists of targets in blocks, so that a hop with limits reads the beginnings it needs.

``first`` holds a row for each source with an edge: its number of targets and its first block; ``rest`` holds the other
blocks. A hop joins its seeds with ``first``. Degrees alone decide how many targets the limits leave each seed, so a hub is
never exploded, and ``rest`` is only joined with the seeds that are owed more than a block.

Defined cases: equal edges count once; edges without a source or a target, and seeds without an id, meet nothing; seeds that
repeat count once; null questions are one question; an empty table gives empty ones; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.operators import scan
from lexmill.session import cut

BLOCK = 64


class Running:
    """A machine for ``scan.segmented``: the number of each row of a key, from 0."""

    reads = ()
    adds = "place long"

    class builder:  # noqa: N801
        def __init__(self) -> None:
            self.rows = 0

        def push(self, row: tuple) -> None:
            self.rows += 1

        def function(self) -> int:
            return self.rows

    def start(self) -> int:
        return 0

    def after(self, function: int, state: int) -> int:
        return state + function

    def step(self, state: int, row: tuple) -> tuple[int, tuple]:
        return state + 1, (state,)


def build(edges: DataFrame, block: int = BLOCK, parts: int | None = None) -> dict[str, DataFrame]:
    """``first(src, degree, targets)`` and ``rest(src, block, targets)`` of ``edges(src, dst)``.

    Targets are numbered by a scan in ranges of (source, target), so a hub lies in many tasks; a list holds ``block`` targets.
    """
    own = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    placed = scan.segmented(own.withColumn("_key", F.col("src")), "_key", ["dst"], Running(), parts)
    lists = cut(placed.groupBy("src", F.floor(F.col("place") / block).alias("block")).agg(F.sort_array(F.collect_list("dst")).alias("targets")))
    degrees = lists.groupBy("src").agg(F.sum(F.size("targets")).alias("degree"))
    first = lists.filter("block = 0").join(degrees, "src").select("src", "degree", "targets")
    return {"first": first, "rest": lists.filter("block > 0")}


def owed(seeds: DataFrame, first: DataFrame, per_seed: Column | int, row_cap: int | None = 100) -> DataFrame:
    """qid, node_id, take and the first targets of each seed that the limits leave any: ``row_cap`` rows of a question by
    (seed, target), of which ``per_seed`` of each seed."""
    rows = seeds.withColumn("_per", F.lit(per_seed) if isinstance(per_seed, int) else per_seed).groupBy("qid", "node_id").agg(F.max("_per").alias("_per"))
    met = rows.join(first, F.col("node_id") == F.col("src"))
    take = F.least(F.col("_per").cast("long"), F.col("degree"))
    if row_cap is not None:
        # every seed here has an edge, so later ones are past the cap whatever their degrees
        of = W.partitionBy("qid").orderBy("node_id")
        met = met.withColumn("_n", F.row_number().over(of)).filter(F.col("_n") <= row_cap)
        before = F.coalesce(F.sum("degree").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        met = met.withColumn("_before", before)
        take = F.least(take, F.lit(row_cap) - F.col("_before"))
    return met.withColumn("take", take).filter("take > 0").select("qid", "node_id", "take", "targets")


def hop(seeds: DataFrame, lists: dict[str, DataFrame], per_seed: Column | int, row_cap: int | None = 100, block: int = BLOCK) -> DataFrame:
    """qid, target and pos, as ``retrieval.hop`` gives them, from the lists of ``build`` (with the same ``block``)."""
    wanted = owed(seeds, lists["first"], per_seed, row_cap)
    cut_to = lambda n: F.explode(F.slice("targets", F.lit(1), n.cast("int"))).alias("target")
    met = wanted.select("qid", "node_id", cut_to(F.least("take", F.lit(block))))
    most = min([n for n in (per_seed, row_cap) if isinstance(n, int)], default=block + 1)
    if most > block:  # else no seed is owed more than a block
        owing = wanted.filter(F.col("take") > block).select("qid", F.col("node_id").alias("src"), "take")
        more = owing.join(lists["rest"], "src").filter(F.col("block") * block < F.col("take"))
        met = met.union(more.select("qid", F.col("src").alias("node_id"), cut_to(F.least(F.col("take") - F.col("block") * block, F.lit(block)))))
    first = met.groupBy("qid", "target").agg(F.min(F.struct("node_id", "target")).alias("at"))
    return first.select("qid", "target", F.row_number().over(W.partitionBy("qid").orderBy("at")).alias("pos"))

"""Connected components of a link table by alternating stars, each round a few joins and sums over all links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut, drop, tidy


class Forest:
    """Union-find over any hashable items; roots are the smallest items."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars around the smallest member."""
    for b in batches:
        forest = Forest()
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            forest.join(x, y)
        found = np.array([(x, forest.find(x)) for x in forest.up], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _all_stars(edges: DataFrame) -> bool:
    """Whether each id that points anywhere points to one id, which itself points nowhere."""
    both = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not both.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").count()


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least).distinct()
    return cut(small)


def components(links: DataFrame) -> DataFrame:
    """id and component_id (the smallest id reachable) of every id in ``links(a long, b long)``.

    What a round wrote and shuffled goes once the next one stands, so disk doesn't grow with the rounds.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").mapInArrow(_contract, "a long, b long").distinct())
    while not _all_stars(edges):
        before, edges = edges, _round(edges)
        drop(before)
        del before
        tidy(links.sparkSession)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(edges.select("b", "b").distinct())

"""Loading changed documents into a graph: what appears and what vanishes, from the changed chunks alone.

A load brings documents; each takes the place of its earlier chunks. Chunks that come again unchanged don't count. From
the others follow the keys that they touch: nodes, levels, references, terms, buckets of numbers. Each table of the
graph is derived twice, from the chunks before and after, but only from rows with such a key, and the two are compared:

- a node, or a level, from the chunks that share its id, or its key (the first title of a level may go to another chunk);
- a reference or a use of a term if its source changed, or if its target began or ceased to be: then it resolves anew;
- NEXT in the buckets that changed and from the last article of the bucket before, so both neighbours are repaired.

Stored tables are partitioned by a hash of their keys, and a load rewrites the partitions that a change falls into.

Defined cases: a document without new chunks vanishes; loading the same again changes nothing; rows of equal key and order
in one load are told apart as in a build from nothing; an empty load gives empty changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.config import CorpusConfig
from lexmill.operators import graph
from lexmill.session import cut

BUCKET, PARTS = 256, 64
#: The columns by which each table is partitioned.
KEYS = {"Law": ["id"], "Book": ["law_id", "number"], "Part": ["law_id", "book_number", "number"], "Chapter": ["law_id", "book_number", "part_number", "number"], "ExternalLaw": ["description"], "edges": ["src"]}
TEXTS = ("Article", "ArticleSegment", "Definition")


def summed(more: DataFrame, less: DataFrame) -> DataFrame:
    """The rows of which the two don't have the same number, with ``_n``: how many more the first has."""
    both = more.withColumn("_n", F.lit(1)).unionByName(less.withColumn("_n", F.lit(-1)))
    return both.groupBy(*more.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")


def replaced(before: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All chunks after a load, and the rows that it takes away or brings. ``gone(doc_id)`` are documents that vanish."""
    docs = new.select("doc_id") if gone is None else new.select("doc_id").union(gone.select("doc_id"))
    docs = docs.distinct()
    old, new = before.join(docs, "doc_id", "left_semi").select(before.columns), new.select(before.columns)
    after = before.join(docs, "doc_id", "left_anti").select(before.columns).union(new)
    return after, cut(summed(new, old).drop("_n"))


def _next_sources(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """law_id and bucket of numbers whose articles may have another one after them."""
    touched = changed.select("law_id", "_b").distinct()
    sources = [touched]
    for chunks in (before, after):
        of = chunks.select("law_id", "_b").distinct().join(touched.select("law_id").distinct(), "law_id", "left_semi")
        follows = of.withColumn("_next", F.lead("_b").over(W.partitionBy("law_id").orderBy("_b")))
        # a bucket that is empty now or was so before hides behind the one before it
        spans = follows.join(touched.withColumnRenamed("_b", "_t"), "law_id").filter((F.col("_b") < F.col("_t")) & (F.col("_t") <= F.coalesce("_next", F.col("_t"))))
        sources.append(spans.select("law_id", "_b"))
    return reduce(DataFrame.union, sources).distinct()


def _next_edges(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    of = chunks.select("law_id", "_b").distinct().join(sources.select("law_id").distinct(), "law_id", "left_semi")
    follows = of.withColumn("_next", F.lead("_b").over(W.partitionBy("law_id").orderBy("_b"))).join(sources, ["law_id", "_b"], "left_semi")
    wanted = follows.select("law_id", "_b").union(follows.select("law_id", F.col("_next").alias("_b"))).distinct()
    rows = chunks.join(wanted, ["law_id", "_b"], "left_semi")
    own = rows.join(sources, ["law_id", "_b"], "left_semi").select(F.col("node_id").alias("src")).distinct()
    return graph.next_edges(rows, BUCKET).join(own, "src", "left_semi").select("src", "dst", "type", "idx", "total")


def _derived(chunks: DataFrame, changed: DataFrame, sources: DataFrame, config: CorpusConfig) -> dict[str, DataFrame]:
    """The rows of each table that ``changed`` may touch, as ``chunks`` give them."""
    kind = lambda df, k: df.filter(F.col("node_type") == k)
    ids = changed.select("node_id").distinct()
    own = chunks.join(ids, "node_id", "left_semi").select(chunks.columns)
    out = {label: graph.text_nodes(own, label) for label in TEXTS}
    out["Law"] = graph.laws(chunks.join(changed.select("law_id").distinct(), "law_id", "left_semi"), config)
    told = chunks.select(F.explode("external_refs").alias("description"))
    out["ExternalLaw"] = told.join(changed.select(F.explode("external_refs").alias("description")).distinct(), "description", "left_semi").distinct()
    edges = [graph.hierarchy_edges(own).filter("type = 'HAS_ARTICLE'"), graph.external_edges(own)]
    for level in graph.KEYS:
        key = ["law_id", *(f"{x}_number" for x in ("book", "part", "chapter")[: len(graph.KEYS[level]) - 1])]
        rows = chunks.join(changed.select(*key).distinct(), key, "left_semi").select(chunks.columns)
        out[level.capitalize()] = graph.hierarchy_nodes(rows, level)
        edges.append(graph.hierarchy_edges(rows).filter(F.col("type") == f"HAS_{level.upper()}"))
    parent = F.when(F.col("node_type") == "Article", F.col("node_id")).when(F.col("node_type") == "ArticleSegment", F.regexp_replace("node_id", "-seg\\d+$", "")).alias("_parent")
    families = changed.select(parent).filter("_parent IS NOT NULL").distinct()
    edges.append(graph.segment_edges(chunks.withColumn("_parent", parent).join(families, "_parent", "left_semi").select(chunks.columns)))
    numbers = kind(changed, "Article").select("law_id", F.col("article_number").alias("ref")).distinct()
    refs = graph.references(chunks)
    edges.append(graph.resolved_references(refs.join(ids, "node_id", "left_semi").unionByName(refs.join(numbers, ["law_id", "ref"], "left_semi")), chunks))
    names = kind(changed, "Definition").select("law_id", F.col("defined_term").alias("term")).distinct()
    uses = graph.uses(chunks)
    edges.append(graph.resolved_terms(uses.join(ids, "node_id", "left_semi").unionByName(uses.join(names, ["law_id", "term"], "left_semi")), chunks))
    edges.append(_next_edges(_numbered(chunks), sources))
    out["edges"] = reduce(DataFrame.union, [e.select("src", "dst", "type", "idx", "total") for e in edges]).distinct()
    return out


def _numbered(chunks: DataFrame) -> DataFrame:
    return chunks.filter("node_type = 'Article'").withColumn("_b", F.floor(F.col("article_number") / BUCKET))


def changes(before: DataFrame, after: DataFrame, changed: DataFrame, config: CorpusConfig) -> dict[str, DataFrame]:
    """The rows that appear (``_n`` is 1) and vanish (-1) in each table; a node that changes does both."""
    sources = cut(_next_sources(_numbered(before), _numbered(after), _numbered(changed)))
    was, is_ = (_derived(c, changed, sources, config) for c in (before, after))
    return {name: summed(is_[name], was[name]) for name in is_}


def _part(name: str) -> Column:
    return F.pmod(F.xxhash64(*KEYS.get(name, ["node_id"])), F.lit(PARTS)).cast("int")


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Write whole tables, partitioned as loads expect them."""
    for name, df in tables.items():
        df.withColumn("part", _part(name)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")


def apply(spark: SparkSession, path: str, found: dict[str, DataFrame]) -> dict[str, int]:
    """Bring stored tables up to date; returns how many rows appeared or vanished in each. Only partitions with one are read and written."""
    told = {}
    for name, change in found.items():
        signed = cut(change.withColumn("part", _part(name)))
        rows = {r["part"]: r["count"] for r in signed.groupBy("part").count().collect()}  # at most PARTS rows
        told[name] = sum(rows.values())
        if not rows:
            continue
        columns = [c for c in signed.columns if c != "_n"]
        have = spark.read.schema(signed.select(columns).schema).parquet(f"{path}/{name}").filter(F.col("part").isin(sorted(rows))).select(columns)
        kept = have.withColumn("_n", F.lit(1).cast("long")).unionByName(signed).groupBy(*columns).agg(F.sum("_n").alias("_n"))
        result = cut(kept.filter("_n > 0").drop("_n"))
        left = {r["part"] for r in result.select("part").distinct().collect()}
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")
        for part in sorted(set(rows) - left):  # a partition without rows isn't overwritten
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/part={part}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return told


def load(before: DataFrame, new: DataFrame, path: str, config: CorpusConfig, gone: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Load documents into the graph stored under ``path``, which ``before`` gave; returns the chunks after, and the rows touched."""
    after, changed = replaced(before, new, gone)
    return after, apply(before.sparkSession, path, changes(before, after, changed, config))

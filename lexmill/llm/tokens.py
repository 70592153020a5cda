"""Token counts of flat token files without an index, by a scan for the end-of-document identifier.

A file is a run of little-endian unsigned 16-bit identifiers in which ``eos`` ends each document. It is read in
blocks that ignore documents. In every block one vectorised search finds the separators; the block's summary
(separators, last one) goes through a prefix scan over the blocks of its file, in two levels so that no task sees
all blocks of a long file; with the last separator before the block, its first document is stitched.

Defined cases: a document may be empty or span any number of blocks; identifiers after a file's last separator are
one more document, marked as not ended; null or empty texts pack as empty documents; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.common import lean
from lexmill.session import cut

EOS, BLOCK, SUPER = 50256, 1 << 16, 1 << 10
BOM = b"\xef\xbb\xbf"
#: Splits whose places are sent to every task; a row is a path and a few numbers.
BROADCAST_SPLITS = 50_000


def word_tokens(text: str | None) -> np.ndarray:
    """Identifiers of the words of a text: hashes below EOS."""
    return np.fromiter((zlib.crc32(w) % EOS for w in (text or "").encode().split()), np.uint16)


def pack(docs: DataFrame, tokens=word_tokens, block: int = BLOCK) -> DataFrame:
    """Token files of ``docs(doc_id, text)``, one per partition: file_id, block_no, tokens, ended (doc_id of each document that ends in the block)."""
    schema = pa.schema([("file_id", pa.int64()), ("block_no", pa.int64()), ("tokens", pa.binary()), ("ended", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_id, n, parts, held, ended = TaskContext.get().partitionId(), 0, [], 0, []  # ended: (place of the separator, doc_id)

        def full(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n, parts, held, ended
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
            stop = len(flat) if whole else len(flat) // block * block
            for at in range(0, stop, block):
                here = [d for p, d in ended if p < (n + 1) * block]
                ended = ended[len(here) :]
                yield pa.RecordBatch.from_pylist([{"file_id": file_id, "block_no": n, "tokens": flat[at : min(at + block, stop)].tobytes(), "ended": here}], schema=schema)
                n += 1
            parts, held = [flat[stop:]], len(flat) - stop

        at = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = tokens(text.as_py())
                parts += [ids, np.array([EOS], np.uint16)]
                at, held = at + len(ids) + 1, held + len(ids) + 1
                ended.append((at - 1, doc_id))
                if held >= 8 * block:
                    yield from full(False)
        yield from full(True)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "file_id long, block_no long, tokens binary, ended array<long>")


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of flat files of any length, file_id being a file's path.

    Spark's text source splits the files, so any store that Spark reads will do. The newline bytes it cuts at are put
    back; a first pass measures the splits, whose sizes summed per file give their places, which are broadcast up to
    BROADCAST_SPLITS of them and joined beyond; blocks that lie across splits are joined. Only a stretch without a newline byte has to fit into one row. A file whose bytes don't add up
    to its size, or whose size is odd, is an error.
    """
    size = 2 * block
    of = lambda name: F.col(f"_metadata.{name}")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), of("file_path").alias("file_id"), of("file_block_start").alias("start"), of("file_size").alias("size"))
    splits = cut(lines.groupBy("file_id", "size", "start").agg(F.sum(F.octet_length("value").cast("long") + 1).alias("n")))  # a row a split
    file = W.partitionBy("file_id")
    missing = (F.col("size") - F.sum("n").over(file)).alias("missing")
    places = splits.select("*", missing, (F.sum("n").over(file.orderBy("start")) - F.col("n")).alias("upto"), F.min("start").over(file).alias("begin"), F.max("start").over(file).alias("end"))
    bad = places.filter("missing NOT IN (-1, 0, 2, 3) OR size % 2 <> 0").first()
    if bad:
        raise ValueError(f"{bad.file_id}: {bad.size - bad.missing} of {bad.size} bytes read, an even number and all expected")
    # the text source drops a mark at the beginning, and adds a newline to a last line without one
    first, mark = F.col("start") == F.col("begin"), F.col("missing") > 0
    at = F.when(first, 0).otherwise(F.col("upto") + F.when(mark, len(BOM)).otherwise(0))
    places = places.select("file_id", "start", at.cast("long").alias("at"), (first & mark).alias("marked"), ((F.col("start") == F.col("end")) & F.col("missing").isin(-1, 2)).alias("extra"))
    if splits.count() <= BROADCAST_SPLITS:
        met = lines.join(F.broadcast(places), ["file_id", "start"])  # lines stay in order
    else:
        met = lines.withColumn("_line", F.monotonically_increasing_id()).join(places.hint("merge"), ["file_id", "start"]).sortWithinPartitions("file_id", "start", "_line")
    met = met.select("file_id", "start", "size", "value", "at", "marked", "extra")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, at, total, extra = None, bytearray(), 0, 0, False

        def pieces(last: bool) -> Iterator[pa.RecordBatch]:
            """What is held, cut where blocks end; all but the last byte is sure until the split ends."""
            nonlocal at, held
            if last and extra:
                del held[-1]
            done, rows = 0, {k: [] for k in ("block_no", "at", "tokens", "whole")}
            while len(held) > done and (last or len(held) - done > size - at % size):
                part = bytes(held[done : done + size - at % size])
                for k, v in zip(rows, (at // size, at, part, at % size == 0 and (len(part) == size or at + len(part) == total)), strict=True):
                    rows[k].append(v)
                done, at = done + len(part), at + len(part)
            del held[:done]
            if done:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(rows["at"]), pa.string()), *(pa.array(rows[k], t) for k, t in zip(rows, kinds, strict=True))], names=["file_id", *rows])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("file_id", "start", "size", "at", "marked", "extra", "value")]
            for key, group in groupby(zip(*columns, strict=True), key=lambda r: r[:6]):
                if key[:2] != now:
                    if now:
                        yield from pieces(True)
                    now, held = key[:2], bytearray(BOM if key[4] else b"")
                    total, at, extra = key[2], key[3], key[5]
                for *_, line in group:
                    held += line
                    held += b"\n"
                yield from pieces(False)
        if now:
            yield from pieces(True)

    cuts = cut(met.mapInArrow(lean(run), "file_id string, block_no long, at long, tokens binary, whole boolean"))
    parts = F.array_sort(F.collect_list(F.struct("at", "tokens")))
    across = cuts.filter("NOT whole").groupBy("file_id", "block_no").agg(F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["tokens"])).alias("tokens"))
    return cuts.filter("whole").select("file_id", "block_no", "tokens").unionByName(across)


def count_tokens(blocks: DataFrame, eos: int = EOS, block: int = BLOCK) -> DataFrame:
    """One row per document: file_id, ordinal (from 0, in file order), n_tokens (without the separator), ended.

    ``blocks(file_id, block_no, tokens)``: every block of a file but its last has ``block`` identifiers.
    """
    kind = blocks.schema["file_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {k: [] for k in ("n", "first", "last", "stop", "lengths")}
            for no, raw in zip(b.column("block_no").to_pylist(), b.column("tokens"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), np.dtype("<u2"))
                found = np.flatnonzero(ids == eos) + no * block
                rows["n"].append(len(found))
                rows["first"].append(int(found[0]) if len(found) else None)
                rows["last"].append(int(found[-1]) if len(found) else None)
                rows["stop"].append(no * block + len(ids))
                rows["lengths"].append(np.diff(found) - 1)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("block_no"), *(pa.array(rows[k], t) for k, t in zip(rows, kinds, strict=True))], names=["file_id", "block_no", *rows])

    schema = f"file_id {kind}, block_no long, n long, first long, last long, stop long, lengths array<long>"
    summary = cut(blocks.select("file_id", "block_no", "tokens").mapInArrow(lean(scan), schema)).withColumn("part", F.floor(F.col("block_no") / SUPER))
    before = lambda w, order: w.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parts = summary.groupBy("file_id", "part").agg(F.sum("n").alias("part_n"), F.max("last").alias("part_last"), F.max("stop").alias("part_stop"))
    w = before(W.partitionBy("file_id"), "part")
    parts = parts.select(
        "file_id", "part", F.coalesce(F.sum("part_n").over(w), F.lit(0)).alias("n0"), F.max("part_last").over(w).alias("last0"), F.lead("part").over(W.partitionBy("file_id").orderBy("part")).isNull().alias("ends")
    )
    w = before(W.partitionBy("file_id", "part"), "block_no")
    known = summary.select(
        "*", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n1"), F.max("last").over(w).alias("last1"), F.lead("block_no").over(W.partitionBy("file_id", "part").orderBy("block_no")).isNull().alias("last_block")
    ).join(parts, ["file_id", "part"])
    past = F.coalesce("last1", "last0", F.lit(-1))
    tail = F.col("stop") - 1 - F.coalesce("last", past)
    lengths = F.when(F.col("n") > 0, F.concat(F.array(F.col("first") - past - 1), "lengths")).otherwise(F.array().cast("array<long>"))
    open_end = F.col("ends") & F.col("last_block") & (tail > 0)
    found = known.select("file_id", (F.col("n0") + F.col("n1")).alias("base"), "n", F.when(open_end, F.concat(lengths, F.array(tail))).otherwise(lengths).alias("lengths"))
    return found.select("file_id", "base", "n", F.posexplode("lengths").alias("i", "n_tokens")).select("file_id", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens", (F.col("i") < F.col("n")).alias("ended"))


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs``, counted in the packed files by the scan."""
    blocks = cut(pack(docs))
    counts = count_tokens(blocks)
    w = W.partitionBy("file_id", "part").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    sizes = blocks.select("file_id", "block_no", "ended", F.floor(F.col("block_no") / SUPER).alias("part"), F.size("ended").alias("n"))
    parts = sizes.groupBy("file_id", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("file_id", "part", F.coalesce(F.sum("n").over(W.partitionBy("file_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    names = sizes.withColumn("n1", F.coalesce(F.sum("n").over(w), F.lit(0))).join(parts, ["file_id", "part"])
    names = names.select("file_id", (F.col("n0") + F.col("n1")).alias("base"), F.posexplode("ended").alias("i", "doc_id")).select("file_id", (F.col("base") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(counts, ["file_id", "ordinal"]).select("doc_id", "n_tokens")


SQL = r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents"

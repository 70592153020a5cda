"""Packed chunks of documents and questions about keys that all chunks share.

A chunk is a run of rows as one Arrow message, so tasks work on whole arrays. To learn something about keys across
the corpus, every chunk sends its distinct keys, dealt by value over buckets, as one packed row per bucket; a task
that owns a bucket sees the keys of all chunks and answers each chunk with packed bits in the order asked. A key
is asked at most once per chunk, however often it occurs, so frequent keys weigh no more than rare ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import lean
from lexmill.session import cut

#: Buckets per shuffle partition. A chunk holds CHUNK_BYTES of text, more where there are many buckets, so that its message
#: to each stays worth a row and their number doesn't grow with the square of the input; MOST_BYTES is what a task can hold.
PER_PARTITION, CHUNK_BYTES, BYTES_PER_BUCKET, MOST_BYTES = 4, 2 << 20, 4 << 10, 32 << 20
SMALL = pa.ipc.IpcWriteOptions(compression="zstd")


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=SMALL) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes | pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(raw) as r:
        return r.read_next_batch()


def tie_of(text: str | None) -> int:
    """Orders rows that repeat an id; equal texts are interchangeable."""
    return 0 if text is None else xxhash.xxh3_64_intdigest(text.encode()) >> 1


def pack(docs: DataFrame) -> DataFrame:
    """``chunk, payload``, written and partitioned by chunk, so that answers come to it and it never moves again: rows of ``docs(doc_id, text, ...)`` in chunks, ordered by doc_id (null first) and text inside each."""

    bytes_ = min(max(CHUNK_BYTES, partitions(docs) * PER_PARTITION * BYTES_PER_BUCKET), MOST_BYTES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            nonlocal held, size, n
            whole = pa.Table.from_batches(held).combine_chunks()
            whole = whole.append_column("_tie", pa.array(map(tie_of, whole["text"].to_pylist()), pa.int64()))
            order = pc.sort_indices(whole, sort_keys=[("doc_id", "ascending"), ("_tie", "ascending")], null_placement="at_start")
            held, size, n = [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([packed(whole.take(order).combine_chunks().to_batches()[0])], pa.binary())], names=["chunk", "payload"])

        for b in batches:
            at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)) if b.num_rows else []
            while at < b.num_rows:  # a chunk takes what fits, at least one row
                done = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + bytes_ - size, "right")))
                held.append(b.slice(at, stop - at))
                size += int(ends[stop - 1]) - done
                at = stop
                if size >= bytes_ or at < b.num_rows:
                    yield chunk()
        if held:
            yield chunk()

    return cut(docs.mapInArrow(lean(run), "chunk long, payload binary").repartition(partitions(docs), "chunk"), placed=True)


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bounds of each text's words in the flat sequence, the words as codes, the distinct words.

    Words are runs of anything but space and U+0009 to U+000D; ``lower`` lowers A to Z only.
    """
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = split.flatten().dictionary_encode()
    codes, distinct = flat.indices.to_numpy(), flat.dictionary
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    if (empty := pc.index(distinct, "").as_py()) >= 0:  # left by white space at either end
        real = codes != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return bounds, codes, distinct


def hashes(distinct: pa.Array) -> np.ndarray:
    """Two 64-bit hashes per word."""
    _, offsets, data = distinct.buffers()
    at = np.frombuffer(offsets, np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].tolist()
    raw, digest = memoryview(data or b""), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]), np.uint64).reshape(-1, 2)


def order_by(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by row, then key (64 bits): both in one integer, which sorts faster; in full if that leaves keys tied."""
    bits = np.uint64(int(rows.max()).bit_length() if len(rows) else 0)
    both = rows.astype(np.uint64) << (np.uint64(64) - bits) | key >> bits if bits else key
    order = np.argsort(both)
    tied = both[order[1:]] == both[order[:-1]]
    if bits and (key[order[1:]][tied] != key[order[:-1]][tied]).any():
        return np.lexsort((key, rows))
    return order


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiplications wrap)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encoded(rows: np.ndarray) -> bytes:
    """Rows of a message, field by field and byte by byte: differences of the first, sorted field, then the others."""
    fields = [rows[f] for f in rows.dtype.names] if rows.dtype.names else [rows]
    fields[0] = np.diff(fields[0], prepend=fields[0].dtype.type(0))
    planes = [np.ascontiguousarray(np.ascontiguousarray(f).view(np.uint8).reshape(len(rows), -1).T).tobytes() for f in fields]
    return len(rows).to_bytes(4, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def decoded(raw: bytes, kind: np.dtype) -> np.ndarray:
    n, at = int.from_bytes(raw[:4], "little"), 0
    flat = np.frombuffer(pa.decompress(raw[4:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    rows = np.empty(n, kind)
    for i, f in enumerate(kind.names or [None]):
        own = kind[f] if f else kind
        part = np.ascontiguousarray(flat[at : at + n * own.itemsize].reshape(own.itemsize, n).T).view(own)[:, 0]
        at += n * own.itemsize
        part = np.cumsum(part, dtype=own) if i == 0 else part
        if f:
            rows[f] = part
        else:
            rows = part
    return rows


ASKED = "bucket int, chunk long, keys binary"


def ask(chunk: int, first: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket of a chunk's keys. ``first`` is sorted and deals them; ``rows`` is what is sent of each,
    its first field (or all of it) sorted as well."""
    if len(first):
        of = bucket_of(first, buckets)
        order = np.argsort(of, kind="stable")
        found, starts = np.unique(of[order], return_index=True)
        sent = [encoded(rows[order[a:b]]) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), chunk), pa.int64()), pa.array(sent, pa.binary())], names=["bucket", "chunk", "keys"])


def bucket_of(first: np.ndarray, buckets: int) -> np.ndarray:
    return ((first >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def answers(asked: DataFrame, kind: np.dtype, decide: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``chunk, answer``: what ``decide(rows, chunk numbers)`` marks among all rows of a bucket, packed per chunk.

    A task holds one bucket at a time; there are PER_PARTITION buckets per shuffle partition.
    """
    n = partitions(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def bucket() -> pa.RecordBatch:
            parts = [decoded(raw, kind) for _, raw in held]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            marks = decide(np.concatenate(parts), np.repeat(np.arange(len(parts)), np.diff(bounds)))
            bits = [np.packbits(marks[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([now] * len(held), pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])

        for b in batches:
            for i, (own, chunk) in enumerate(zip(b.column("bucket").to_pylist(), b.column("chunk").to_pylist(), strict=True)):
                if own != now and held:
                    yield bucket()
                    held = []
                now = own
                held.append((chunk, b.column("keys")[i].as_py()))
        if held:
            yield bucket()

    told = asked.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(run), "chunk long, bucket int, bits binary")
    return told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answer"))  # a short row per bucket


def marked(first: np.ndarray, answer: list[dict] | None, buckets: int) -> np.ndarray:
    """The answer's marks in the order of ``first``, as it was asked."""
    out = np.zeros(len(first), bool)
    if len(first):
        of = bucket_of(first, buckets)
        order = np.argsort(of, kind="stable")
        found, counts = np.unique(of[order], return_counts=True)
        bits = {a["bucket"]: a["bits"] for a in answer or []}
        out[order] = np.concatenate([np.unpackbits(np.frombuffer(bits[k], np.uint8), count=c).astype(bool) for k, c in zip(found.tolist(), counts.tolist(), strict=True)])
    return out


def each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of chunk tables; payloads as buffers."""
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_buffer() if c == "payload" else b.column(c)[i].as_py() for c in b.schema.names}


SLICED = "slice int, counts binary"


def sliced(sums: np.ndarray, slices: int) -> pa.RecordBatch:
    """A float64 array, along its last axis, as packed rows that can be added up apart."""
    parts = np.split(sums, slices, axis=-1)
    return pa.RecordBatch.from_pydict({"slice": pa.array(range(slices), pa.int32()), "counts": [pa.compress(np.ascontiguousarray(p).tobytes(), "zstd", asbytes=True) for p in parts]})


def totals(partial: DataFrame, shape: tuple[int, ...], slices: int) -> np.ndarray:
    """The sum of all sliced arrays. Slices are added up in parallel, as they stream by; the driver gets one array of the given size."""
    own = (*shape[:-1], shape[-1] // slices)
    size = int(np.prod(own)) * 8

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True))
        if held:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(held, pa.int32()), "counts": [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in held.values()]})

    out = np.zeros(shape)
    for r in partial.repartition(max(1, slices // 4), "slice").mapInArrow(lean(add), SLICED).collect():
        out[..., r["slice"] * own[-1] : (r["slice"] + 1) * own[-1]] = np.frombuffer(pa.decompress(bytes(r["counts"]), size, "zstd", asbytes=True)).reshape(own)
    return out

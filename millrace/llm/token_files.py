"""Token ids in files of fixed-width bits.

A file row is a block: whole documents in order, their ids packed with ``bits`` bits each (the minimum for the
vocabulary), and the offset of each document, so that any document or id can be unpacked by itself: id i of a block is at
bit i * bits. Blocks are written by Spark's own writer, which works on any store and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.text import byte_texts
from millrace.llm.tokens import encoder

SCHEMA = "shard int, block int, first long, n long, bits int, doc_ids array<long>, offsets array<long>, payload binary"


def width(vocabulary: int) -> int:
    """Bits that the largest id needs."""
    return max(int(vocabulary - 1).bit_length(), 1)


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, the lowest bit first; the last byte is filled with zeros."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    out = []
    for lo in range(0, len(ids), 1 << 16):  # a multiple of 8 ids, so each part ends at a byte
        planes = ids[lo:lo + (1 << 16)].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(planes, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a payload; only their bytes are touched."""
    if n <= 0:
        return np.zeros(0, np.uint32)
    data, place = np.frombuffer(payload, np.uint8), start * bits
    at = place + np.arange(n, dtype=np.int64) * bits
    first = at >> 3
    lo, hi = int(first[0]), min(int(first[-1]) + 8, len(data))
    part = np.concatenate([data[lo:hi], np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):  # the bytes that one id can touch
        word |= part[first - lo + k] << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, spaced: bool = False, block: int = 1 << 16) -> None:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, and write blocks in ascending doc_id order.

    Null text is empty (the end id alone); null doc_ids come first; equal doc_ids stand in the order of their texts'
    hashes. A block closes after ``block`` ids; a longer document is a block of its own. An empty table writes no block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, spaced)
        bits, shard, number, first = width(max(encode.size, end_id + 1)), TaskContext.get().partitionId(), 0, 0
        end = int(end_id).to_bytes(4, "little")
        docs_: list = []
        offsets: list[int] = []
        parts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            payload = pack_bits(np.frombuffer(b"".join(parts), "<u4"), bits)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([bits], pa.int32()),
                pa.array([docs_], pa.list_(pa.int64())), pa.array([[*offsets, held]], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ], ["shard", "block", "first", "n", "bits", "doc_ids", "offsets", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                packed = encode.encode(text.decode("utf-8", "replace")) + end
                docs_.append(doc)
                offsets.append(held)
                parts.append(packed)
                held += len(packed) // 4
                if held >= block:
                    yield row()
                    number, first, held, docs_, offsets, parts = number + 1, first + held, 0, [], [], []
        if docs_:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SCHEMA).write.parquet(folder)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``start``: ids of all blocks before. Shards follow each other as their documents do."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    totals = rows.groupBy("shard").agg(F.sum("n").alias("total"))  # a row per task that wrote
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                edges = row["offsets"]
                ids = unpack_bits(row["payload"], row["bits"], 0, row["n"]).astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["start"] + a for a in edges[:-1]], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return blocks(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def ids_of(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document (of each row of that doc_id), unpacked without the rest of its block."""
    out = []
    for row in blocks(spark, folder).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("start").collect():
        for i, doc in enumerate(row["doc_ids"]):
            if doc == doc_id:
                out.append(unpack_bits(row["payload"], row["bits"], row["offsets"][i], row["offsets"][i + 1] - row["offsets"][i]))
    return out

"""Best-fit packing of token sequences by the configuration linear program over the length histogram.

The program has a row per length and a column per configuration (a multiset of lengths that fits into one sequence).
Multiplicative weights solve it: a weight per length prices the configurations, a knapsack dynamic program finds the
best one, it is used for a small share of the copies still open, and the weights of the lengths it covers fall. The
fractional solution is rounded down, what is left goes through the program again, and the last few pieces are placed
best-fit by decreasing length. All of this sees the histogram only (as many numbers as a sequence has tokens), so its
cost is the same for any number of documents; the pieces themselves are ranked and placed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import byte_texts
from millrace.llm.tokens import encoder
from millrace.session import cut_lineage


def best_configuration(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length stands in the most valuable configuration (unbounded knapsack over all fillings)."""
    worth = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        n = ends[room]
        if n:
            gains = worth[room - lengths[:n]] + values[:n]
            i = int(gains.argmax())
            if gains[i] > worth[room - 1]:
                worth[room], last[room] = gains[i], i
                continue
        worth[room] = worth[room - 1]
    times, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            times[last[room]] += 1
            room -= lengths[last[room]]
    return times


def _round(lengths: np.ndarray, open_: np.ndarray, capacity: int, steps: int, rate: float, eta: float = 0.05, tilt: float = 0.3) -> list[tuple[np.ndarray, float]]:
    """Multiplicative weights on the covering program: configurations and how many copies of each, fractional.

    Weights start a little steeper (``tilt``) than the lengths themselves: by length alone all full sequences are worth
    the same, and short pieces would be spent on each other instead of beside long ones. Every step covers at most the
    share ``rate`` of the copies of the lengths it uses, and lowers their weights by ``eta`` times what it covers.
    """
    left, found = open_.astype(float), []
    cover = np.zeros(len(lengths))
    for _ in range(steps):
        live = left > 1e-9
        if not live.any():
            break
        use = np.flatnonzero(live)
        price = lengths[use] * (1 + tilt * lengths[use] / capacity) * np.exp(-eta * cover[use])
        times = best_configuration(price, lengths[use], capacity)
        hit = np.flatnonzero(times)
        copies = max(float((left[use][hit] / times[hit]).min()), 0.0)
        share = float((open_[use][hit] / times[hit]).min())
        copies = min(copies, max(1.0, rate * share))
        full = np.zeros(len(lengths), np.int64)
        full[use] = times
        left -= full * copies
        cover += full * copies / np.maximum(open_, 1)
        found.append((full, copies))
    return found


def plan(histogram: dict[int, int], capacity: int, steps: int = 2500, rate: float = 0.5, rounds: int = 3) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: times} with the number of sequences that use each; covers the histogram exactly."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    open_ = np.array([histogram[int(k)] for k in lengths], np.int64)
    out: list[tuple[dict[int, int], int]] = []

    def use(times: np.ndarray, copies: int) -> None:
        out.append(({int(lengths[i]): int(times[i]) for i in np.flatnonzero(times)}, copies))

    for _ in range(rounds):
        if open_.sum() <= 64:
            break
        before = open_.sum()
        for times, share in _round(lengths, open_, capacity, steps, rate):
            hit = np.flatnonzero(times)
            copies = min(int(share + 1e-9), int((open_[hit] // times[hit]).min()))
            if copies > 0:
                use(times, copies)
                open_ = open_ - times * copies
        if open_.sum() == before:
            break
    out += best_fit(lengths, open_, capacity)
    return out


def best_fit(lengths: np.ndarray, open_: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each piece into the fullest sequence that still has room; many equal pieces go together."""
    bins: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]  # by room left
    for i in np.argsort(-lengths):
        size, n = int(lengths[i]), int(open_[i])
        room = size
        while n and room <= capacity:
            if not bins[room]:
                room += 1
                continue
            content, copies = bins[room].pop()
            each = min(room // size, n) if copies == 1 else room // size
            if copies > 1 and n < copies * each:  # part of these sequences is enough
                each = max(1, min(each, n // copies))
                if n < copies:
                    bins[room].append((content, copies - n))
                    copies, each = n, 1
            n -= each * copies
            bins[room - each * size].append((content | {size: content.get(size, 0) + each}, copies))
        per = capacity // size
        if n // per:
            bins[capacity - per * size].append(({size: per}, n // per))
        if n % per:
            bins[capacity - (n % per) * size].append(({size: n % per}, 1))
    return [x for room in bins for x in room]


class Layout:
    """For each length, where its pieces go by rank: segments (first rank, first sequence, offset, times)."""

    def __init__(self, configurations: list[tuple[dict[int, int], int]]):
        segments: dict[int, list[tuple[int, int, int, int]]] = {}
        count: dict[int, int] = {}
        self.sequences = 0
        for content, copies in configurations:
            offset = 0
            for size in sorted(content, reverse=True):
                segments.setdefault(size, []).append((count.get(size, 0), self.sequences, offset, content[size]))
                count[size] = count.get(size, 0) + copies * content[size]
                offset += size * content[size]
            self.sequences += copies
        self.segments = {k: np.array(v, np.int64) for k, v in segments.items()}

    def place(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of one length."""
        table = self.segments[size]
        first, sequence, offset, times = table[np.searchsorted(table[:, 0], rank, "right") - 1].T
        return sequence + (rank - first) // times, offset + (rank - first) % times * size


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, spaced: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): each text's ids and the end id, cut if too long.

    Null text is empty (the end id alone). Only a document of more than ``capacity`` ids is cut; its first piece takes
    the remainder, so all others are full.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, spaced).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                docs_, piece, start, size, ids = [], [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                    packed = encode(text.decode("utf-8", "replace")) + end
                    n = len(packed) // 4
                    lo, k = 0, 0
                    while lo < n:
                        hi = lo + ((n - 1) % capacity + 1 if k == 0 else capacity)
                        docs_.append(doc), piece.append(k), start.append(lo), size.append(hi - lo), ids.append(packed[4 * lo:4 * hi])
                        lo, k = hi, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = 1024, length: str = "length") -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``: places in sequences of ``capacity``, gapless from 0.

    ``length`` is a column of 1 to ``capacity``; null or other lengths get null places. Pieces of full length get
    negative sequence ids, the others ids from 0. Equal rows are separate pieces. An empty table gives no rows. Carry
    only slim columns: the rows are written once to the shared folder and shuffled once.
    """
    pieces = pieces.drop("sequence_id", "offset", "_pos")
    held = cut_lineage(pieces.withColumn("_pos", F.monotonically_increasing_id()))
    shard, size = F.shiftright("_pos", 33), F.col(f"`{length}`")
    mixed = held.where((size > 0) & (size < capacity)).withColumn("_shard", shard)
    counts = cut_lineage(mixed.groupBy("_shard", size.alias("_size")).agg(F.count("*").alias("_n")))
    histogram = {r["_size"]: r["n"] for r in counts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}  # at most capacity - 1 rows
    layout = Layout(plan(histogram, capacity))
    before = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("_size").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("_shard").alias("_s"), "_size", F.coalesce("_first", F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_shard", size).orderBy("_pos")) - 1
    ranked = mixed.withColumn("_in", inside).join(before, (F.col("_shard") == F.col("_s")) & (size == F.col("_size"))).withColumn("_rank", F.col("_first") + F.col("_in"))
    columns = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    place = held.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column(length).to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            order = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.diff(sizes[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    sequence[rows], offset[rows] = place.value.place(int(sizes[rows[0]]), ranks[rows])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    placed = ranked.select(*(f"`{c}`" for c in columns), "_rank").mapInArrow(run, schema)
    full = held.where(size == capacity).select(*(f"`{c}`" for c in columns), (-F.col("_pos") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    odd = held.where(size.isNull() | (size <= 0) | (size > capacity)).select(*(f"`{c}`" for c in columns), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return placed.unionByName(full).unionByName(odd)

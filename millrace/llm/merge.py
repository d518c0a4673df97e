"""Add up large arrays that many tasks produce, without bringing them to one task or the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in one piece of an array: a row of 64 KB.
PIECE = 8192


def pieces(values: np.ndarray, shard: int) -> pa.RecordBatch:
    """A task's array as rows piece, shard, values (float64 bytes)."""
    flat = np.ascontiguousarray(values, np.float64).ravel()
    cut = [flat[i:i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([shard] * len(cut), pa.int32()), pa.array(cut, pa.binary())], ["piece", "shard", "values"])


SCHEMA = "piece int, shard int, values binary"


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for piece, shard, values in zip(*(c.to_pylist() for c in batch.columns)):
            values = np.frombuffer(values)
            sums[piece, shard] = sums[piece, shard] + values if (piece, shard) in sums else values
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["piece", "shard", "values"])


def total(rows: DataFrame, size: int, groups: int = 16) -> np.ndarray:
    """The sum of all arrays of ``size`` numbers; the driver gets one array's size.

    The rows of a piece are first added in ``groups`` parts, then the parts; each step streams its rows.
    """
    parts = rows.withColumn("shard", F.pmod("shard", F.lit(groups))).repartition("piece", "shard").mapInArrow(_add, SCHEMA)
    whole = parts.withColumn("shard", F.lit(0)).repartition("piece").sortWithinPartitions("piece").mapInArrow(_add, SCHEMA)
    out = np.zeros(size)
    for row in whole.collect():
        values = np.frombuffer(row["values"])
        out[row["piece"] * PIECE:row["piece"] * PIECE + len(values)] += values
    return out

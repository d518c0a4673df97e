"""Structured Streaming: sources, windows, sessions, stateful stops, stream-table joins."""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.spec import as_list, ident
from millrace.session import shared_folder

_KEY, _BUCKET = "__key", "__bucket"
_FRESH = (float("nan"), 0.0, 0.0)  # last time, sum and number of intervals


def follow(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", files_per_trigger: int | None = None, **options) -> DataFrame:
    """Follow a growing folder of files."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_available(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process what is there, write it as Parquet to the shared folder and read it back.

    Offsets, state and the sink's log live in that folder, so a restarted query goes on
    without losing or repeating rows. ``update`` and ``complete`` results go through
    foreachBatch, each batch in its own folder: the file sink only appends.
    """
    spark = stream.sparkSession
    base = path or os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    sink, log = os.path.join(base, "data"), os.path.join(base, "checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", sink).start()
    else:
        def put(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(os.path.join(sink, f"batch={epoch}"))
        query = writer.foreachBatch(put).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    out = spark.read.schema(T.StructType([*stream.schema.fields, *([T.StructField("batch", T.LongType())] if mode != "append" else [])])).parquet(sink)
    if mode == "complete":  # the last batch holds the whole result
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == last)
    return out.drop("batch")


def windowed(stream: DataFrame, time: str, size: str, aggs: dict, by=None, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Tumbling or sliding time windows with a watermark: start, end, keys, aggregates."""
    win = F.window(ident(time), size, slide) if slide else F.window(ident(time), size)
    grouped = stream.withWatermark(time, late).groupBy(win, *[ident(k) for k in as_list(by)])
    out = grouped.agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[ident(k) for k in as_list(by)], *aggs)


def sessions(stream: DataFrame, time: str, gap_seconds: float, aggs: dict, by=None, late: str = "0 seconds") -> DataFrame:
    """Running periods of each key: a stop begins where the next row is ``gap_seconds`` or more away.

    Spark keeps rows exactly one gap apart together, hence the microsecond less.
    """
    gap = f"{round(gap_seconds * 1_000_000) - 1} microseconds"
    # a session needs a key on a stream: without one, a value that is always 0
    keys = [ident(k) for k in as_list(by)] or [F.pmod(F.hash(ident(time)), F.lit(1))]
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(ident(time), gap), *keys)
    out = grouped.agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("session_window.start").alias("start"), *[ident(k) for k in as_list(by)], *aggs)


def _stops(times: np.ndarray, last: float, total: float, n: float, ratio: float) -> tuple[list[int], float, float, float]:
    """Flags of rows in order, and the state after them: last time, sum and number of intervals since the last stop."""
    flags = []
    for t in times.tolist():
        gap, stop = t - last, False
        if gap < 0:
            flags.append(0)
            continue
        if gap == gap:
            mean = total / n if n else 0.0
            stop = mean != 0 and gap / mean >= ratio
            total, n = (gap, 1.0) if n == 0 or stop else (total + gap, n + 1)
        flags.append(int(stop))
        last = t
    return flags, last, total, n


def _key_text(stream: DataFrame, keys: list[str]) -> Column:
    """One text per key: NULL, NaN and every other value stay apart, 0.0 and -0.0 do not."""
    parts = []
    for i, k in enumerate(keys):
        kind, c = stream.schema[k].dataType, ident(k)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0).cast(kind)
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, T.BinaryType):
            c = F.hex(c)
        parts.append((c if isinstance(kind, (T.ArrayType, T.StructType)) else c.cast("string")).alias(f"k{i}"))
    return F.to_json(F.struct(*parts))


def dynamic_stops(stream: DataFrame, time: str, ratio: float, by, name: str = "stop_ends", late: str | None = None, idle_seconds: float | None = None, buckets: int = 512) -> DataFrame:
    """Stateful stops of a stream: a row ends a stop when its interval to the row before reaches
    ``ratio`` times the mean interval since the last stop.

    State per key: last time, sum and number of intervals. Without ``late``, rows are taken to arrive in time order per
    key; each trigger sorts its own rows, and a row older than the last one of its key ends no stop and leaves the state
    as it is.

    With ``late`` (such as "1 hour", the delay of the watermark) a row waits in its key's state until the watermark has
    passed it, so no earlier row can come any more, and rows go out in time order. Rows that come later than that are
    dropped, and rows without a time with them. A key whose last row lies ``idle_seconds`` behind the watermark is
    forgotten: its next row is a first one. Whole numbers travel as text, since pandas would turn nullable ones into
    floats.

    Keys are hashed into ``buckets`` whose keys share one entry of the state store, so that the cost of a call is not
    paid per key. The number may not change while a query goes on from its log.
    """
    keys = as_list(by)
    given = stream.schema
    whole = [f.name for f in given.fields if isinstance(f.dataType, T.IntegralType)]
    if time in whole:
        raise ValueError(f"{time} has to be a time column")
    stream = stream.withColumns({c: ident(c).cast("string") for c in whole})
    out = T.StructType([*stream.schema.fields, T.StructField(name, T.IntegerType())])
    kept = T.StructType([T.StructField("held", T.BinaryType())])
    columns = stream.columns
    bucket = F.pmod(F.xxhash64(_KEY), F.lit(buckets)).cast("int")
    stream = stream.withColumn(_KEY, _key_text(stream, keys)).withColumn(_BUCKET, bucket)

    def seconds(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[time].astype("int64").to_numpy() / _unit(pdf[time])

    def load(state: GroupState) -> tuple[dict[str, tuple[float, float, float]], pd.DataFrame | None]:
        """The state of each key, and the waiting rows."""
        return pickle.loads(state.get[0]) if state.exists else ({}, None)  # written by this function's callers

    def flagged(rows: pd.DataFrame, seen: dict) -> Iterator[pd.DataFrame]:
        """Rows in order of key and time with their flags; moves the states in ``seen`` on."""
        if not len(rows):
            return
        times, key = seconds(rows), rows[_KEY].to_numpy()
        starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        flags = []
        for a, b in zip(starts[:-1], starts[1:]):
            found, *seen[key[a]] = _stops(times[a:b], *seen.get(key[a], _FRESH), ratio)
            flags += found
        yield rows[columns].assign(**{name: flags})

    def walk(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, _ = load(state)
        yield from flagged(pd.concat(list(batches)).sort_values([_KEY, time], kind="stable"), seen)
        state.update((pickle.dumps((seen, None)),))

    def ordered(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = load(state)
        parts = [held] if held is not None else []
        if not state.hasTimedOut:
            parts += list(batches)
        passed = state.getCurrentWatermarkMs()
        due = []  # when something is to be done again
        waiting = set()
        if parts:
            rows = pd.concat(parts)
            ready = seconds(rows) * 1000 <= passed
            yield from flagged(rows[ready].sort_values([_KEY, time, *[c for c in columns if c != time]], kind="stable"), seen)
            held = rows[~ready].reset_index(drop=True) if not ready.all() else None
            if held is not None:
                due.append(int(seconds(held).min() * 1000))
                waiting = set(held[_KEY])
        if idle_seconds is not None:
            for k in [k for k in seen if k not in waiting]:
                if (seen[k][0] + idle_seconds) * 1000 <= passed:
                    del seen[k]
                else:
                    due.append(int((seen[k][0] + idle_seconds) * 1000))
        if not seen and held is None:
            state.remove()
            return
        state.update((pickle.dumps((seen, held)),))
        if due:
            state.setTimeoutTimestamp(max(min(due), passed + 1))

    if late is None:
        done = stream.groupBy(_BUCKET).applyInPandasWithState(walk, out, kept, "append", GroupStateTimeout.NoTimeout)
    else:
        grouped = stream.withWatermark(time, late).groupBy(_BUCKET)
        done = grouped.applyInPandasWithState(ordered, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return done.withColumns({c: ident(c).cast(given[c].dataType) for c in whole})


def _unit(times: pd.Series) -> float:
    """Ticks per second of a pandas time column."""
    return {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[getattr(times.dt, "unit", "ns")]


def join_table(stream: DataFrame, ref: DataFrame, by, ref_by=None, fields=None, left: bool = False) -> DataFrame:
    """Stream-table join; the table is read anew for each trigger."""
    from millrace.operators.joins import join

    return join(stream, ref, by, ref_by, fields, left=left, unique=False)


def each_batch(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Run an order-dependent batch operator on every trigger's rows; each batch overwrites its own folder,
    so a repeated batch leaves no duplicates."""
    spark = stream.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        fn(batch).write.mode("overwrite").parquet(os.path.join(path, "data", f"batch={epoch}"))

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", os.path.join(path, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(os.path.join(path, "data"))

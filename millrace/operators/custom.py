"""Functions of the user's own over rows, over the rows of a key in order, and from one row to many.

A function sees Arrow batches and returns Arrow batches, or it is a Python table function. Rows stream through it: a key
of any size is walked by one function call, since each row may depend on the one before, but never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from millrace.functions.spec import as_list, ident, order_keys

Batches = Iterable[pa.RecordBatch]


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def run_function(df: DataFrame, fn: Callable[[Batches], Batches], schema: str | T.StructType, columns=None) -> DataFrame:
    """``fn`` over the rows as they come: an iterator of batches of a partition in, one out.

    ``columns``: what the function reads; no other column is sent. The function must not rely on how rows are divided.
    """
    seen = df.select(*[ident(c) for c in as_list(columns)]) if columns else df
    return seen.mapInArrow(fn, _schema(schema))


def _breaks(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Rows that differ from the row before in a key, null being equal to null."""
    changed = None
    for k in keys:
        column = batch.column(k)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        changed = differs if changed is None else pc.or_(changed, differs)
    return [i + 1 for i, x in enumerate(changed.to_pylist()) if x] if changed is not None else []


def _by_key(batches: Batches, keys: list[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Sorted batches as (key, batches of that key), like itertools.groupby: what is left of a key is passed over."""
    def parts() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            cuts = [0, *_breaks(batch, keys), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield tuple(batch.column(k)[lo].as_py() for k in keys), batch.slice(lo, hi - lo)

    rest = parts()
    ahead = next(rest, None)

    def chunks(key: tuple) -> Iterator[pa.RecordBatch]:
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            batch = ahead[1]
            ahead = next(rest, None)
            yield batch

    while ahead is not None:
        key = ahead[0]
        own = chunks(key)
        yield key, own
        for _ in own:
            pass


def key_blocks(df: DataFrame, keys, order, fn: Callable[[tuple, Iterator[pa.RecordBatch]], Batches], schema: str | T.StructType, columns=None) -> DataFrame:
    """``fn(key, batches)`` once per key, with the key's rows in order, in batches; its batches are the result.

    ``order`` as in every ordered operator (``time``, ``value%nr``). Keys are hashed to tasks, a task sorts its rows
    and streams them, so many small keys share a task and a large one never sits in memory. ``columns``: what the
    function reads beside the keys.
    """
    keys, sort = as_list(keys), order_keys(order)
    if not keys:
        raise ValueError("key_blocks needs a key; run_function takes rows without one")
    by = [ident(k) for k in keys]
    ordered = df.repartition(*by).sortWithinPartitions(*by, *[k.sort() for k in sort])
    if columns:
        ordered = ordered.select(*[ident(c) for c in dict.fromkeys([*keys, *as_list(columns)])])

    def run(batches: Batches) -> Batches:
        for key, own in _by_key(batches, keys):
            yield from fn(key, own)

    return ordered.mapInArrow(run, _schema(schema))


def table_function(df: DataFrame, handler: type, schema: str | T.StructType, keys=None, order=None) -> DataFrame:
    """A Python table function: ``handler.eval(row)`` may yield any number of rows for each row of ``df``, and
    ``handler.terminate()`` more at the end.

    With ``keys`` one handler sees all rows of a key, in ``order`` (names, ``name%r`` for falling), one after the other,
    so it may keep state; without, every row stands for itself.
    """
    table = df.asTable()
    keys = as_list(keys)
    if keys:
        table = table.partitionBy(*[ident(k) for k in keys])
        if order:
            table = table.orderBy(*[k.sort() for k in order_keys(order)])
    elif order:
        raise ValueError("an order needs keys")
    return udtf(handler, returnType=_schema(schema))(table)

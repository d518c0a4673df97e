"""Pivot, unpivot, transpose and combinations."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spec import as_list, expand, ident, order_keys
from millrace.plans.ordered import RN, join_keys, number_rows, result_tasks, with_row
from millrace.session import setting


def _values(df: DataFrame, column: str, values) -> list:
    """Pivot values: given, or looked up within spark.sql.pivotMaxValues."""
    if values is not None:
        return list(values)
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = [r[0] for r in df.select(ident(column)).distinct().orderBy(ident(column)).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values; pass values=")
    return found


def _named(values) -> list[str]:
    return ["null" if v is None else str(v) for v in values]


def long_to_wide(df: DataFrame, column: str, field: str, by=None, fill=None, values=None) -> DataFrame:
    """Values of ``column`` become columns that hold ``field``."""
    keys, found = as_list(by), _values(df, column, values)
    return _spread(df, keys, column, field, found, fill)


def _spread(df: DataFrame, keys: list[str], column: str, field: str, found: list, fill) -> DataFrame:
    # one conditional aggregate per value: partial on the map side, no second shuffle
    aggs = []
    for v, name in zip(found, _named(found)):
        hit = ident(column).isNull() if v is None else ident(column) == F.lit(v)
        cell = F.min(F.when(hit, ident(field)))
        aggs.append((cell if fill is None else F.coalesce(cell, F.lit(fill).cast(df.schema[field].dataType))).alias(name))
    return df.groupBy(*[ident(k) for k in keys]).agg(*aggs)


def wide_to_long(df: DataFrame, fields, names=("name", "value"), by=None) -> DataFrame:
    """Columns become rows of (name, value)."""
    cols = expand(df, fields)
    keys = as_list(by) or [c for c in df.columns if c not in cols]
    return df.unpivot([ident(k) for k in keys], [ident(c) for c in cols], names[0], names[1])


def transpose(df: DataFrame, fields, column: str, by=None, name: str = "field", fill=None, values=None) -> DataFrame:
    """Swap rows and columns: values of ``column`` become columns, names of ``fields`` become rows."""
    keys, found = as_list(by), _values(df, column, values)
    cols = expand(df, fields)
    cells = [F.struct(F.lit(c).alias(name), ident(c).alias("__v")) for c in cols]
    tall = df.select(*[ident(k) for k in keys], ident(column), F.explode(F.array(*cells)).alias("__c"))
    tall = tall.select(*[ident(k) for k in keys], ident(column), "__c.*")
    return _spread(tall, [*keys, name], column, "__v", found, fill)


def combinations(df: DataFrame, field: str, n: int, names, by=None, order=None, permutations: bool = False, repeat: bool = False) -> DataFrame:
    """All n-combinations (or permutations, with or without repetition) of one column inside each key.

    The operator's result is every such tuple. Positions are divided into tiles, and rows
    meet on (key, own tile, partner's tile): both sides are copied once per tile of the
    other, so every pair of tiles is a key of its own and no task receives a whole group.
    """
    keys, names = as_list(by), as_list(names)
    if len(names) != n:
        raise ValueError("give one output name per position")
    order = order_keys(order or field)
    base = number_rows(df.filter(ident(field).isNotNull()), keys, order).select(*[ident(k) for k in keys], ident(field).alias("__x"), RN)
    tile = setting(df.sparkSession, "comboTile", 1000)
    base = base.withColumn("__tile", F.floor((F.col(RN) - 1) / tile))
    sizes = base.groupBy(*[ident(k) for k in keys]).agg(F.max("__tile").alias("__tiles"))
    group = lambda names: F.struct(*[ident(c) for c in names]) if names else F.lit(0)
    held = base.groupBy(*[ident(k) for k in keys]).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    powers = held.agg(*[F.coalesce(F.sum(F.pow("__n", F.lit(i))), F.lit(0.0)) for i in range(2, n + 1)]).first()
    out = base.select(*[ident(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__x").alias("__x0"), F.col(RN).alias("__n0"), F.col("__tile").alias("__t0"))
    for step in range(1, n):
        meet = _meet(step, permutations, repeat)
        same = [F.col(f"__k{i}").eqNullSafe(ident(k)) for i, k in enumerate(keys)]
        low = F.lit(0).cast("long") if permutations else F.col(f"__t{step - 1}")
        if keys:
            sized = out.join(sizes, reduce(and_, same)).drop(*keys)
        else:
            sized = with_row(out, sizes)
        tiles = sized.withColumn("__want", F.explode(F.sequence(low, F.col("__tiles")))).drop("__tiles")
        right = base.withColumnsRenamed({"__x": f"__x{step}", RN: f"__n{step}", "__tile": f"__t{step}"})
        if permutations:
            right = join_keys(right, sizes, keys) if keys else with_row(right, sizes)
        last = F.col("__tiles") if permutations else F.col(f"__t{step}")
        right = right.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__tiles")
        # tasks by the number of results: by the size of the input, adaptive execution would leave a few
        tasks = result_tasks(df.sparkSession, int(powers[step - 1]) // (1 if permutations else math.factorial(step + 1)))
        tiles = tiles.withColumn("__g", group([f"__k{i}" for i in range(len(keys))])).repartition(tasks, "__g", f"__t{step - 1}", "__want")
        right = right.withColumn("__h", group(keys)).repartition(tasks, "__h", "__from", f"__t{step}")
        cond = (F.col("__g") == F.col("__h")) & (F.col(f"__t{step - 1}") == F.col("__from")) & (F.col("__want") == F.col(f"__t{step}"))
        out = tiles.join(right, cond & meet).drop("__want", "__from", "__g", "__h", *keys)
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"__x{i}").alias(a) for i, a in enumerate(names)])


def _meet(step: int, permutations: bool, repeat: bool) -> Column:
    now = F.col(f"__n{step}")
    if permutations:
        if repeat:
            return F.lit(True)
        out = F.lit(True)
        for i in range(step):
            out = out & (now != F.col(f"__n{i}"))
        return out
    before = F.col(f"__n{step - 1}")
    return (now >= before) if repeat else (now > before)

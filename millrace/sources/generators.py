"""Generated tables: sequences, random numbers, constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.windows import _scaled
from millrace.plans.ordered import RN, number_rows


def _rows(spark: SparkSession, rows: int | DataFrame) -> DataFrame:
    """That many rows, or one per row of a table."""
    return spark.range(rows) if isinstance(rows, int) else rows


def new_number(spark: SparkSession, name: str, rows: int | DataFrame = 10, start=1, step: int = 1) -> DataFrame:
    """``rows`` numbers from ``start``, or one per row of a table; an upper-case start gives A, B, ..., Z, AA."""
    if isinstance(rows, DataFrame):
        base, position = number_rows(rows), F.col(RN) - 1
    else:
        base, position = spark.range(rows), F.col("id")
    return base.select(_scaled(position, start, step).alias(name))


def new_random(spark: SparkSession, name: str, rows: int | DataFrame = 10, seed: int = 0, low: int | None = None, high: int | None = None) -> DataFrame:
    """Random reals in [0, 1), or integers in [low, high]."""
    value = F.rand(seed)
    if low is not None and high is not None:
        value = F.floor(value * (high - low + 1) + low).cast("long")
    return _rows(spark, rows).select(value.alias(name))


def new_text(spark: SparkSession, values: dict[str, str], rows: int | DataFrame = 10) -> DataFrame:
    return _rows(spark, rows).select(*[F.lit(v).alias(n) for n, v in values.items()])

"""Joins whose results are many times their input: every pair, and results dealt over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins


def _given(spark):
    left = spark.range(700).select("id", F.when(F.col("id") % 10 != 9, F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 7)).cast("int").alias("k"))
    right = spark.range(90).select(F.col("id").alias("r"), F.when(F.col("id") % 11 != 3, F.when(F.col("id") < 50, 0).otherwise(F.col("id") % 9)).cast("long").alias("rk"))
    return left.unionByName(left.limit(20)), right.unionByName(right.limit(5))


@pytest.mark.parametrize("left,right", [(False, False), (True, False), (False, True), (True, True)])
def test_repeated_keys_give_all_pairs(spark, monkeypatch, left, right):
    a, b = _given(spark)
    want = None
    for limit in (joins.PAIRS, 100):
        monkeypatch.setattr(joins, "PAIRS", limit)
        got = Counter(map(tuple, joins.natural_join(a, b, "k", "rk", "r", left, right).select("id", "k", "r").collect()))
        want = want or got
        assert got == want
    assert sum(want.values()) > 20_000


def _per_task(df):
    return sorted(n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n)


def test_pairs_of_a_few_keys_are_dealt_over_tasks(spark, monkeypatch):
    """Before, two keys gave at most two tasks, and mostly one."""
    monkeypatch.setattr(joins, "PAIRS", 1 << 12)
    a = spark.range(3000).select("id", (F.col("id") % 2).alias("k"))
    b = spark.range(100).select(F.col("id").alias("r"), (F.col("id") % 2).alias("k"))
    tasks = _per_task(joins.natural_join(a, b, "k", fields="r"))
    assert sum(tasks) == 150_000 and max(tasks) < 0.2 * sum(tasks)


def test_results_of_intervals_are_dealt_over_tasks(spark, monkeypatch):
    """Before, adaptive execution put them into one task, since the input is small."""
    monkeypatch.setattr(joins, "PAIRS", 1 << 12)
    values = spark.range(2000).select("id", F.col("id").cast("double").alias("v"))
    spans = spark.range(100).select(F.col("id").alias("name"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    tasks = _per_task(joins.interval_join(values, spans, "v", "lo", "hi", fields="name"))
    assert sum(tasks) == 200_000 and max(tasks) < 0.2 * sum(tasks)


def test_copies_of_values_do_not_grow_with_the_results(spark, monkeypatch):
    """Before, a segment was copied for each ``PAIRS`` of its results, however many tasks there were."""
    monkeypatch.setattr(joins, "PAIRS", 1 << 6)
    monkeypatch.setattr(joins, "RESULT_TASKS", 4, raising=False)
    values = spark.range(700).select("id", F.col("id").cast("double").alias("v"))
    spans = spark.range(600).select(F.col("id").alias("name"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    own, side, keys = joins.interval_pieces(values, spans, "v", "lo", "hi", [], [], {"name": "name"}, "[)")
    assert own.join(side, keys).count() == 700 * 600
    assert own.count() < 20 * 700 and side.count() < 30 * 600


def test_cells_grow_with_the_results(spark, monkeypatch):
    """Before, a cell held ``PAIRS`` pairs however many there were, and rows were copied once per cell."""
    monkeypatch.setattr(joins, "PAIRS", 100)
    monkeypatch.setattr(joins, "RESULT_TASKS", 4)
    a = spark.range(3000).select("id", F.lit(1).alias("k"))
    b = spark.range(100).select(F.col("id").alias("r"), F.lit(1).alias("__k0"))
    left, right = joins._dealt(a, b, ["k"], ["__k0"], False)
    assert left.join(right, (F.col("k") == F.col("__k0")) & (F.col("__salt") == F.col("__part"))).count() == 300_000
    assert left.count() + right.count() < 10_000

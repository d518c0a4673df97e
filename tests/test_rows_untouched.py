"""Columns that an operator does not use come back as they were, and blocks of a hot key give the same results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, pivots, rows, timeseries, windows
from millrace.sources import repair
from tests.conftest import rows as values

BIG = 2**53 + 1


def table(spark, n=60):
    data = [("k", float(i), None if 10 <= i < 45 else float((i * 7) % 11), None if i % 3 else BIG + 2 * i) for i in range(n)]
    return spark.createDataFrame(data, "k string, t double, x double, big long")


def bystander(df):
    return sorted((r["t"], r["big"]) for r in df.select("t", "big").collect())


CASES = {
    "exp": lambda d: windows.moving_mean(d, "x:y", "t", by="k", t=3, kind="exp", skip=0),
    "multi_exp": lambda d: windows.multi_moving_mean(d, [("x", [2, 5], "&_#")], "t", "k", kind="exp"),
    "dynamic": lambda d: timeseries.running_periods(d, "t", "k", stop_ratio=5),
    "spline": lambda d: timeseries.interpolate(d, "t", [("x", "cubic_spline", "y")], "k"),
    "spline_join": lambda d: timeseries.time_join(d, d.select("k", "t", "x").withColumnRenamed("x", "v"), "t", "t", [("v", "cubic_spline", "y")], "k"),
}


@pytest.mark.parametrize("name", CASES)
def test_bystanders_keep_their_values(spark, name):
    d = table(spark)
    assert bystander(CASES[name](d)) == bystander(d)


@pytest.mark.parametrize("name", CASES)
def test_blocks_agree(spark, name, tiny_blocks):
    d = table(spark)
    split = CASES[name](d)
    assert bystander(split) == bystander(d)
    split = values(split)
    spark.conf.unset("millrace.blockRows")
    assert split == values(CASES[name](d))


def test_cut_region_keeps_values(spark):
    d = spark.createDataFrame([(i, f"a,{i}", None if i % 2 else BIG + i * 2) for i in range(1, 9)], "line long, text string, big long")
    got = repair.cut_region(d, "line", "text", 1, 2, start="a,4", end_rows=2)
    assert {(r["line"], r["big"]) for r in got.collect()} <= {(r["line"], r["big"]) for r in d.collect()}


def test_spline_over_a_gap_longer_than_a_block(spark, tiny_blocks):
    """No value is lost where a run of NULLs is longer than blocks and overlap; values agree with the dense solution."""
    d = table(spark, 200)
    got = {r["t"]: r["y"] for r in timeseries.interpolate(d, "t", [("x", "cubic_spline", "y")], "k", overlap=60).collect()}
    known = [(r["t"], r["x"]) for r in d.collect() if r["x"] is not None]
    x, y = np.array([a for a, _ in known]), np.array([b for _, b in known])
    h = np.diff(x)
    system, right = np.zeros((len(x), len(x))), np.zeros(len(x))
    for i in range(1, len(x) - 1):
        system[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    system[0, :3], system[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
    m = np.linalg.solve(system, right)
    for t, v in got.items():
        i = min(max(int(np.searchsorted(x, t, "right")) - 1, 0), len(x) - 2)
        a, b = x[i + 1] - t, t - x[i]
        want = (m[i] * a**3 + m[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * a + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * b
        assert v == pytest.approx(want, abs=1e-9)


def test_product_spreads_over_partitions(spark):
    left, right = spark.range(3000).select(F.col("id").alias("a")), spark.range(40).select(F.col("id").alias("b"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["count"] for r in joins.product(left, right).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 120_000 and max(sizes) <= 2 * 120_000 / 8


@pytest.mark.parametrize("by", ["k", None])
@pytest.mark.parametrize("n", [2, 3])
def test_combinations_over_several_tiles(spark, by, n):
    d = spark.createDataFrame([("a", i) for i in range(8)] + ([(None, i) for i in range(5)] if by else []), "k string, v int")
    groups = [range(8), range(5)] if by else [range(8)]
    spark.conf.set("millrace.comboTile", "3")
    try:
        for how, make in (({}, itertools.combinations), ({"permutations": True}, itertools.permutations), ({"repeat": True}, itertools.combinations_with_replacement)):
            got = pivots.combinations(d, "v", n, list("xyz"[:n]), by, "v", **how).select(*"xyz"[:n]).collect()
            assert sorted(map(tuple, got)) == sorted(c for g in groups for c in make(g, n))
    finally:
        spark.conf.unset("millrace.comboTile")


def test_frame_longer_than_a_block(spark, tiny_blocks):
    d = table(spark)
    got = values(windows.slide(d, "big:b", "t", "k", t=20))
    spark.conf.unset("millrace.blockRows")
    assert got == values(windows.slide(d, "big:b", "t", "k", t=20))


def test_hot_keys_are_counted_once(spark):
    d = table(spark)
    windows.number(d, "n", "k", "t")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    windows.accumulate(d, "x:s", "t", "k")
    windows.slide(d, "x:y", "t", "k")
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_row_range_is_stable(spark):
    d = spark.createDataFrame([(i, 1) for i in range(50)], "a long, b int")
    parts = [rows.row_range(d, "b", k, 10).collect() for k in range(0, 50, 10)]
    assert sorted(r["a"] for p in parts for r in p) == list(range(50))

"""The interval join against all pairs, and how evenly its work divides."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins

INF = float("inf")


def given(spark, n, m, seed):
    rng = random.Random(seed)
    values = [(i, rng.choice(["a", "b", None]), rng.choice([None, -INF, INF, 1e15, *[rng.uniform(-5, 5) for _ in range(20)], *range(-3, 4)])) for i in range(n)]
    end = lambda: rng.choice([None, rng.uniform(-6, 6), rng.randint(-4, 4)])
    spans = [(f"s{i}", rng.choice(["a", "b", None]), end(), end()) for i in range(m)]
    values = [(i, k, None if v is None else float(v)) for i, k, v in values]
    spans = [(s, k, None if a is None else float(a), None if b is None else float(b)) for s, k, a, b in spans]
    return values, spans, spark.createDataFrame(values, "id int, k string, v double"), spark.createDataFrame(spans, "name string, rk string, lo double, hi double")


def pairs(values, spans, keyed, closed):
    out = []
    for i, k, v in values:
        for s, r, a, b in spans:
            a, b = -INF if a is None else a, INF if b is None else b
            if v is not None and (not keyed or (k is not None and k == r)) and (v >= a if closed[0] == "[" else v > a) and (v <= b if closed[1] == "]" else v < b):
                out.append((i, s))
    return sorted(out)


@pytest.mark.parametrize("closed", ["[)", "[]", "()", "(]"])
def test_intervals_match_all_pairs(spark, monkeypatch, closed):
    values, spans, left, right = given(spark, 120, 60, closed)
    for limit, sizes in ((joins.PAIRS, joins.SIZES), (6, (0, 1, 3))):
        monkeypatch.setattr(joins, "PAIRS", limit)
        monkeypatch.setattr(joins, "SIZES", sizes)
        for by, ref_by in (("k", "rk"), (None, None)):
            got = joins.interval_join(left, right, "v", "lo", "hi", by, ref_by, "name", closed)
            assert sorted((r["id"], r["name"]) for r in got.collect()) == pairs(values, spans, by is not None, closed)
    spark.conf.set("millrace.blockRows", "7")
    try:
        got = joins.interval_join(left, right, "v", "lo", "hi", "k", "rk", "name", closed)
        assert sorted((r["id"], r["name"]) for r in got.collect()) == pairs(values, spans, True, closed)
    finally:
        spark.conf.unset("millrace.blockRows")


def test_intervals_outer(spark):
    values, spans, left, right = given(spark, 60, 30, 5)
    got = joins.interval_join(left, right, "v", "lo", "hi", "k", "rk", "name", left=True, right=True)
    inner = pairs(values, spans, True, "[)")
    want = inner + [(i, None) for i, *_ in values if i not in {i for i, _ in inner}] + [(None, s) for s, *_ in spans if s not in {s for _, s in inner}]
    assert Counter((r["id"], r["name"]) for r in got.collect()) == Counter(want)
    assert joins.interval_join(left, right.limit(0), "v", "lo", "hi", "k", "rk", "name").count() == 0 == joins.interval_join(left.limit(0), right, "v", "lo", "hi", "k", "rk", "name").count()


def test_intervals_open_at_both_ends_divide_evenly(spark, monkeypatch):
    """Half of all intervals hold all values: results by join key, dealt over 16 tasks."""
    monkeypatch.setattr(joins, "PAIRS", 1 << 12)
    values = spark.range(4000).select("id", (F.col("id") * 37 % 4001).cast("double").alias("v"))
    spans = spark.range(200).select(F.col("id").alias("name"), F.when(F.col("id") % 2 == 0, F.col("id") * 10.0).alias("lo"), F.when(F.col("id") % 2 == 0, F.col("id") * 10.0 + 30).alias("hi"))
    own, side, keys = joins.interval_pieces(values, spans, "v", "lo", "hi", [], [], {"name": "name"}, "[)")
    results = own.join(side, keys).groupBy(F.pmod(F.hash(*keys), F.lit(16)).alias("task")).count().collect()
    per_task = [r["count"] for r in results]
    assert sum(per_task) == pytest.approx(100 * 4000 + 100 * 30, abs=100) and len(per_task) == 16
    assert max(per_task) < 2 * sum(per_task) / 16

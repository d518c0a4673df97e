"""Numeric operators against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggs, ml, timeseries, windows
from millrace.operators.features import Feature, features
from tests.conftest import rows


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    data = [(k, float(i), None if rng.random() < 0.2 else round(rng.gauss(10, 4), 2)) for k in "ab" for i in range(60)]
    return spark.createDataFrame(data, "k string, t double, x double"), pd.DataFrame(data, columns=["k", "t", "x"])


def test_spline_reproduces_a_cubic(spark):
    cubic = lambda t: 2 * t ** 3 - t ** 2 + 3
    df = spark.createDataFrame([(float(t), None if t in (3, 4, 8) else cubic(float(t))) for t in range(12)], "t double, x double")
    got = timeseries.interpolate(df, "t", [("x", "cubic_spline", "y")]).collect()
    assert all(abs(r["y"] - cubic(r["t"])) < 1e-6 for r in got)
    few = timeseries.interpolate(df.limit(4), "t", [("x", "cubic_spline", "y")]).filter("x is null").collect()
    assert all(r["y"] is None for r in few)


def test_spline_blocks_agree(spark, series):
    df, _ = series
    make = lambda: rows(timeseries.interpolate(df, "t", [("x", "cubic_spline", "y")], "k"))
    plain = make()
    spark.conf.set("millrace.blockRows", "25")
    try:
        split = make()
    finally:
        spark.conf.unset("millrace.blockRows")
    near = [abs(a[-1] - b[-1]) < 0.05 for a, b in zip(sorted(plain, key=str), sorted(split, key=str)) if a[-1] is not None and b[-1] is not None]
    assert len(near) > 100 and all(near)


def test_spectrum(series):
    df, pdf = series
    full = pdf.fillna({"x": 1.0})
    got = features(df.fillna({"x": 1.0}), "k", {"m": Feature("meanf", "x", time="t"), "v": Feature("varf", "x", time="t")}).collect()
    for r in got:
        y = np.abs(np.fft.rfft(full[full.k == r["k"]].x.to_numpy()))
        b = np.arange(len(y))
        m = y.dot(b) / y.sum()
        assert abs(r["m"] - m) < 1e-9 and abs(r["v"] - (y.dot(b ** 2) / y.sum() - m * m)) < 1e-7


@pytest.mark.parametrize("n,block", [(8, "7"), (97, "40"), (500, "7"), (512, "300")])
def test_spectrum_of_divided_series(spark, n, block):
    """The transform over many tasks gives numpy's spectrum, for lengths that are powers of two, prime and others."""
    rng = np.random.default_rng(n)
    x = rng.normal(3, 2, n)
    rows = [("long", i, float(v)) for i, v in enumerate(x)] + [(None, i, float(v)) for i, v in enumerate(x[:n // 2])] + [("gap", i, None if i == 3 else 1.0) for i in range(n)] + [("zero", i, 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(3)
    spark.conf.set("millrace.blockRows", block)
    try:
        got = {r["k"]: (r["m"], r["v"]) for r in features(df, "k", {"m": Feature("meanf", "x", time="t"), "v": Feature("varf", "x", time="t")}).collect()}
    finally:
        spark.conf.unset("millrace.blockRows")
    for k, series in (("long", x), (None, x[:n // 2])):
        y = np.abs(np.fft.rfft(series))
        b = np.arange(len(y))
        m = y @ b / y.sum()
        assert got[k] == pytest.approx((m, y @ b**2 / y.sum() - m * m), rel=1e-9, abs=1e-9)
    assert got["gap"] == got["zero"] == (None, None)


def test_exponential_mean(series):
    df, pdf = series
    got = {(r["k"], r["t"]): r["m"] for r in windows.exponential_mean(df, "x:m", "t", "k", alpha=0.3).collect()}
    for k, g in pdf.groupby("k"):
        y = None
        for t, x in zip(g.t, g.x):
            if not np.isnan(x):
                y = x if y is None else 0.3 * x + 0.7 * y
            assert got[(k, t)] is None if y is None else abs(got[(k, t)] - y) < 1e-9


@pytest.mark.parametrize("block", ["1000000", "8"])
def test_kendall(spark, series, block):
    df, pdf = series
    spark.conf.set("millrace.blockRows", block)
    try:
        got = {r["k"]: r["s"] for r in aggs.similarity(df.withColumn("y", F.floor(F.col("t") / 7)), "kendall:s", "x,y", "k").collect()}
    finally:
        spark.conf.unset("millrace.blockRows")
    for k, g in pdf.dropna().groupby("k"):
        x, y = g.x.to_numpy(), np.floor(g.t.to_numpy() / 7)
        s = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i, j in itertools.combinations(range(len(x)), 2)]
        want = sum(a * b for a, b in s) / np.sqrt(sum(a * a for a, _ in s) * sum(b * b for _, b in s))
        assert abs(got[k] - want) < 1e-12


def test_models_learn(spark, table):
    df = table("lineitem").select("l_quantity", "l_extendedprice", (F.col("l_quantity") > 25).cast("int").alias("big"))
    for kind, params in (("decision_tree_classifier", {}), ("logistic_regression", {}), ("random_forest_classifier", {"numTrees": 5})):
        model = ml.train(df, kind, "l_quantity,l_extendedprice", "big", **params)
        assert ml.score_of(ml.predict(model, df, "l_quantity,l_extendedprice"), "big", "prediction", "accuracy") > 0.95
    boosted = ml.boost(df, "l_quantity,l_extendedprice", "big", 2, rounds=2)
    assert ml.score_of(ml.predict(boosted, df, "l_quantity,l_extendedprice"), "big", "prediction", "accuracy") > 0.95


def test_splines_of_many_series_at_once():
    rng = np.random.default_rng(3)
    sizes = [4, 9, 5, 4, 60, 6]
    parts = [(np.cumsum(rng.uniform(0.1, 1, n)), rng.normal(size=n)) for n in sizes]
    parts[2][1][3] = np.inf  # stays in its own series
    starts = np.cumsum([0, *sizes[:-1]])
    with np.errstate(all="ignore"):
        got = timeseries.splines(*map(np.concatenate, zip(*parts)), starts)
        alone = [timeseries.spline_coefficients(x, y) for x, y in parts]
    for at, want in zip(starts, alone):
        assert np.allclose(got[:, at:at + want.shape[1]], want, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_hot_keys_of_a_spline_join_are_counted_without_splines(spark, monkeypatch):
    from millrace.plans import ordered

    df = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").cast("double").alias("t"), F.sin("id").alias("v"))
    counted, right = [], ordered.hot_groups
    monkeypatch.setattr(ordered, "hot_groups", lambda d, keys: counted.append(d._jdf.queryExecution().optimizedPlan().toString()) or right(d, keys))
    out = timeseries.time_join(df.select("k", (F.col("t") + 7).alias("t")), df, "t", "t", [("v", "cubic_spline", "y"), ("v", "previous", "p")], "k")
    assert out.count() == 400 and len(counted) > 2
    assert not [p for p in counted if "Arrow" in p or "Pandas" in p]

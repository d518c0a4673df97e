"""The neighbour index against all distances, and how much of the table it looks at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ml


def table(spark, points, labels):
    rows = [(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(points, labels))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double")


def brute(points, labels, queries, k, p, skip):
    out = {}
    for i, q in enumerate(queries):
        d = (np.abs(points - q) ** p).sum(1) ** (1 / p)
        near = sorted((float(d[j]), float(labels[j])) for j in range(len(points)) if not (skip and i == j))[:k]
        out[i] = near
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["distance"], r["target"]))
    return out


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("points", [4_096, 13])
def test_neighbours_are_exact(spark, monkeypatch, p, points):
    monkeypatch.setattr(ml, "POINTS", points)
    rng = np.random.default_rng(p)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 1), (2, 9))] + [np.full((40, 2), 5.0)]).round(2)  # clusters, and one point many times
    y = rng.integers(0, 4, len(x))
    df = table(spark, x, y).repartition(3)
    for skip in (None, "id"):
        got = found(ml.nearest_neighbours(df, df, "id", "a,b", "y", 5, p, skip))
        want = brute(x, y, x, 5, p, skip)
        assert got.keys() == want.keys()
        for i, near in want.items():
            assert [t for _, t in got[i]] == [t for _, t in near] and [d for d, _ in got[i]] == pytest.approx([d for d, _ in near])
    far = table(spark, np.array([[100.0, -50.0], [2.5, 4.0]]), [0, 0])
    assert {i: [t for _, t in n] for i, n in found(ml.nearest_neighbours(far, df, "id", "a,b", "y", 7, p)).items()} == {i: [t for _, t in n] for i, n in brute(x, y, np.array([[100.0, -50.0], [2.5, 4.0]]), 7, p, False).items()}


def test_neighbours_of_few_or_no_rows(spark):
    df = table(spark, np.array([[0.0, 0.0], [1.0, 1.0]]), [1, 2]).unionByName(spark.createDataFrame([(9, None, 1.0, 3.0)], "id long, a double, b double, y double"))
    assert found(ml.nearest_neighbours(df, df, "id", "a,b", "y", 5, skip_self="id")) == {0: [(2**0.5, 2.0)], 1: [(2**0.5, 1.0)]}
    assert ml.nearest_neighbours(df, df.limit(0), "id", "a,b", "y").count() == 0 == ml.nearest_neighbours(df.limit(0), df, "id", "a,b", "y").count()
    same = table(spark, np.zeros((300, 2)), np.arange(300)).withColumn("id", F.lit(7).cast("long"))
    assert ml.nearest_neighbours(same, same, "id", "a,b", "y", skip_self="id").count() == 0
    with pytest.raises(ValueError):
        ml.nearest_neighbours(df, df, "id", "a,b", "y", p=0.5)


def test_few_blocks_are_looked_at(spark, monkeypatch):
    monkeypatch.setattr(ml, "POINTS", 50)
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 100, (5000, 2))
    df = table(spark, x, np.zeros(len(x)))
    rows = df.select(F.lit(None).cast("long").alias("__own"), F.array("a", "b").alias("__v"), F.col("y").alias("__y"))
    index = ml.NeighbourIndex(rows, 5, 2.0)
    queries = df.select(F.col("id").alias("__key"), F.array("a", "b").alias("__v"), F.lit(float("inf")).alias("__bound"))
    pairs = index.pairs(queries, True).unionByName(index.pairs(queries, False)).groupBy("__cell", "__sub").count().collect()
    size = {(c, s): n for c, s, n in zip(index.rings.cell, index.rings.sub, index.rings.sizes)}
    looked = sum(r["count"] * size[r["__cell"], r["__sub"]] for r in pairs)
    assert looked < 0.1 * len(x) ** 2

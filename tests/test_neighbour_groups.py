"""What a neighbour search in many dimensions sends around, and its candidates against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ml


@pytest.mark.parametrize("p", [1, 2, 3])
def test_candidates_are_the_nearest(p):
    rng = np.random.default_rng(p)
    x, y = rng.normal(size=(40, 24)) + 50, rng.normal(size=(300, 24)) + 50
    y[100:200] = y[100]  # one point many times
    labels, codes = rng.integers(0, 3, 300).astype(float), (np.arange(40), np.arange(300) % 150)
    row, d, target = ml._nearest(x, y, y[0], np.full(40, np.inf), labels, codes, 5, p)
    for i in range(40):
        far = (np.abs(y - x[i]) ** p).sum(1) ** (1 / p)
        want = sorted((far[j], labels[j]) for j in range(300) if j % 150 != i)[:5]
        assert [*zip(d[row == i], target[row == i])] == want


def test_a_row_goes_to_a_group_of_blocks_once(spark):
    """Before, it went to each of the 128 small blocks that its bound leaves open."""
    x = np.random.default_rng(4).normal(size=(1500, 24))
    rows = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "__own long, __v array<double>, __y double")
    index = ml.NeighbourIndex(rows, 5, 2.0)
    queries = rows.select(F.col("__own").alias("__key"), "__v", F.lit(float("inf")).alias("__bound"))
    assert len(index.rings.cell) > 100 and set(index.rings.group.tolist()) == {0}
    assert index.parcels(queries, True).count() == 1500 and index.parcels(queries, False).count() == 0


def test_rounded_rows_lose_no_neighbour():
    """Sums of small integers in place of single precision: what is left holds all within the bound, and little else."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(50, 48)) - 7, rng.normal(size=(2000, 48)) - 7
    y[:20] *= 30  # far out, so rounded far
    far = np.abs(y[None] - x[:, None]).sum(2)
    none = (np.zeros(0, int),) * 2
    for bound in (np.sort(far, 1)[:, 4], np.full(50, np.inf)):
        row, other = ml._candidates_p1(x, y, bound, none, 5)
        got = set(zip(row.tolist(), other.tolist()))
        assert {(i, int(j)) for i in range(50) for j in np.argsort(far[i])[:5]} <= got and len(got) < 0.2 * far.size


def test_a_small_search_is_divided(spark):
    """Before, all rows that ask in one group were one task."""
    x = np.random.default_rng(4).normal(size=(5000, 24))
    rows = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "__own long, __v array<double>, __y double")
    index = ml.NeighbourIndex(rows, 5, 1.0)
    queries = rows.select(F.col("__own").alias("__key"), "__v", F.lit(float("inf")).alias("__bound"))
    found = index.search(index.parcels(queries, True), 5, True)
    tasks = [n for n in found.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect() if n]
    assert sum(tasks) == 25_000 and max(tasks) < 0.7 * sum(tasks)

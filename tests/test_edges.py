"""Literal tables: empty input, NULL keys, single rows, ties, constant columns, odd names."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as sc
from millrace.operators import aggs, joins, pivots, vectors, windows
from millrace.operators import rows as row
from millrace.sources import repair
from tests.conftest import rows


@pytest.fixture
def t(spark):
    return spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 30.0), ("b", 1, 5.0), (None, 1, 7.0), (None, 2, 7.0)], "`the key` string, o int, x double")


def test_empty(spark, t):
    none = t.limit(0)
    assert rows(aggs.stats(none, "median", "x:m", "the key")) == []
    assert rows(windows.moving_mean(none, "x:m", "o", "the key", 2)) == []
    assert rows(windows.exponential_mean(none, "x:m", "o", "the key", alpha=0.5)) == []
    assert rows(row.padding(none, "o%n", "the key")) == []
    assert rows(row.best(none, "o", "the key")[0]) == []


def test_null_key_is_a_group(t):
    got = rows(windows.share(t, "x:s", "the key").select("the key", "o", "s"))
    assert [g for g in got if g[2] is None] == [(2, 0.5, None)] or (1, 0.5, None) in got
    assert rows(aggs.stats(t, "sum", "x:s", "the key").select("s")) == [(14.0,), (40.0,), (5.0,)]


def test_single_row_and_constant(t):
    got = {r["the key"]: r for r in aggs.describe(t, "the key", {s: (s, "x") for s in ("var", "uvar", "skew", "cv", "median", "mode")}).collect()}
    assert (got["b"]["var"], got["b"]["uvar"], got["b"]["median"]) == (0.0, None, 5.0)
    assert got[None]["skew"] is None and got[None]["mode"] == 7.0
    flat = aggs.similarity(t.withColumn("y", F.lit(1.0)), "pearson:p,cosine:c", "x,y").first()
    assert flat["p"] is None and flat["c"] is not None


def test_strict_nulls(t):
    got = {r["the key"]: r["s"] for r in aggs.sum_columns(t, "x:s", "the key", strict=True).collect()}
    assert got == {"a": None, "b": 5.0, None: 14.0}


def test_two_outputs_cover_all_rows(t):
    match, rest = row.select_number(t, "x", "[6,20)")
    assert match.count() + rest.count() == t.count() and rest.filter("x is null").count() == 1


def test_duplicate_and_padding(spark, t):
    assert row.duplicate(spark.createDataFrame([(0,), (2,), (None,), (-1,)], "n int"), "n").count() == 2
    p = spark.createDataFrame([("a", 1, "u"), ("a", 4, "v"), ("b", 2, "w")], "k string, n int, v string")
    assert rows(row.padding(p, "n%n", "k").select("k", "n", "v")) == [("a", 1, "u"), ("a", 2, "u"), ("a", 3, "u"), ("a", 4, "v"), ("b", 2, "w")]
    assert rows(row.padding(p, "n%nr", "k", null=True).select("k", "n", "v")) == [("a", 1, "u"), ("a", 2, None), ("a", 3, None), ("a", 4, "v"), ("b", 2, "w")]


def test_join_checks(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    with pytest.raises(Exception, match="not unique"):
        joins.join(a, b, "k").collect()
    assert rows(joins.natural_join(a, b, "k", left=True, right=True)) == [(None, "y", None), (1, "x", "p"), (1, "x", "q")]
    with pytest.raises(ValueError):
        joins.join(a, b, "k", fields="w:v")


def test_interval_with_open_ends(spark):
    a = spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double")
    b = spark.createDataFrame([(None, 2.0, "low"), (5.0, None, "high"), (1.0, 5.0, "mid")], "s double, e double, n string")
    assert rows(joins.interval_join(a, b, "x", "s", "e", fields="n", left=True).select("x", "n")) == [(None, None), ("high", 5.0), ("low", 1.0), ("mid", 1.0)]
    assert rows(joins.range_common(a, b, "x", "s", "e")[0]) == [(1.0,), (5.0,)]


def test_vectors(spark):
    v = spark.createDataFrame([("b a  a",), ("",), (None,)], "v string")
    assert [r[0] for r in vectors.vector_sort(v, "v").collect()] == [" a a b", None, None]
    assert [r[0] for r in vectors.vector_unique(v, "v").collect()] == ["b a ", None, None]
    assert [r["n"] for r in vectors.vector_count(v, "v:n").collect()] == [4, 0, 0]
    assert [r[0] for r in vectors.vector_fill_empty(v, "v", previous=True).collect()][0] == "b a a a"


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("1e3",), ("-.5",), ("x",), ("1,0",), (None,)], "s string")
    assert [r[0] for r in df.select(sc.number(F.col("s"))).collect()] == [1000.0, -0.5, None, None, None]
    d = spark.createDataFrame([("2024-2-30",), ("2024-02-03",), ("bad",)], "d string")
    assert [str(r[0]) for r in sc.format_dates(d, "d", "%Y-%m-%d").collect()] == ["None", "2024-02-03", "None"]
    assert [r[0] for r in spark.range(1).select(sc.round_sig(F.lit(1234.5678), 6)).collect()] == [1234.57]


def test_combinations(spark):
    df = spark.createDataFrame([("a", x) for x in "xyz"], "k string, v string")
    assert pivots.combinations(df, "v", 2, "p,q", "k", permutations=True, repeat=True).count() == 9
    assert pivots.combinations(df, "v", 3, "p,q,r", "k").count() == 1


def test_cut_region(spark):
    text = ["junk", "h1,h2", "1,2", "# off", "skip", "", "3,4", "# off"]
    df = spark.createDataFrame([("f", i + 1, s) for i, s in enumerate(text)], "file string, line int, text string")
    got = repair.cut_region(df, "line", "text", 2, 3, by="file", start="^#", end_blank=True).orderBy("line")
    assert [r["text"] for r in got.collect()] == ["h1,h2", "1,2", "3,4"]
    got = repair.cut_region(df, "line", "text", 2, 3, by="file", start="^#", end_rows=1).orderBy("line")
    assert [r["text"] for r in got.collect()] == ["h1,h2", "1,2", "skip", "", "3,4"]

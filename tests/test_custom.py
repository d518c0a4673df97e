"""Functions of the user's own: what they see, in which order, and how much of it at once."""

import pyarrow as pa
import pytest

from millrace.operators import custom


def test_a_key_streams_in_batches_and_in_order(spark):
    """A key of many batches is seen piece by piece; null is a key of its own."""
    rows = [(k, i) for k in ("a", "b", None) for i in range(500)] + [("long", i) for i in range(2500)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)

    def count(key, batches):
        seen, most, last, sorted_ = 0, 0, None, True
        for b in batches:
            values = b.column("i").to_pylist()
            sorted_ &= values == sorted(values, reverse=True) and (last is None or values[0] <= last)
            seen, most, last = seen + len(values), max(most, len(values)), values[-1]
        yield pa.RecordBatch.from_pylist([{"k": key[0], "n": seen, "most": most, "ok": sorted_}], pa.schema([("k", pa.string()), ("n", pa.int64()), ("most", pa.int64()), ("ok", pa.bool_())]))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = {r["k"]: r for r in custom.key_blocks(df, "k", "i%nr", count, "k string, n long, most long, ok boolean").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: r["n"] for k, r in got.items()} == {"a": 500, "b": 500, None: 500, "long": 2500}
    assert all(r["ok"] for r in got.values()) and got["long"]["most"] <= 1000


def test_rows_left_over_by_a_function_are_passed_over(spark):
    df = spark.createDataFrame([(k, i) for k in range(20) for i in range(7)], "k int, i int")

    def first(key, batches):
        batch = next(batches)
        yield batch.slice(0, 1)

    got = custom.key_blocks(df, "k", "i", first, "k int, i int")
    assert sorted(map(tuple, got.collect())) == [(k, 0) for k in range(20)]
    assert custom.key_blocks(df.limit(0), "k", "i", first, "k int, i int").count() == 0
    with pytest.raises(ValueError):
        custom.key_blocks(df, None, "i", first, "k int, i int")


def test_functions_see_the_columns_they_name(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([",".join(b.schema.names)])], ["seen"])

    assert custom.run_function(df, run, "seen string", "c,a").first()[0] == "c,a"


class Numbered:
    def __init__(self):
        self.n = 0

    def eval(self, row):
        self.n += 1
        yield row["k"], row["i"], self.n

    def terminate(self):
        if self.n:
            yield None, None, self.n


def test_table_function_keeps_state_by_key(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", "b") for i in (3, 1, 2)], "k string, i int").repartition(3)
    got = custom.table_function(df, Numbered, "k string, i int, n int", "k", "i%r").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, i, 4 - i) for k in ("a", "b") for i in (1, 2, 3)] + [(None, None, 3)] * 2, key=str)
    with pytest.raises(ValueError):
        custom.table_function(df, Numbered, "k string, i int, n int", order="i")

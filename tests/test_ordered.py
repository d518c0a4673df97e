from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans.ordered import Ordered, number_rows, quantiles
from tests.conftest import rows


def _events(table):
    # two thirds of all rows fall on one key; the order column has ties and NULLs
    return table("events").select(
        "event_id", "value",
        F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("k"),
        F.when(F.col("event_id") % 11 > 0, F.floor(F.col("value"))).alias("o"),
        F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("x"),
    )


def _both(spark, make):
    plain = rows(make())
    spark.conf.set("millrace.blockRows", "7")
    try:
        assert rows(make()) == plain
    finally:
        spark.conf.unset("millrace.blockRows")


def test_numbering(spark, table):
    ev = _events(table)
    for keys in (["k"], None):
        for order in ("o,event_id", "o%r,event_id", "event_id%nr"):
            _both(spark, lambda: number_rows(ev, keys, order, "rn"))


def test_frame(spark, table):
    ev = _events(table)

    def make():
        o = Ordered(ev, "k", "o%r,event_id")
        return o.frame(3, 2, lambda w: {
            "prev": F.lag("x", 3).over(w), "next": F.lead("event_id", 2).over(w),
            "n": F.count("x").over(w.rowsBetween(-3, 2)), "m": F.max("x").over(w.rowsBetween(-3, 0)),
        }).result()
    _both(spark, make)


def test_running(spark, table):
    ev = _events(table)

    def make(flip):
        o = Ordered(ev, "k", "o,event_id")
        return o.running(flip, s=("sum", F.col("event_id")), c=("count", F.col("x"), False),
                         a=("min", F.col("x")), b=("max", F.col("x"), False), l=("last", F.col("x"), False)).result()
    for flip in (False, True):
        _both(spark, lambda: make(flip))


def test_running_is_right(spark, table, tiny_blocks):
    ev = _events(table)
    got = Ordered(ev, "k", "event_id").running(s=("sum", F.col("event_id"))).result()
    w = Window.partitionBy("k").orderBy("event_id")
    assert rows(got) == rows(ev.withColumn("s", F.sum("event_id").over(w)))


def test_quantiles(spark, table):
    ev = _events(table)
    for keys in (["k"], None):
        _both(spark, lambda: quantiles(ev, keys, {"a": ("x", 0.25), "b": ("x", 0.5), "c": ("value", 0.9)}))


def _medians(spark):
    """Quartile and median of a hot key of 20,000 values, one of equal values, one of NULLs, and an ordinary key."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), (F.pow(F.col("id") % 7919, 3) - 1e9).alias("x"))
    df = df.unionByName(spark.range(9_000).select(F.lit(None).cast("string").alias("k"), F.when(F.col("id") % 9 == 0, 1e300).otherwise(F.lit(5.0)).alias("x")))
    df = df.unionByName(spark.range(8_000).select(F.lit("n").alias("k"), F.lit(None).cast("double").alias("x")))
    return df.unionByName(spark.range(11).select(F.lit("few").alias("k"), F.col("id").cast("double").alias("x")))


def test_quantiles_of_hot_keys_order_few_values(spark, monkeypatch):
    from millrace.plans import ordered

    df, points = _medians(spark), {"q": ("x", 0.25), "m": ("x", 0.5), "t": ("x", 1.0)}
    for keys in (["k"], None):
        whole = rows(quantiles(df, keys, points))
        seen = []

        class Watched(Ordered):
            def __init__(self, df, *args):
                seen.append(df.count())
                super().__init__(df, *args)

        with monkeypatch.context() as m:
            m.setattr(ordered, "Ordered", Watched)
            m.setattr(ordered, "BRACKET_SAMPLE", 2_000, raising=False)
            spark.conf.set("millrace.blockRows", "5000")
            try:
                assert rows(quantiles(df, keys, points)) == whole
            finally:
                spark.conf.unset("millrace.blockRows")
        assert sum(seen) < 4_000  # of about 7,900 different values


def test_quantiles_outside_their_brackets(spark, monkeypatch):
    from millrace.plans import ordered

    df, points = _medians(spark), {"q": ("x", 0.25), "m": ("x", 0.5)}
    whole = rows(quantiles(df, ["k"], points))
    right = ordered._brackets
    monkeypatch.setattr(ordered, "_brackets", lambda *args: right(*args).withColumns({"__a0": F.lit(-2.0), "__b0": F.lit(-1.0), "__a1": F.lit(6.0), "__b1": F.lit(7.0)}))
    spark.conf.set("millrace.blockRows", "5000")
    try:
        assert rows(quantiles(df, ["k"], points)) == whole
    finally:
        spark.conf.unset("millrace.blockRows")

"""Tables behind plots; drawing is not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import number, parse_format
from millrace.functions.spec import as_list, expand, ident
from millrace.operators.aggs import bucket, describe
from millrace.operators.columns import text_hash
from millrace.operators.rows import row_range
from millrace.plans.ordered import join_spread, quantiles, totals, with_row


def table_view(df: DataFrame, order, offset: int = 0, limit: int = 100) -> DataFrame:
    return row_range(df, order, offset, limit)


def numeric_or_text(df: DataFrame, fields) -> DataFrame:
    """Cast text columns to numbers, but leave a column as text when over half of it is not numeric."""
    names = [c for c in expand(df, fields) if isinstance(df.schema[c].dataType, T.StringType)]
    if not names:
        return df
    bad = df.agg(*[F.avg(number(ident(c)).isNull().cast("double")).alias(c) for c in names]).first()  # one row
    return df.withColumns({c: number(ident(c)) for c in names if (bad[c] or 0.0) <= 0.5})


def _axis(df: DataFrame, field: str, fmt: str | None) -> Column:
    if fmt:
        return parse_format(ident(field), fmt)
    return number(ident(field)) if isinstance(df.schema[field].dataType, T.StringType) else ident(field)


def line_graph(df: DataFrame, x: str, y: str, series=None, x_format: str | None = None) -> DataFrame:
    """Points of each series with x read as time or number and y as number; invalid points are left out."""
    keys = as_list(series)
    out = df.select(*[ident(k) for k in keys], _axis(df, x, x_format).alias("x"), _axis(df, y, None).cast("double").alias("y"))
    return out.filter("x is not null and y is not null").orderBy(*[ident(k) for k in keys], "x")


def histogram(df: DataFrame, x: str, bins: int, series=None) -> DataFrame:
    """Counts in equal-width bins; all series share the edges. Bins without rows have no row."""
    keys = as_list(series)
    data = df.select(*[ident(k) for k in keys], _axis(df, x, None).cast("double").alias("x")).filter("x is not null")
    ends = data.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    cell = F.least(F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1))
    counts = with_row(data, ends).groupBy(*[ident(k) for k in keys], cell.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    low = F.col("lo") + F.col("bin") * width
    return counts.select(*[ident(k) for k in keys], "bin", low.alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "count")


def scatter(df: DataFrame, x: str, y: str, series=None, limit: int | None = 1000, seed: int = 0, key=None) -> DataFrame:
    """x, y and series of a random sample of ``limit`` rows: those with the smallest hash of the row.

    Samples of parts merge into the sample of the whole. With ``key``, the columns that name a row, the hash is the
    sha256 of seed and key as text, so any other tool can draw the same rows.
    """
    data = df.filter(ident(x).isNotNull() & ident(y).isNotNull())
    if limit is not None:  # a top-k of row hashes: each task keeps at most ``limit`` rows
        draw = text_hash(seed, key) if key else F.xxhash64(F.lit(seed), *[ident(c) for c in df.columns])
        data = data.withColumn("__u", draw).orderBy("__u").limit(limit)
    return data.select(*[ident(k) for k in as_list(series)], ident(x).cast("double").alias("x"), ident(y).cast("double").alias("y"))


def density(df: DataFrame, x: str, y: str, bins: int, series=None) -> DataFrame:
    """Counts on a grid of bins x bins cells, for point clouds too large to draw."""
    keys = as_list(series)
    data = df.select(*[ident(k) for k in keys], ident(x).cast("double").alias("x"), ident(y).cast("double").alias("y")).filter("x is not null and y is not null")
    ends = data.agg(*[f(c).alias(f"__{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])

    def cell(c: str) -> Column:
        lo, hi = F.col(f"__lo{c}"), F.col(f"__hi{c}")
        return F.least(F.coalesce(F.floor(F.try_divide(F.col(c) - lo, (hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).alias(f"{c}_bin")

    return with_row(data, ends).groupBy(*[ident(k) for k in keys], cell("x"), cell("y")).agg(F.count(F.lit(1)).alias("count"))


def box_plot(df: DataFrame, y: str, series=None) -> tuple[DataFrame, DataFrame]:
    """(quartiles, whiskers within 1.5 IQR and outlier count per series, the outliers themselves)."""
    keys = as_list(series)
    data = df.select(*[ident(k) for k in keys], ident(y).cast("double").alias("y")).filter("y is not null")
    quarts = quantiles(data, keys, {"q1": ("y", 0.25), "median": ("y", 0.5), "q3": ("y", 0.75)})
    marked = join_spread(data, quarts, keys) if keys else with_row(data, quarts)
    iqr = F.col("q3") - F.col("q1")
    near = F.col("y").between(F.col("q1") - iqr * 1.5, F.col("q3") + iqr * 1.5)
    by = [ident(k) for k in keys]
    boxes = marked.groupBy(*by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(near, F.col("y"))).alias("whisker_low"), F.max(F.when(near, F.col("y"))).alias("whisker_high"),
        F.count_if(~near).alias("outliers"))
    return boxes, marked.filter(~near).select(*by, "y")


# fixed values: statistics drawn by the band plots
BANDS = {"range": {"min": "min", "mean": "mean", "max": "max"}, "quartile": {"q1": "qtile1", "median": "median", "q3": "qtile3"}}


def _valid_points(df: DataFrame, x: str, y: str, others: list[str]) -> DataFrame:
    data = df.select(*[ident(c) for c in others], _axis(df, x, None).alias("x"), _axis(df, y, None).cast("double").alias("y"))
    return data.filter("x is not null and y is not null")


def waveform_points(df: DataFrame, x: str, y: str, series=None, group: str | None = None) -> DataFrame:
    """The valid points of a repeated waveform by series, each with its group."""
    return _valid_points(df, x, y, [*as_list(series), *([group] if group else [])])


def waveform_events(df: DataFrame, x: str, y: str, event: str) -> DataFrame:
    """Origins of the waves: the x of valid points whose event is 0, each once."""
    return _valid_points(df, x, y, [event]).filter(ident(event).cast("string") == "0").select("x").distinct()


def waveform(df: DataFrame, x: str, y: str, series=None, kind: str = "range") -> DataFrame:
    """Statistics of y at each x of a repeated waveform, per series; invalid points are left out."""
    keys = as_list(series)
    return describe(_valid_points(df, x, y, keys), [*keys, "x"], {n: (s, "y") for n, s in BANDS[kind].items()})


def time_compression(df: DataFrame, x: str, y: str, division: int, series=None, kind: str = "range") -> DataFrame:
    """x divided into equal-width parts per series; statistics of y and the start of each part."""
    keys = as_list(series)
    data = df.select(*[ident(k) for k in keys], ident(x).cast("double").alias("x"), ident(y).cast("double").alias("y")).filter("x is not null and y is not null")
    data = totals(bucket(data, {"x": "part"}, division, keys, equal_width=True), keys, {"__lo": F.min("x"), "__hi": F.max("x")})
    start = F.col("__lo") + (F.col("part") - 1) * (F.col("__hi") - F.col("__lo")) / division
    return describe(data.withColumn("start", start), [*keys, "part", "start"], {n: (s, "y") for n, s in BANDS[kind].items()})

"""The 22 descriptive statistics as Spark expressions.

``over`` turns an aggregate into a window value, so one definition serves grouped
tables and moving frames alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of the statistics
STATS = (
    "count ucount sum mean devsq var uvar sd usd cv min qtile1 median qtile3 max "
    "range qrange mode skew uskew kurt ukurt"
).split()
MOVING_STATS = "sum mean devsq var uvar sd usd cv min max range skew uskew kurt ukurt".split()
# exact quantiles behind a statistic
QUANTILE_POINTS = {"qtile1": (0.25,), "median": (0.5,), "qtile3": (0.75,), "qrange": (0.25, 0.75)}

Over = Callable[[Column], Column]


def plain(c: Column) -> Column:
    return c


def stat(name: str, x: Column, over: Over = plain) -> Column:
    """One statistic of the non-NULL values of ``x``; NULL where it is undefined."""
    n = over(F.count(x)).cast("double")
    if name == "count":
        return over(F.count(x))
    if name == "ucount":
        return over(F.count_distinct(x)) if over is plain else F.size(over(F.collect_set(x)))
    if name == "range":
        return over(F.max(x)) - over(F.min(x))
    if name == "devsq":
        return over(F.var_pop(x)) * n
    if name == "cv":
        return F.try_divide(over(F.stddev_pop(x)), over(F.avg(x)))
    if name == "uskew":
        return F.when(n >= 3, over(F.skewness(x)) * F.sqrt(n * (n - 1)) / (n - 2))
    if name == "ukurt":
        g2 = over(F.kurtosis(x))
        return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    if name == "mode":
        return over(F.mode(x, True))
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # the same for all of them: one map of values
    if name in ("qtile1", "median", "qtile3"):
        return F.get(over(quartiles), F.lit(("qtile1", "median", "qtile3").index(name)))
    if name == "qrange":
        return F.get(over(quartiles), F.lit(2)) - F.get(over(quartiles), F.lit(0))
    simple = {
        "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "var": F.var_pop, "uvar": F.var_samp,
        "sd": F.stddev_pop, "usd": F.stddev_samp, "skew": F.skewness, "kurt": F.kurtosis,
    }
    if name not in simple:
        raise ValueError(f"unknown statistic {name!r}; have {STATS}")
    return over(simple[name](x))


def strict_if(strict: bool, x: Column, value: Column, over: Over = plain) -> Column:
    """With ``strict`` a single NULL among the values makes the result NULL."""
    return F.when(over(F.count(x)) == over(F.count(F.lit(1))), value) if strict else value

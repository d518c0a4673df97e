"""Group-wise features: about seventy, computed together rather than one job each.

Plain aggregates share one aggregation. Features that compare a value with a group
statistic get that statistic attached first. Order-dependent features share one ordered
pass per time column. Value counts, histogram bins and runs each need one more partial
aggregation; all parts meet in a join on the keys, one row per key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import number
from millrace.functions.similarity import pearson
from millrace.functions.spec import as_list, ident
from millrace.functions.stats import QUANTILE_POINTS, STATS, stat
from millrace.operators.aggs import _attach, _attach_rows, describe
from millrace.operators.timeseries import seconds
from millrace.plans.fourier import magnitude_sums
from millrace.plans.ordered import ALL, BLOCK_ROWS, Ordered, hot_groups, join_keys, quantiles, setting, totals

# fixed values: feature names by what they need
TEXT = "miss strucount strmin strmax has_dup value_count".split()
REPEATS = "repeatdata repeatvalues sum_repeatdata sum_repeatvalues has_dup_min has_dup_max".split()
AGAINST = {  # group statistics a feature compares with
    "count_above_mean": ["mean"], "count_below_mean": ["mean"], "median_ad": ["median"], "mean_ad": ["mean"],
    "ratio_beyond_rsigma": ["mean", "sd"], "autocorr": ["mean", "var", "count"], "imq": ["abs", "count"],
    "longest_strike_above_mean": ["mean"], "longest_strike_below_mean": ["mean"], "binned_entropy": ["min", "max"],
}
SIMPLE = "ratio_unique hmean gmean abs_energy rms var_gt_sd sym_looking large_sd quantile range_count".split()
TIMED = ("slope slope_pearson slope_pattern mean_second_derivative_central mean_change mean_abs_change abs_sum_changes "
         "integral meanf varf firstmin firstmax lastmin lastmax longest_strike_above_mean longest_strike_below_mean "
         "autocorr crossing_m peaks imq").split()
FEATURES = ["rows", *STATS, *TEXT, *REPEATS, *[a for a in AGAINST if a not in TIMED], *SIMPLE, *TIMED]


@dataclass(frozen=True)
class Feature:
    """A feature of a column; ``time`` orders it, ``arg``/``arg2`` are its parameters."""

    name: str
    field: str | None = None
    arg: object = None
    arg2: object = None
    time: str | None = None


def features(df: DataFrame, by, wants: dict[str, Feature]) -> DataFrame:
    """{output: Feature} for every key; keys without a valid value stay, with NULLs."""
    keys = as_list(by)
    for name, f in wants.items():
        if f.name not in FEATURES:
            raise ValueError(f"{name}: unknown feature {f.name!r}")
        if (f.name in TIMED) != (f.time is not None):
            raise ValueError(f"{name}: {f.name} {'needs' if f.name in TIMED else 'takes no'} time column")
    fields = list(dict.fromkeys(f.field for f in wants.values() if f.field))
    times = list(dict.fromkeys(f.time for f in wants.values() if f.time))
    xs, ts = {f: f"__x{i}" for i, f in enumerate(fields)}, {t: f"__t{i}" for i, t in enumerate(times)}
    is_text = {f: not isinstance(df.schema[f].dataType, T.NumericType) for f in fields}
    base = df.select(*[ident(k) for k in keys], *[ident(f).alias(f"__raw{i}") for i, f in enumerate(fields)],
                     *[(number(ident(f)) if is_text[f] else ident(f).cast("double")).alias(xs[f]) for f in fields],
                     *[seconds(df, t).alias(ts[t]) for t in times])
    raw = {f: f"__raw{i}" for i, f in enumerate(fields)}

    plain = {n: f for n, f in wants.items() if f.name not in TIMED and f.name not in REPEATS and f.name != "binned_entropy"}
    parts = [_plain(base, keys, plain, xs, raw)]
    for field in fields:
        group = {n: f for n, f in wants.items() if f.name in REPEATS and f.field == field}
        if group:
            parts.append(_repeats(base, keys, group, xs[field]))
    for n, f in wants.items():
        if f.name == "binned_entropy":
            parts.append(_entropy(base, keys, n, xs[f.field], int(f.arg)))
    for t in times:
        group = {n: f for n, f in wants.items() if f.time == t}
        parts += _timed(base, keys, group, xs, ts[t])
    out = parts[0]
    for part in parts[1:]:
        out = _attach(out, part, keys)
    return out.select(*[ident(k) for k in keys], *[ident(n) for n in wants])


def _statistics(base: DataFrame, keys: list[str], needed: dict[str, tuple[str, str]]) -> DataFrame:
    """Attach the group statistics the second pass compares with."""
    if not needed:
        return base
    if any(s == "median" for s, _ in needed.values()):
        return _attach_rows(base, describe(base, keys, needed), keys)
    return totals(base, keys, {n: F.sum(F.abs(F.col(c))) if s == "abs" else stat(s, F.col(c)) for n, (s, c) in needed.items()})


def _plain(base: DataFrame, keys: list[str], wants: dict[str, Feature], xs: dict, raw: dict) -> DataFrame:
    needed = {f"{xs[f.field]}_{s}": (s, xs[f.field]) for f in wants.values() for s in AGAINST.get(f.name, ())}
    data = _statistics(base, keys, needed)
    by = [ident(k) for k in keys]
    holistic, aggs = {}, [F.count(F.lit(1)).alias("__rows")]
    points = {}

    def q(column: str, p: float) -> Column:
        points[f"{column}__q{p}"] = (column, p)
        return ident(f"{column}__q{p}")

    for n, f in wants.items():
        x = F.col(xs[f.field]) if f.field else None
        r = F.col(raw[f.field]) if f.field else None
        of = lambda s: F.col(f"{xs[f.field]}_{s}")
        if f.name in QUANTILE_POINTS:
            at = [q(xs[f.field], p) for p in QUANTILE_POINTS[f.name]]
            holistic[n] = at[0] if len(at) == 1 else at[1] - at[0]
            continue
        if f.name == "quantile":
            holistic[n] = q(xs[f.field], float(f.arg))
            continue
        if f.name == "sym_looking":
            aggs += [F.avg(x).alias(f"__m_{n}"), (F.max(x) - F.min(x)).alias(f"__r_{n}")]
            holistic[n] = (F.abs(ident(f"__m_{n}") - q(xs[f.field], 0.5)) < ident(f"__r_{n}") * float(f.arg)).cast("int")
            continue
        if f.name == "mode":
            holistic[n] = None
            continue
        aggs.append(_aggregate(f, x, r, of).alias(n))
    out = data.groupBy(*by).agg(*aggs)
    if points:
        out = _attach(out, quantiles(base, keys, points), keys)
    modes = {n: ("mode", xs[wants[n].field]) for n, e in holistic.items() if e is None}
    if modes:
        out = _attach(out, describe(base, keys, modes), keys)
    return out.withColumns({n: e for n, e in holistic.items() if e is not None}).select(*by, *[ident(n) for n in wants])


def _aggregate(f: Feature, x: Column, r: Column, of) -> Column:
    """Features that are one aggregate, given the attached statistics."""
    rows, n = F.count(F.lit(1)), F.count(x) if x is not None else None
    flag = lambda c: c.cast("int")
    empty_as_value = F.coalesce(r.cast("string"), F.lit("")) if r is not None else None
    if f.name in STATS:
        return F.count(r) if f.name == "count" else stat(f.name, x)
    negative = F.min(x) < 0 if x is not None else None
    table = {
        "rows": lambda: rows,
        "miss": lambda: rows - F.count(r),
        "strucount": lambda: F.count_distinct(empty_as_value),
        "strmin": lambda: F.min(r.cast("string")),
        "strmax": lambda: F.max(r.cast("string")),
        "has_dup": lambda: flag(F.count_distinct(empty_as_value) != F.count(r)),
        "value_count": lambda: F.count_if(r.cast("string") == F.lit(f.arg) if isinstance(f.arg, str) else x == F.lit(float(f.arg))),
        "ratio_unique": lambda: F.try_divide(F.count_distinct(x), n),
        "count_above_mean": lambda: F.count_if(x > of("mean")),
        "count_below_mean": lambda: F.count_if(x < of("mean")),
        "hmean": lambda: F.when(~negative & (F.min(x) == 0), F.lit(0.0)).when(~negative, n / F.sum(F.try_divide(F.lit(1.0), x))),
        "gmean": lambda: F.when(~negative & (F.min(x) == 0), F.lit(0.0)).when(~negative, F.exp(F.avg(F.when(x > 0, F.log(x))))),
        "abs_energy": lambda: F.sum(x * x),
        "rms": lambda: F.sqrt(F.avg(x * x)),
        "median_ad": lambda: F.avg(F.abs(x - of("median"))),
        "mean_ad": lambda: F.avg(F.abs(x - of("mean"))),
        "var_gt_sd": lambda: flag(F.var_pop(x) > F.stddev_pop(x)),
        "large_sd": lambda: flag(F.stddev_pop(x) > (F.max(x) - F.min(x)) * float(f.arg)),
        "ratio_beyond_rsigma": lambda: F.avg((F.abs(x - of("mean")) >= of("sd") * float(f.arg)).cast("double")),
        "range_count": lambda: F.count_if((x >= float(f.arg)) & (x < float(f.arg2))),
    }
    return table[f.name]()


def _repeats(base: DataFrame, keys: list[str], wants: dict[str, Feature], x: str) -> DataFrame:
    """Features of how often values repeat, from one count per (key, value)."""
    by = [ident(k) for k in keys]
    counts = base.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__c"))
    c, v = F.col("__c"), F.col(x)
    table = {
        "repeatdata": F.avg((c > 1).cast("double")),
        "repeatvalues": F.sum(F.when(c > 1, c).otherwise(0)) / F.sum(c),
        "sum_repeatdata": F.sum(F.when(c > 1, c * v).otherwise(0.0)),
        "sum_repeatvalues": F.sum(F.when(c > 1, v).otherwise(0.0)),
        "has_dup_min": (F.min_by(c, v) > 1).cast("int"),
        "has_dup_max": (F.max_by(c, v) > 1).cast("int"),
    }
    return counts.groupBy(*by).agg(*[table[f.name].alias(n) for n, f in wants.items()])


def _entropy(base: DataFrame, keys: list[str], name: str, x: str, bins: int) -> DataFrame:
    """Entropy of n equal-width bins: ln(total) - sum(c ln c) / total."""
    by = [ident(k) for k in keys]
    data = totals(base.filter(F.col(x).isNotNull()), keys, {"__lo": F.min(x), "__hi": F.max(x)})
    width = (F.col("__hi") - F.col("__lo")) / bins
    cell = F.least(F.coalesce(F.floor(F.try_divide(F.col(x) - F.col("__lo"), width)), F.lit(0)) + 1, F.lit(bins))
    hist = data.withColumn("__bin", cell).groupBy(*by, "__bin").agg(F.count(F.lit(1)).cast("double").alias("__c"))
    c = F.col("__c")
    return hist.groupBy(*by).agg((F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)).alias(name))


def _timed(base: DataFrame, keys: list[str], wants: dict[str, Feature], xs: dict, t: str) -> list[DataFrame]:
    """Order-dependent features over one time column; rows without a time do not take part."""
    used = list(dict.fromkeys(f.field for f in wants.values()))
    by = [ident(k) for k in keys]
    data = base.filter(F.col(t).isNotNull()).select(*by, F.col(t).alias("__t"), *[F.col(xs[f]) for f in used])
    parts = []
    spectral = {n: f for n, f in wants.items() if f.name in ("meanf", "varf")}
    for field in dict.fromkeys(f.field for f in spectral.values()):
        parts.append(_spectrum(data, keys, {n: f for n, f in spectral.items() if f.field == field}, xs[field]))
    rest = {n: f for n, f in wants.items() if n not in spectral}
    if not rest:
        return parts
    needed = {f"{xs[f.field]}_{s}": (s, xs[f.field]) for f in rest.values() for s in AGAINST.get(f.name, ())}
    o = Ordered(_statistics(data, keys, needed), keys, ["__t"])
    reach = max([2, *[int(f.arg) for f in rest.values() if f.name in ("autocorr", "peaks")]])

    def steps(w):
        cols = {"__dt": F.col("__t") - F.lag("__t").over(w)}
        for field in dict.fromkeys(f.field for f in rest.values()):
            x = xs[field]
            cols |= {f"{x}_p": F.lag(x).over(w), f"{x}_n": F.lead(x).over(w), f"{x}_nn": F.lead(x, 2).over(w)}
        for n, f in rest.items():
            x, k = xs[f.field], int(f.arg) if f.name in ("autocorr", "peaks") else 0
            if f.name == "autocorr":
                cols[f"__l_{n}"] = F.lead(x, k).over(w)
            if f.name == "peaks":
                high = F.greatest(F.max(x).over(w.rowsBetween(-k, -1)), F.max(x).over(w.rowsBetween(1, k)))
                cols[f"__l_{n}"] = F.when(F.lag("__t", k).over(w).isNotNull() & F.lead("__t", k).over(w).isNotNull(), F.col(x) > high)
        return cols

    runs = {}
    for n, f in rest.items():
        x = F.col(xs[f.field])
        of = lambda s: F.col(f"{xs[f.field]}_{s}")
        if f.name == "longest_strike_above_mean":
            runs[f"__g_{n}"] = ("sum", F.coalesce((x >= of("mean")), F.lit(False)).cast("int"))
        elif f.name == "longest_strike_below_mean":
            runs[f"__g_{n}"] = ("sum", F.coalesce((x <= of("mean")), F.lit(False)).cast("int"))
        elif f.name == "imq":
            runs[f"__g_{n}"] = ("sum", F.abs(x))
        elif f.name == "slope_pattern":
            runs[f"__g_{n}"] = ("count", x)
    o.frame(reach, reach, steps)
    if runs:
        strikes = {g: (kind, F.lit(1) - c) if "strike" in rest[g[4:]].name else (kind, c) for g, (kind, c) in runs.items()}
        o.running(**strikes)
    ordered = o.result()
    aggs = []
    for n, f in rest.items():
        if "strike" not in f.name:
            aggs.append(_series(n, f, xs[f.field]).alias(n))
    if aggs:
        parts.append(ordered.groupBy(*by).agg(*aggs))
    for n, f in rest.items():
        if "strike" in f.name:
            x, mean = F.col(xs[f.field]), F.col(f"{xs[f.field]}_mean")
            hit = x >= mean if "above" in f.name else x <= mean
            length = ordered.groupBy(*by, f"__g_{n}").agg(F.count_if(hit).alias("__c"))
            parts.append(length.groupBy(*by).agg(F.max("__c").alias(n)))
    return parts


def _series(n: str, f: Feature, name: str) -> Column:
    """The aggregate of an order-dependent feature over the prepared columns."""
    x, t = F.col(name), F.col("__t")
    prev, nxt, after = F.col(f"{name}_p"), F.col(f"{name}_n"), F.col(f"{name}_nn")
    of = lambda s: F.col(f"{name}_{s}")
    lagged, seen = F.col(f"__l_{n}"), F.col(f"__g_{n}")
    span = F.max(t) - F.min(t)

    def extreme(pick, order):
        return F.try_divide(pick(t, order) - F.min(t), span)

    table = {
        # every row counts in the variance of time, also those without a value
        "slope": lambda: F.try_divide(F.covar_pop(x, t), F.var_pop(t)),
        "slope_pearson": lambda: pearson(F.when(x.isNotNull(), t), x),
        "slope_pattern": lambda: pearson(F.when(x.isNotNull(), seen.cast("double")), x),
        "mean_second_derivative_central": lambda: F.avg(after - nxt * 2 + x),
        "mean_change": lambda: F.avg(nxt - x),
        "mean_abs_change": lambda: F.avg(F.abs(nxt - x)),
        "abs_sum_changes": lambda: F.sum(F.abs(x - prev)),
        "integral": lambda: F.sum((x + prev) / 2 * F.col("__dt")),
        "firstmin": lambda: extreme(F.min_by, F.when(x.isNotNull(), F.struct(x, t))),
        "lastmin": lambda: extreme(F.min_by, F.when(x.isNotNull(), F.struct(x, -t))),
        "firstmax": lambda: extreme(F.max_by, F.when(x.isNotNull(), F.struct(x, -t))),
        "lastmax": lambda: extreme(F.max_by, F.when(x.isNotNull(), F.struct(x, t))),
        "autocorr": lambda: F.try_divide(F.try_divide(F.sum((x - F.col(f"{name}_mean")) * (lagged - F.col(f"{name}_mean"))),
                                                      F.max(F.col(f"{name}_count")).cast("double") - float(f.arg)), F.max(F.col(f"{name}_var"))),
        "crossing_m": lambda: F.count_if((x > float(f.arg)) != (nxt > float(f.arg))),
        "peaks": lambda: F.sum(lagged.cast("int")),
        "imq": lambda: F.try_divide(F.min(F.when(F.try_divide(seen, of("abs")) >= float(f.arg), t)), F.max(of("count")).cast("double")),
    }
    return table[f.name]()


def _spectrum(data: DataFrame, keys: list[str], wants: dict[str, Feature], x: str) -> DataFrame:
    """Centroid and variance of the magnitude spectrum of each series.

    A series of up to ``blockRows`` rows is transformed in one task, a longer one in many (``plans.fourier``).
    """
    block = setting(data.sparkSession, "blockRows", BLOCK_ROWS)
    base = data if keys else data.withColumn(ALL, F.lit(0))
    group = keys or [ALL]
    hot = hot_groups(base, group)
    by = [ident(k) for k in group]
    fields = [base.schema[k] for k in group]
    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in ("__s0", "__s1", "__s2"))])

    def transform(key, pdf: pd.DataFrame) -> pd.DataFrame:
        series = pdf.sort_values("__t", kind="stable")[x].to_numpy(dtype="float64")
        size = np.abs(np.fft.rfft(series))
        place = np.arange(size.size)
        return pd.DataFrame([[*key, size.sum(), size @ place, size @ np.square(place)]], columns=schema.names)

    rows = base.select(*by, "__t", x)
    short = rows if hot is None else join_keys(rows, hot.drop("__n"), group, "left_anti", hint=True)
    sums = short.groupBy(*by).applyInPandas(transform, schema)
    if hot is not None:
        sums = sums.unionByName(magnitude_sums(rows, group, "__t", x, hot, block))
    mean = F.col("__s1") / F.col("__s0")
    spread = F.greatest(F.col("__s2") / F.col("__s0") - mean * mean, F.lit(0.0))
    known = (F.col("__s0") > 0) & ~F.isnan("__s0") & (F.col("__s0") < float("inf"))
    named = {n: F.when(known, mean if f.name == "meanf" else spread) for n, f in wants.items()}
    return sums.select(*[ident(k) for k in keys], *[c.alias(n) for n, c in named.items()])

"""Sensor time series: running periods, interpolation, time joins, time axes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import epoch
from millrace.functions.spec import as_list, ident, no_clash
from millrace.operators.rows import counted
from millrace.plans.folds import fold, with_arrays
from millrace.plans.ordered import BLK, HOME, RN, Ordered, join_spread, number_rows

# output columns of the running-period operator
PERIOD = ("start", "end", "interval", "stop_begins", "stop_ends", "run_begins", "run_ends", "run_id", "stop_id")


def seconds(df: DataFrame, time: str) -> Column:
    """The time column as a double: epoch seconds, days for dates, the number itself otherwise."""
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return epoch(ident(time).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(ident(time)).cast("double")
    return ident(time).cast("double")


def _stop_walk(limit: float):
    """Flag intervals that reach ``limit`` times the running mean; each flag restarts the mean.

    State: sum and number of the intervals since the last restart.
    """
    def walk(pdf: pd.DataFrame, total: float, n: float):
        flags = []
        for x in pdf["__gap"].to_numpy(dtype="float64").tolist():
            mean = total / n if n else 0.0
            stop = mean != 0 and x / mean >= limit  # False for NaN
            if n == 0 or stop:
                total, n = x, 1.0
            else:
                total, n = total + x, n + (x == x)
            flags.append(int(stop))
        return flags, total, n

    return walk


def running_periods(df: DataFrame, time: str, by=None, stop_after: float | None = None, stop_ratio: float | None = None,
                    names: Sequence[str] = PERIOD) -> DataFrame:
    """Divide each key's rows into running periods and stops.

    A stop begins at a row whose interval to the next row is at least ``stop_after``
    seconds, or at least ``stop_ratio`` times the mean interval since the last stop.
    Run and stop numbers count inside the key.
    """
    if (stop_after is None) == (stop_ratio is None):
        raise ValueError("give stop_after or stop_ratio")
    no_clash(df, names)
    begin, end, gap, ss, se, rb, re_, rid, sid = names
    data = df.withColumn("__t", seconds(df, time))
    o = Ordered(data, by, ["__t"])
    o.frame(1, 1, lambda w: {
        begin: ident(time), end: F.lead(ident(time)).over(w), "__gap": F.lead("__t").over(w) - F.col("__t"),
        "__top": F.lag(F.lit(1)).over(w).isNull(), "__bot": F.lead(F.lit(1)).over(w).isNull()})
    if stop_after is not None:
        o.with_columns({ss: F.coalesce((F.col("__gap") >= stop_after).cast("int"), F.lit(0))})
    else:
        o = Ordered(fold(o, ["__gap"], _stop_walk(stop_ratio), ss), by, ["__t"])
    o.frame(1, 0, lambda w: {se: F.coalesce(F.lag(ident(ss)).over(w), F.lit(0))})
    o.with_columns({
        rb: ((F.col("__top") & (ident(ss) == 0)) | (ident(se) == 1)).cast("int"),
        re_: (F.col("__bot") | (ident(ss) == 1)).cast("int"),
    })
    o.running(**{rid: ("sum", ident(rb)), sid: ("sum", ident(ss))})
    out = o.result().withColumnRenamed("__gap", gap)
    return out.select(*[ident(c) for c in df.columns], *[ident(n) for n in names])


def global_run_id(df: DataFrame, by, run: str = "run_id", name: str = "global_run_id") -> DataFrame:
    """Number runs over the whole table: per-key numbers plus the runs of the keys before."""
    keys = as_list(by)
    per_key = df.groupBy(*[ident(k) for k in keys]).agg(F.max(ident(run)).alias("__r"))
    before = Ordered(per_key, None, keys).running(__off=("sum", F.col("__r"), False)).result()
    before = before.select(*[ident(k) for k in keys], F.coalesce("__off", F.lit(0)).alias("__off"))
    return join_spread(df, before, keys).withColumn(name, ident(run) + F.col("__off")).drop("__off")


Item = tuple[str, str, str]  # column, method, output
METHODS = ("previous", "next", "nearest", "linear")


def _between(method: str, t: Column, prev: Column, nxt: Column) -> Column:
    """Value at time t between the neighbouring valid points (structs of t and v)."""
    if method == "previous":
        return prev["v"]
    if method == "next":
        return nxt["v"]
    if method == "nearest":
        mid = (prev["t"] + nxt["t"]) / 2
        return F.when(t <= mid, prev["v"]).when(t > mid, nxt["v"])
    slope = F.try_divide(nxt["v"] - prev["v"], nxt["t"] - prev["t"])
    return slope * t + prev["v"] - slope * prev["t"]


def _with_runs(df: DataFrame, time: str, by, stop_after) -> tuple[DataFrame, list[str]]:
    keys = as_list(by)
    if stop_after is None:
        return df, keys
    runs = running_periods(df, time, by, stop_after, names=[f"__p_{n}" for n in PERIOD])
    kept = [c for c in runs.columns if not c.startswith("__p_") or c == "__p_run_id"]
    return runs.select(*[ident(c) for c in kept]), [*keys, "__p_run_id"]


def interpolate(df: DataFrame, time: str, items: Sequence[Item], by=None, stop_after: float | None = None, formula: bool = False,
                overlap: int = 100) -> DataFrame:
    """Fill missing values from the neighbouring valid points of the key, never across a stop.

    ``formula`` returns the interpolation formula instead of values: ``_prev``/``_next``,
    ``_mid``/``_prev``/``_next``, ``_slope``/``_intercept`` or the cubic coefficients.
    """
    data, keys = _with_runs(df, time, by, stop_after)
    plain = [i for i in items if i[1] != "cubic_spline"]
    unknown = [i[1] for i in plain if i[1] not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods {unknown}")
    out = data.withColumn("__t", seconds(df, time))
    if plain:
        fields = list(dict.fromkeys(f for f, _, _ in plain))
        valid = {f: F.when(ident(f).isNotNull(), F.struct(F.col("__t").alias("t"), ident(f).alias("v"))) for f in fields}
        o = Ordered(out, keys, ["__t"])
        o.running(**{f"__prev_{i}": ("last", valid[f]) for i, f in enumerate(fields)})
        # a formula holds until the next valid point, so that point lies strictly ahead
        o.running(True, **{f"__next_{i}": ("last", valid[f], not formula) for i, f in enumerate(fields)})
        done = {}
        for f, method, name in plain:
            i = fields.index(f)
            prev, nxt, t = F.col(f"__prev_{i}"), F.col(f"__next_{i}"), F.col("__t")
            if not formula:
                done[name] = F.coalesce(ident(f), _between(method, t, prev, nxt))
            elif method in ("previous", "next"):
                done |= {f"{name}_prev": prev["v"]} if method == "previous" else {f"{name}_prev": prev["v"], f"{name}_next": nxt["v"]}
            elif method == "nearest":
                done |= {f"{name}_mid": (prev["t"] + nxt["t"]) / 2, f"{name}_prev": prev["v"], f"{name}_next": nxt["v"]}
            else:
                slope = F.try_divide(nxt["v"] - prev["v"], nxt["t"] - prev["t"])
                done |= {f"{name}_slope": slope, f"{name}_intercept": prev["v"] - slope * prev["t"]}
        out = o.with_columns(done).result(*[f"__{d}_{i}" for d in ("prev", "next") for i in range(len(fields))])
    for f, method, name in items:
        if method == "cubic_spline":
            out = _spline(out, f, name, keys, formula, overlap)
    return out.drop("__t", "__p_run_id")


def solve_tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Unknowns of low[i] x[i-1] + mid[i] x[i] + up[i] x[i+1] = right[i], by cyclic reduction.

    Every second equation is freed of its neighbours' unknowns, which leaves a system of half the size.
    """
    n = len(mid)
    if n == 1:
        return right / mid
    odd = np.arange(1, n, 2)
    nxt = np.minimum(odd + 1, n - 1)
    a = low[odd] / mid[odd - 1]
    b = np.where(odd + 1 < n, up[odd] / mid[nxt], 0.0)
    x = np.zeros(n + 2)  # x[i] stands at i + 1, with zeros at both ends
    x[odd + 1] = solve_tridiagonal(-a * low[odd - 1], mid[odd] - a * up[odd - 1] - b * low[nxt], -b * up[nxt], right[odd] - a * right[odd - 1] - b * right[nxt])
    even = np.arange(0, n, 2)
    x[even + 1] = (right[even] - low[even] * x[even] - up[even] * x[even + 2]) / mid[even]
    return x[1:-1]


def spline_coefficients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cubic spline through at least four points whose third derivative is continuous at the second and the last but
    one point: rows c3, c2, c1, c0 per interval. The unknowns are the second derivatives at the points."""
    return splines(x, y, np.array([0]))[:, :-1]


def splines(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``spline_coefficients`` of several series one after the other, each of at least four points and from one of
    ``starts``; a column per point, that of a series' last point 0, 0, 0, y.

    The equations of series of similar length are solved as one system, in which nothing links one series with the
    next. Each is filled up to the same power of two, so it is reduced just as it would be alone.
    """
    ends = np.append(starts[1:], len(x)) - 1
    step = np.diff(x)
    step[ends[:-1]] = 1.0  # between two series, not used
    rise = np.diff(y) / step
    first, last = step[starts] / step[starts + 1], step[ends - 1] / step[ends - 2]
    low, up = np.append(0.0, step), np.append(step, 0.0)
    mid, right = 2 * (low + up), np.append(np.append(0.0, 6 * np.diff(rise)), 0.0)
    # the end values follow from their neighbours: m0 = m1 + first (m1 - m2), and likewise at the other end
    mid[starts + 1] += step[starts] * (1 + first)
    up[starts + 1] -= step[starts] * first
    low[starts + 1] = 0
    mid[ends - 1] += step[ends - 1] * (1 + last)
    low[ends - 1] -= step[ends - 1] * last
    up[ends - 1] = 0
    inner = np.ones(len(x), bool)
    inner[starts] = inner[ends] = False
    if len(starts) > 1 and not all(np.isfinite(c[inner]).all() for c in (low, mid, up, right)):
        # what is not finite would reach the other series
        return np.concatenate([splines(x[a:b + 1], y[a:b + 1], np.array([0])) for a, b in zip(starts, ends)], 1)
    m, unknowns = np.zeros(len(x)), ends - starts - 1
    power = np.ceil(np.log2(unknowns)).astype(int)
    for each in np.unique(power):
        of, wide = np.flatnonzero(power == each), 1 << int(each)
        place = np.arange(wide) < unknowns[of, None]
        at = (starts[of, None] + 1 + np.arange(wide))[place]
        system = [np.full(place.shape, fill) for fill in (0.0, 1.0, 0.0, 0.0)]
        for whole, part in zip(system, (low, mid, up, right)):
            whole[place] = part[at]
        m[at] = solve_tridiagonal(*(c.ravel() for c in system)).reshape(place.shape)[place]
    m[starts] = m[starts + 1] + first * (m[starts + 1] - m[starts + 2])
    m[ends] = m[ends - 1] + last * (m[ends - 1] - m[ends - 2])
    out = np.zeros((4, len(x)))
    out[:3, :-1] = np.diff(m) / (6 * step), m[:-1] / 2, rise - step * (2 * m[:-1] + m[1:]) / 6
    out[:3, ends] = 0
    out[3] = y
    return out


def _spline(df: DataFrame, field: str, name: str, keys: list[str], formula: bool, overlap: int) -> DataFrame:
    """Spline per key through its valid points; of points at one time the smallest value counts.

    Many series are fitted at a time. The points of a hot key are fitted block by block with ``overlap`` points on both sides: a point's influence fades
    by a factor of about four per point, so a hundred leave no difference in double precision. Rows then look up the
    interval they lie in as-of, so only keys, times and values pass through numpy.
    """
    value = ident(field).cast("double")
    valid = df.filter(value.isNotNull() & ~F.isnan(value) & F.col("__t").isNotNull() & ~F.isnan("__t"))
    points = valid.groupBy(*[ident(k) for k in keys], "__t").agg(F.min(value).alias("__v"))
    o = Ordered(points, keys, ["__t"])
    data = o.blocks(overlap, overlap)
    kept = [f for f in data.schema.fields if f.name in (*keys, "__t")]
    added = [T.StructField(c, T.DoubleType()) for c in ("__until", "c3", "c2", "c1", "c0")]
    names = [f.name for f in kept]

    group = o.keys if not o.split else [*o.keys, BLK]
    marked = data.withColumn("__g", F.xxhash64(*[ident(k) for k in group], *[ident(k).isNull() for k in group]))
    ordered = marked.repartition(*[ident(k) for k in group]).sortWithinPartitions(*group, RN)

    def begins(batches: list) -> np.ndarray:
        """Whether a row begins a series: positions inside one have no gap."""
        g, rn = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("__g", RN))
        return np.concatenate([[True], (g[1:] != g[:-1]) | (rn[1:] != rn[:-1] + 1)])

    def fit(batches: list) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        x, y = (table.column(c).to_numpy().astype("float64") for c in ("__t", "__v"))
        first = begins(batches)
        size = np.diff(np.append(np.flatnonzero(first), len(x)))
        enough = np.repeat(size >= 4, size)
        out = np.full((5, len(x)), np.nan)
        if enough.any():
            starts = np.flatnonzero(first[enough])
            out[1:, enough] = splines(x[enough], y[enough], starts)
            until = np.append(x[enough][1:], 0.0)
            ends = np.append(starts[1:], len(until)) - 1
            until[ends] = x[enough][ends]
            out[0, enough] = until
        own = pa.array((table.column(BLK).to_numpy() == table.column(HOME).to_numpy()))
        return with_arrays(table.select(names), {f.name: out[i] for i, f in enumerate(added)}, added).filter(own).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last series so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            cuts = np.flatnonzero(begins([*last, batch])[len(last):])
            if held and len(cuts) or len(cuts) > 1:
                yield from fit([*held, *([batch.slice(0, cuts[-1])] if cuts[-1] else [])])
                held, batch = [], batch.slice(cuts[-1])
            held.append(batch)
        if held:
            yield from fit(held)

    fitted = ordered.mapInArrow(run, T.StructType([*kept, *added]))
    side = fitted.select(*[ident(k) for k in keys], "__t", F.lit(0).alias("__kind"), F.struct(F.col("__t").alias("x0"), "__until", "c3", "c2", "c1", "c0").alias("__f"))
    own = df.select(*[ident(k) for k in keys], "__t", F.lit(1).alias("__kind"), F.struct(*[ident(c) for c in df.columns]).alias("__row"))
    like = df.select("__t", *[ident(k) for k in keys]).unionByName(points.drop("__v"))
    run = Ordered(own.unionByName(side, allowMissingColumns=True), keys, ["__t", "__kind"], like=like).running(__hit=("last", F.col("__f")))
    out = run.result().filter(F.col("__row").isNotNull())
    hit, t = F.col("__hit"), F.col("__t")
    if formula:
        done = [F.when(t < hit["__until"], hit[c]).alias(f"{name}_{c}") for c in ("x0", "c3", "c2", "c1", "c0")]
    else:
        d = t - hit["x0"]
        there = F.when(t <= hit["__until"], ((hit["c3"] * d + hit["c2"]) * d + hit["c1"]) * d + hit["c0"])
        given = F.col("__row")[field].cast("double")
        done = [F.when(given.isNotNull() & ~F.isnan(given), given).otherwise(there).alias(name)]
    return out.select("__row.*", *done)


def time_join(df: DataFrame, ref: DataFrame, time: str, ref_time: str, items: Sequence[Item], by=None, ref_by=None,
              stop_after: float | None = None) -> DataFrame:
    """Value of each reference column at the time of every row, by interpolation.

    A row takes part when it lies in some [t_j, t_j+1) of the reference; after the last
    point, and inside a stop, the result is NULL. Both tables are merged into one ordered
    run: the neighbours come from running values, not from pairs.
    """
    keys = as_list(by)
    rkeys = as_list(ref_by) or keys
    no_clash(df, [n for _, _, n in items])
    if [i for i in items if i[1] == "cubic_spline"]:
        return _time_join_formula(df, ref, time, ref_time, items, keys, rkeys, stop_after)
    runs, _ = _with_runs(ref, ref_time, rkeys, stop_after)
    run = F.col("__p_run_id") if stop_after is not None else F.lit(0).cast("long")
    fields = list(dict.fromkeys(f for f, _, _ in items))
    tr = seconds(ref, ref_time)
    side = runs.filter(tr.isNotNull()).select(
        *[ident(r).alias(k) for r, k in zip(rkeys, keys)], tr.alias("__t"), F.lit(0).alias("__kind"),
        F.struct(tr.alias("t"), run.alias("run")).alias("__any"),
        *[F.when(ident(f).isNotNull(), F.struct(tr.alias("t"), ident(f).alias("v"), run.alias("run"))).alias(f"__v{i}") for i, f in enumerate(fields)])
    own = df.select(*[ident(k) for k in keys], seconds(df, time).alias("__t"), F.lit(1).alias("__kind"),
                    F.struct(*[ident(c) for c in df.columns]).alias("__row"))
    both = own.unionByName(side, allowMissingColumns=True)
    marks = ["__any", *[f"__v{i}" for i in range(len(fields))]]
    o = Ordered(both, keys, ["__t", "__kind"])
    o.running(**{f"__a{m}": ("last", F.col(m)) for m in marks}).running(True, **{f"__b{m}": ("last", F.col(m)) for m in marks})
    out = o.result().filter(F.col("__row").isNotNull())
    here = F.col("__a__any")["run"]
    within = F.col("__t").isNotNull() & (here == F.col("__b__any")["run"])
    done = []
    for f, method, name in items:
        i = fields.index(f)
        prev, nxt = F.col(f"__a__v{i}"), F.col(f"__b__v{i}")
        prev, nxt = F.when(prev["run"] == here, prev), F.when(nxt["run"] == here, nxt)
        value = _between(method, F.col("__t"), prev, nxt)
        if method == "next":  # on a point itself, its own value
            value = F.when(prev["t"] == F.col("__t"), prev["v"]).otherwise(value)
        done.append(F.when(within, value).alias(name))
    return out.select("__row.*", *done)


def _time_join_formula(df, ref, time, ref_time, items, keys, rkeys, stop_after) -> DataFrame:
    """Splines: attach each reference row's coefficients, look the row up as-of, evaluate."""
    cubic = [i for i in items if i[1] == "cubic_spline"]
    others = [i for i in items if i[1] != "cubic_spline"]
    # every step below has a row per row of these, so they tell which keys are hot without the steps before
    like_ref = ref if stop_after is None else None
    like = df.select(seconds(df, time).alias("__t"), *[ident(k) for k in keys]).unionByName(ref.select(seconds(ref, ref_time).alias("__t"), *[ident(r).alias(k) for r, k in zip(rkeys, keys)]))
    if others:
        df = time_join(df, ref, time, ref_time, others, keys, rkeys, stop_after)
    formulas = interpolate(ref, ref_time, [(f, m, f"__c_{n}") for f, m, n in cubic], rkeys, stop_after, formula=True)
    data, group = _with_runs(formulas, ref_time, rkeys, stop_after)
    coef = [c for c in data.columns if c.startswith("__c_")]
    side = Ordered(data.withColumn("__t", seconds(ref, ref_time)), group, ["__t"], like=like_ref).frame(0, 1, lambda w: {"__until": F.lead("__t").over(w)}).result()
    side = side.filter("__until is not null").select(
        *[ident(r).alias(k) for r, k in zip(rkeys, keys)], F.col("__t"), F.lit(0).alias("__kind"),
        F.struct("__until", *[ident(c) for c in coef]).alias("__f"))
    own = df.select(*[ident(k) for k in keys], seconds(df, time).alias("__t"), F.lit(1).alias("__kind"),
                    F.struct(*[ident(c) for c in df.columns]).alias("__row"))
    o = Ordered(own.unionByName(side, allowMissingColumns=True), keys, ["__t", "__kind"], like=like).running(__hit=("last", F.col("__f")))
    out = o.result().filter(F.col("__row").isNotNull())
    done = []
    for _, _, n in cubic:
        p = lambda c: F.col("__hit")[f"__c_{n}_{c}"]
        d = F.col("__t") - p("x0")
        value = ((p("c3") * d + p("c2")) * d + p("c1")) * d + p("c0")
        done.append(F.when(F.col("__t") < F.col("__hit")["__until"], value).alias(n))
    return out.select("__row.*", *done)


def _axis_value(kind: str, start: Column, step: Column) -> Column:
    """start + step in the unit of the axis: seconds, days, calendar months or plain numbers."""
    if kind == "datetime":
        return F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + F.round(step * 1_000_000).cast("long"))
    if kind == "date":
        return F.date_add(start, step.cast("int"))
    if kind == "month":
        return F.add_months(start, step.cast("int"))
    return start + step


def _axis_count(kind: str, start: Column, end: Column, interval: float) -> Column:
    """Steps after the first point: floor(range / interval)."""
    if kind == "datetime":
        return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(interval * 1e6))
    if kind == "date":
        return F.floor(F.date_diff(end, start) / F.lit(interval))
    if kind == "month":
        return F.floor(F.floor(F.months_between(end, start)) / F.lit(interval))
    return F.floor((end - start) / F.lit(interval))


def axis(spark: SparkSession, name: str, kind: str, interval: float, start=None, count: int | DataFrame | None = None, spans=None) -> DataFrame:
    """A regular axis from start, interval and count (or one point per row of a table), or over [start, end] spans:
    a list, or a table whose first two columns they are."""
    dtype = {"datetime": "timestamp", "date": "date", "month": "date", "number": "double"}[kind]
    if isinstance(count, DataFrame):
        base = number_rows(count).select((F.col(RN) - 1).alias("__i"))
        return base.select(_axis_value(kind, F.lit(start).cast(dtype), F.col("__i") * F.lit(interval)).alias(name))
    if isinstance(spans, DataFrame):
        first, last = spans.columns[:2]
        base = spans.select(ident(first).cast(dtype).alias("s"), ident(last).cast(dtype).alias("e"))
        return counted(base, F.lit(0), _axis_count(kind, F.col("s"), F.col("e"), interval), "__i").select(_axis_value(kind, F.col("s"), F.col("__i") * F.lit(interval)).alias(name))
    if spans is None:
        base = spark.range(count or 0).withColumnRenamed("id", "__i")
        return base.select(_axis_value(kind, F.lit(start).cast(dtype), F.col("__i") * F.lit(interval)).alias(name))
    rows = [(str(a) if not isinstance(a, (date, datetime, float, int)) else a, b) for a, b in spans]
    base = spark.createDataFrame([(str(a), str(b)) for a, b in rows], "s string, e string")
    s, e = F.col("s").cast(dtype), F.col("e").cast(dtype)
    out = counted(base, F.lit(0), _axis_count(kind, s, e, interval), "__i")
    return out.select(_axis_value(kind, s, F.col("__i") * F.lit(interval)).alias(name))


def axis_of(df: DataFrame, time: str, kind: str, interval: float, by=None, name: str | None = None, stop_after: float | None = None) -> DataFrame:
    """The axis from the first to the last time of each key (or of each running period)."""
    data, keys = _with_runs(df, time, by, stop_after)
    if stop_after is not None:
        data = data.withColumnRenamed("__p_run_id", "run_id")
        keys = [*keys[:-1], "run_id"]
    ends = data.filter(ident(time).isNotNull()).groupBy(*[ident(k) for k in keys]).agg(F.min(ident(time)).alias("__s"), F.max(ident(time)).alias("__e"))
    out = counted(ends, F.lit(0), _axis_count(kind, F.col("__s"), F.col("__e"), interval), "__i")
    value = _axis_value(kind, F.col("__s"), F.col("__i") * F.lit(interval)).cast(df.schema[time].dataType)
    return out.select(*[ident(k) for k in keys], value.alias(name or time))

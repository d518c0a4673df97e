"""Order-dependent operators: numbering, running values, sliding and moving windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.similarity import MOVING_MEASURES, RANK_MEASURES, frame_ranks, pair
from millrace.functions.spec import as_list, expand, ident, no_clash, order_keys, renames, sort_columns
from millrace.functions.stats import MOVING_STATS, stat, strict_if
from millrace.plans.folds import in_order, with_arrays
from millrace.plans.ordered import ALL, BLK, HOME, RN, Ordered, hot_groups, join_keys, join_spread, number_rows, totals


def letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, up to twelve letters."""
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("text"))

    def digit(acc, _):
        rest = acc["rest"]
        more = F.concat(F.char(F.pmod(rest - 1, F.lit(26)) + 65), acc["text"])
        return F.struct(F.floor((rest - 1) / 26).cast("long").alias("rest"), F.when(rest > 0, more).otherwise(acc["text"]).alias("text"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, digit, lambda acc: acc["text"])


def letter_value(text: str) -> int:
    value = 0
    for ch in text:
        value = value * 26 + ord(ch) - 64
    return value


def _scaled(position: Column, start, step: int) -> Column:
    """0-based position -> start + position * step, or the letter sequence."""
    if isinstance(start, str) and start.isalpha():
        return letters(position * step + letter_value(start))
    return position * step + int(start)


def ranks(df: DataFrame, by, order, name: str, dense: bool) -> DataFrame:
    """Rank of the order values inside the key; ties share a rank.

    With a hot key, counts per distinct order value are ranked and joined back.
    """
    keys, ks = as_list(by), order_keys(order)
    base = df if keys else df.withColumn(ALL, F.lit(0))
    parts = keys or [ALL]
    if hot_groups(base, parts) is None:
        w = Window.partitionBy(*[ident(k) for k in parts]).orderBy(*[k.sort() for k in ks])
        return base.withColumn(name, (F.dense_rank() if dense else F.rank()).over(w).cast("long")).drop(ALL)
    vals = {f"__o{i}": k.value() for i, k in enumerate(ks)}
    base = base.withColumns(vals)
    groups = base.groupBy(*[ident(k) for k in parts], *vals).agg(F.count(F.lit(1)).alias("__w"))
    inner = [f"{v}%r" if k.desc else v for v, k in zip(vals, ks)]
    o = Ordered(groups, parts, inner).running(__seen=("sum", F.col("__w") if not dense else F.lit(1).cast("long")))
    rank = F.col("__seen") if dense else F.col("__seen") - F.col("__w") + 1
    ranked = o.result().select(*[ident(k) for k in parts], *vals, rank.alias(name))
    return join_spread(base, ranked, [*parts, *vals]).drop(*vals, ALL)


def number(df: DataFrame, name: str, by=None, order=None, mode: str = "seq", start=1, step: int = 1, groups: bool = False) -> DataFrame:
    """Append a sequence, a dense rank (``same``) or a rank with gaps (``skip``); ``groups`` numbers the keys."""
    no_clash(df, [name])
    keys = as_list(by)
    if groups:
        found = df.select(*[ident(k) for k in keys]).distinct()
        numbered = number_rows(found, None, keys, "__n").withColumn(name, _scaled(F.col("__n") - 1, start, step)).drop("__n")
        return join_spread(df, numbered, keys)
    if mode == "seq":
        out = number_rows(df, keys, order, "__n")
    else:
        out = ranks(df, keys, order, "__n", dense=mode == "same")
    return out.withColumn(name, _scaled(F.col("__n") - 1, start, step)).drop("__n")


def share(df: DataFrame, fields, by=None) -> DataFrame:
    """Value divided by the group total."""
    pairs = renames(fields)
    out = totals(df, by, {f"__s_{s}": F.sum(ident(s)) for s in pairs})
    return out.withColumns({d: F.try_divide(ident(s).cast("double"), ident(f"__s_{s}")) for s, d in pairs.items()}).drop(*[f"__s_{s}" for s in pairs])


def normalize(df: DataFrame, fields, by=None, method: str = "z") -> DataFrame:
    """``z`` score, ``Z`` (z * 10 + 50) or ``range`` (0 to 1) inside the group; no spread gives NULL."""
    pairs, aggs = renames(fields), {}
    for s in pairs:
        x = ident(s)
        a, b = (F.min(x), F.max(x)) if method == "range" else (F.avg(x), F.stddev(x))
        aggs |= {f"__a_{s}": a, f"__b_{s}": b}
    out, done = totals(df, by, aggs), {}
    for s, d in pairs.items():
        a, b = ident(f"__a_{s}"), ident(f"__b_{s}")
        score = F.try_divide(ident(s).cast("double") - a, (b - a) if method == "range" else b)
        done[d] = score * 10 + 50 if method == "Z" else score
    return out.withColumns(done).drop(*aggs)


def key_break(df: DataFrame, by, order=None, names=("top", "bot")) -> DataFrame:
    """Flag the first and last row of each group with 1."""
    edge = lambda neighbour: F.when(neighbour.isNull(), F.lit(1))
    o = Ordered(df, by, order).frame(1, 1, lambda w: {
        names[0]: edge(F.lag(F.lit(1)).over(w)), names[1]: edge(F.lead(F.lit(1)).over(w))})
    return o.result()


def accumulate(df: DataFrame, fields, order, by=None) -> DataFrame:
    """Running totals in the key's order."""
    return Ordered(df, by, order).running(**{d: ("sum", ident(s)) for s, d in renames(fields).items()}).result()


def slide(df: DataFrame, fields, order, by=None, t: int = 1, back: bool = False, keep: bool = False, last_only: bool = False) -> DataFrame:
    """Bring the values of the next (``back``: previous) t rows along as ``name1 .. namet``.

    Rows that lack one of these neighbours are dropped unless ``keep``.
    """
    pairs = renames(fields)
    move = F.lag if back else F.lead

    def make(w):
        cols = {"__full": move(F.lit(1), t).over(w)}
        for s, d in pairs.items():
            for i in [t] if last_only else range(1, t + 1):
                cols[d if last_only else f"{d}{i}"] = move(ident(s), i).over(w)
        return cols

    out = Ordered(df, by, order).frame(t if back else 0, 0 if back else t, make).result()
    return (out if keep else out.filter("__full is not null")).drop("__full")


def window_rows(df: DataFrame, key: str, name: str, t: int, by=None, order=None, start: bool = False, keep: bool = False) -> DataFrame:
    """Copy each row into the t windows that contain it; ``name`` is the key of the window's last (or first) row.

    Windows with fewer than t rows are left out unless ``keep``.
    """
    o = Ordered(df, by, order or key)
    before, after = (0, t - 1) if start else (t - 1, 0)
    neighbour = F.lead if start else F.lag
    o.frame(before, after, lambda w: {"__full": neighbour(F.lit(1), t - 1).over(w).isNotNull()})
    span = (-(t - 1), 0) if start else (0, t - 1)
    entry = F.struct(ident(key).alias("k"), F.col("__full").alias("full"))
    o.frame(after, before, lambda w: {"__wins": F.collect_list(entry).over(w.rowsBetween(*span))})
    out = o.result().withColumn("__win", F.explode("__wins"))
    if not keep:
        out = out.filter("__win.full")
    return out.select(F.col("__win.k").alias(name), *[ident(c) for c in df.columns])


def _frame_columns(df: DataFrame, by, order, t_max: int, make, skip: int) -> DataFrame:
    def cols(w):
        out = make(w)
        if skip:
            out["__old"] = F.lag(F.lit(1), skip).over(w)
        return out

    out = Ordered(df, by, order).frame(max(t_max - 1, skip), 0, cols).result()
    return out.filter("__old is not null").drop("__old") if skip else out


def _over(w, t: int):
    return lambda c: c.over(w.rowsBetween(-(t - 1), 0))


def _moving_mean(x: Column, w, t: int, weighted: bool) -> Column:
    over = _over(w, t)
    if not weighted:
        return over(F.avg(x))
    # newest row weighs t, the one before t - 1, ...; divided by the weights present
    frame = over(F.collect_list(F.struct(x.cast("double").alias("x"))))
    parts = F.transform(frame, lambda s, i: F.struct((s["x"] * (i + t + 1 - F.size(frame))).alias("s"),
                                                     F.when(s["x"].isNotNull(), (i + t + 1 - F.size(frame))).alias("w")))
    add = lambda name: F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.coalesce(p[name].cast("double"), F.lit(0.0)))
    return F.try_divide(add("s"), F.nullif(add("w"), F.lit(0.0)))


def _number(name: str) -> Column:
    """A pandas result column with NaN read as NULL."""
    return F.when(~F.isnan(F.col(name)), F.col(name))


def _exponential_plain(o: Ordered, pairs: dict[str, str], a: float) -> DataFrame:
    """Keys without a hot one among them, streamed in order; the state is the last value per column."""
    added = [T.StructField(f"__y{i}", T.DoubleType()) for i in range(len(pairs))]

    def step(pdf: pd.DataFrame, state):
        last, done = state or [None] * len(pairs), {}
        for i, s in enumerate(pairs):
            x = pd.to_numeric(pdf[s]).to_numpy(dtype="float64")
            known = x[~np.isnan(x)]
            y = np.full(len(x), np.nan if last[i] is None else last[i])
            if len(known):
                seen = known if last[i] is None else np.concatenate([[last[i]], known])
                mean = pd.Series(seen).ewm(alpha=a, adjust=False).mean().to_numpy()[-len(known):]
                at = np.cumsum(~np.isnan(x)) - 1
                y = np.where(at >= 0, mean[np.maximum(at, 0)], y)
                last = [*last[:i], float(mean[-1]), *last[i + 1:]]
            done[f"__y{i}"] = y
        return done, last

    out = in_order(o, list(pairs), step, added)
    return out.withColumns({d: _number(f"__y{i}") for i, d in enumerate(pairs.values())}).drop(*[f"__y{i}" for i in range(len(pairs))], *o.helpers)


def exponential_mean(df: DataFrame, fields, order, by=None, t: int | None = None, alpha: float | None = None) -> DataFrame:
    """y = alpha * x + (1 - alpha) * previous y, started at the first value; NULL keeps the previous y.

    A block's result is linear in the value carried into it, so blocks are computed
    side by side and the carried values, one per block, are put in afterwards.
    """
    a = alpha if alpha is not None else 2.0 / (t + 1)
    pairs = renames(fields)
    o = Ordered(df, by, order)
    if not o.split:
        return _exponential_plain(o, pairs, a)
    data = o.blocks().drop(HOME)
    keys = [ident(k) for k in o.keys]
    helper = [f"__{h}{i}" for i in range(len(pairs)) for h in "yp"]
    added = [T.StructField(h, T.DoubleType()) for h in helper]
    schema = T.StructType([*data.schema.fields, *added])
    wanted = list(dict.fromkeys([RN, *pairs]))

    def fold(block: pa.Table) -> pa.Table:
        pdf, done = block.select(wanted).to_pandas().sort_values(RN), {}
        for i, s in enumerate(pairs):
            x = pd.to_numeric(pdf[s]).astype("float64")
            done[f"__y{i}"] = x.dropna().ewm(alpha=a, adjust=False).mean().reindex(pdf.index).ffill().sort_index()
            done[f"__p{i}"] = ((1 - a) ** x.notna().cumsum()).sort_index()
        return with_arrays(block, done, added)

    out = data.groupBy(*keys, BLK).applyInArrow(fold, schema)
    ends = out.groupBy(*keys, BLK).agg(*[F.max_by(h, RN).alias(h) for h in helper], *[
        F.min_by(ident(s).cast("double"), F.when(ident(s).isNotNull(), F.col(RN))).alias(f"__f{i}") for i, s in enumerate(pairs)])
    cols = [f"__c{i}" for i in range(len(pairs))]
    firsts = [f"__f{i}" for i in range(len(pairs))]
    passed = [T.StructField(c, T.DoubleType()) for c in cols]
    carried = T.StructType([*ends.schema.fields, *passed])

    def carry(ends_: pa.Table) -> pa.Table:  # one row per block of the key
        pdf, done = ends_.select([BLK, *helper, *firsts]).to_pandas().sort_values(BLK), {}
        for i, c in enumerate(cols):
            now, seen = float("nan"), []
            for y, p, first in zip(pdf[f"__y{i}"], pdf[f"__p{i}"], pdf[f"__f{i}"]):
                seen.append(now)
                if pd.notna(y):
                    now = y + p * (now - first) if pd.notna(now) else y
            done[c] = pd.Series(seen, pdf.index).sort_index()
        return with_arrays(ends_, done, passed)

    moved = ends.groupBy(*keys).applyInArrow(carry, carried).select(*keys, BLK, *cols, *firsts)
    out = join_keys(out, moved, [*o.keys, BLK], "left")
    done = {}
    for i, d in enumerate(pairs.values()):
        y, c = _number(f"__y{i}"), _number(f"__c{i}")
        done[d] = F.when(y.isNull(), c).when(c.isNull(), y).otherwise(y + F.col(f"__p{i}") * (c - F.col(f"__f{i}")))
    return out.withColumns(done).drop(*helper, *cols, *firsts, *o.helpers)


def moving_mean(df: DataFrame, fields, order, by=None, t: int = 2, kind: str = "simple", alpha: float | None = None,
                skip: int | None = None, strict: bool = False) -> DataFrame:
    """Moving average over t rows: ``simple``, ``weighted`` (linear) or ``exp``; the first ``skip`` (default t-1) rows drop."""
    pairs = renames(fields)
    skip = t - 1 if skip is None else skip
    if kind == "exp":
        out = exponential_mean(df, pairs, order, by, t, alpha)
        return out if not skip else number_rows(out, by, order).filter(F.col(RN) > skip).drop(RN)

    def make(w):
        return {d: strict_if(strict, ident(s), _moving_mean(ident(s), w, t, kind == "weighted"), _over(w, t)) for s, d in pairs.items()}

    return _frame_columns(df, by, order, t, make, skip)


def moving_stats(df: DataFrame, statistic: str, fields, order, by=None, t: int = 2, skip: int | None = None, strict: bool = False) -> DataFrame:
    """One of 15 statistics over a moving window of t rows."""
    if statistic not in MOVING_STATS:
        raise ValueError(f"no moving form of {statistic!r}; have {MOVING_STATS}")
    pairs = renames(fields)

    def make(w):
        over = _over(w, t)
        return {d: strict_if(strict, ident(s), stat(statistic, ident(s), over), over) for s, d in pairs.items()}

    return _frame_columns(df, by, order, t, make, t - 1 if skip is None else skip)


def _moving_pair(measure: str, x: Column, y: Column, over) -> Column:
    if measure not in MOVING_MEASURES:
        raise ValueError(f"no moving form of {measure!r}; have {MOVING_MEASURES}")
    return (frame_ranks if measure in RANK_MEASURES else pair)(measure, x, y, over)


def moving_similarity(df: DataFrame, measure: str, fields, name: str, order, by=None, t: int = 2, skip: int | None = None, strict: bool = False) -> DataFrame:
    """One of 14 pair measures over a moving window of t rows."""
    x, y = (ident(f) for f in as_list(fields))

    def make(w):
        over = _over(w, t)
        both = F.when(x.isNotNull() & y.isNotNull(), 1)
        return {name: strict_if(strict, both, _moving_pair(measure, x, y, over), over)}

    return _frame_columns(df, by, order, t, make, t - 1 if skip is None else skip)


def multi_moving_mean(df: DataFrame, specs, order, by=None, kind: str = "simple", alpha: float | None = None, strict: bool = False) -> DataFrame:
    """Many (columns, periods, pattern) in one pass; ``&`` is the column, ``#`` the period. Prefix windows are kept."""
    wanted = {}
    for fields, periods, pattern in specs:
        for f in expand(df, fields):
            for t in periods:
                wanted[pattern.replace("&", f).replace("#", str(t))] = (f, int(t))
    no_clash(df, wanted)
    if kind == "exp":
        for name, (f, t) in wanted.items():
            df = exponential_mean(df, {f: name}, order, by, t, alpha)
        return df

    def make(w):
        return {n: strict_if(strict, ident(f), _moving_mean(ident(f), w, t, kind == "weighted"), _over(w, t)) for n, (f, t) in wanted.items()}

    return _frame_columns(df, by, order, max(t for _, t in wanted.values()), make, 0)


def multi_moving_stats(df: DataFrame, specs, order, by=None, strict: bool = False) -> DataFrame:
    """Many (columns, statistics, periods, pattern) in one pass; ``&`` column, ``%`` statistic, ``#`` period."""
    wanted = {}
    for fields, names, periods, pattern in specs:
        for f in expand(df, fields):
            for c in as_list(names):
                for t in periods:
                    wanted[pattern.replace("&", f).replace("%", c).replace("#", str(t))] = (f, c, int(t))
    no_clash(df, wanted)

    def make(w):
        return {n: strict_if(strict, ident(f), stat(c, ident(f), _over(w, t)), _over(w, t)) for n, (f, c, t) in wanted.items()}

    return _frame_columns(df, by, order, max(t for *_, t in wanted.values()), make, 0)


def multi_moving_similarity(df: DataFrame, specs, order, by=None, pattern: str = "&_%_#", strict: bool = False) -> DataFrame:
    """Many (column, columns, measures, periods >= 2) in one pass; ``&`` is ``f1_f2``, ``%`` measure, ``#`` period."""
    wanted = {}
    for first, others, measures, periods in specs:
        for f in expand(df, others):
            for c in as_list(measures):
                for t in periods:
                    if int(t) < 2:
                        raise ValueError("periods must be 2 or more")
                    wanted[pattern.replace("&", f"{first}_{f}").replace("%", c).replace("#", str(t))] = (first, f, c, int(t))
    no_clash(df, wanted)

    def make(w):
        out = {}
        for n, (a, b, c, t) in wanted.items():
            both = F.when(ident(a).isNotNull() & ident(b).isNotNull(), 1)
            out[n] = strict_if(strict, both, _moving_pair(c, ident(a), ident(b), _over(w, t)), _over(w, t))
        return out

    return _frame_columns(df, by, order, max(t for *_, t in wanted.values()), make, 0)

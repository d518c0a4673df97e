"""Group aggregates: counts, sums, the 22 statistics, pair similarity, buckets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.similarity import MEASURES, RANK_MEASURES, pair, pearson
from millrace.functions.spec import as_list, expand, ident, renames
from millrace.functions.stats import QUANTILE_POINTS, stat, strict_if
from millrace.plans.ordered import ALL, RN, Ordered, hot_groups, join_keys, join_spread, number_rows, quantiles, setting, totals, with_row


def count(df: DataFrame, by, name: str = "count") -> DataFrame:
    return df.groupBy(*[ident(k) for k in as_list(by)]).agg(F.count(F.lit(1)).alias(name))


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides have one row per key."""
    return join_keys(left, right, keys, "left") if keys else with_row(left, right)


def _attach_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Group values to every row; hot keys are salted."""
    return join_spread(left, right, keys) if keys else with_row(left, right)


def describe(df: DataFrame, by, wants: dict[str, tuple[str, str]], strict: bool = False) -> DataFrame:
    """{output: (statistic, column)} per key in as few shuffles as the statistics allow.

    Everything with a partial form goes into one aggregation. Mode and the quantiles
    keep all values of a group, so when a hot key exists they are computed from value
    counts instead.
    """
    keys = as_list(by)
    cols = [ident(k) for k in keys]
    holistic = {n: w for n, w in wants.items() if w[0] == "mode" or w[0] in QUANTILE_POINTS}
    hot = hot_groups(df if keys else df.withColumn(ALL, F.lit(0)), keys or [ALL]) if holistic else None
    direct = wants if hot is None else {n: w for n, w in wants.items() if n not in holistic}
    aggs = [strict_if(strict, ident(c), stat(s, ident(c))).alias(n) for n, (s, c) in direct.items()]
    out = df.groupBy(*cols).agg(*aggs, F.count(F.lit(1)).alias("__rows"))
    if hot is None:
        return out.drop("__rows")
    points = {f"{n}__{p}": (c, p) for n, (s, c) in holistic.items() for p in QUANTILE_POINTS.get(s, ())}
    if points:
        out = _attach(out, quantiles(df, keys, points), keys)
    guards = {n: F.count(ident(c)).alias(f"__g_{n}") for n, (s, c) in holistic.items()}
    out = _attach(out, df.groupBy(*cols).agg(*guards.values()), keys)
    for n, (s, c) in holistic.items():
        if s == "mode":
            n_of = df.filter(ident(c).isNotNull()).groupBy(*cols, ident(c).alias("__x")).agg((-F.count(F.lit(1))).alias("__w"))
            out = _attach(out, n_of.groupBy(*cols).agg(F.min(F.struct("__w", "__x"))["__x"].alias(n)), keys)
        else:
            at = [ident(f"{n}__{p}") for p in QUANTILE_POINTS[s]]
            out = out.withColumn(n, at[0] if len(at) == 1 else at[1] - at[0])
        if strict:
            out = out.withColumn(n, F.when(F.col(f"__g_{n}") == F.col("__rows"), ident(n)))
    return out.select(*cols, *[ident(n) for n in wants])


def stats(df: DataFrame, statistic: str, fields, by=None, strict: bool = False) -> DataFrame:
    """One statistic over several columns; ``fields`` may rename (``a:b``)."""
    return describe(df, by, {dst: (statistic, src) for src, dst in renames(fields).items()}, strict)


def sum_columns(df: DataFrame, fields, by=None, strict: bool = False) -> DataFrame:
    return stats(df, "sum", fields, by, strict)


def mean_columns(df: DataFrame, fields, by=None, strict: bool = False) -> DataFrame:
    return stats(df, "mean", fields, by, strict)


def summary(df: DataFrame, statistics, fields, by=None, name: str = "field", strict: bool = False) -> DataFrame:
    """Several statistics in long form: one row per (group, column)."""
    keys, stat_names = as_list(by), renames(statistics)
    fields = expand(df, fields)
    wants = {f"{f}|{s}": (s, f) for f in fields for s in stat_names}
    wide = describe(df, by, wants, strict)
    cells = [F.struct(F.lit(f).alias(name), *[ident(f"{f}|{s}").cast("double").alias(dst) for s, dst in stat_names.items()]) for f in fields]
    return wide.select(*[ident(k) for k in keys], F.explode(F.array(*cells)).alias("__s")).select(*[ident(k) for k in keys], "__s.*")


def average_rank(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Rank with ties averaged, from counts per value; the column must not be NULL."""
    values = df.groupBy(*[ident(k) for k in keys], ident(column)).agg(F.count(F.lit(1)).alias("__w"))
    ranked = Ordered(values, keys, [column]).running(__cum=("sum", F.col("__w"))).result()
    ranked = ranked.select(*[ident(k) for k in keys], ident(column), (F.col("__cum") - (F.col("__w") - 1) / 2).alias(out))
    return join_spread(df, ranked, [*keys, column])


def _spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str) -> DataFrame:
    data = df.filter(ident(x).isNotNull() & ident(y).isNotNull()).select(
        *[ident(k) for k in keys], ident(x).cast("double").alias("__x"), ident(y).cast("double").alias("__y"))
    data = average_rank(average_rank(data, keys, "__x", "__u"), keys, "__y", "__v")
    return data.groupBy(*[ident(k) for k in keys]).agg(pearson(F.col("__u"), F.col("__v")).alias(name))


def _inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], by divide and merge."""
    n = len(values)
    if n <= 64:
        return int(np.triu(values[:, None] > values[None, :]).sum())
    half = n // 2
    left, right = values[:half], values[half:]
    across = half * (n - half) - int(np.searchsorted(np.sort(left), right, side="right").sum())
    return _inversions(left) + _inversions(right) + across


def _kendall(df: DataFrame, keys: list[str], x: str, y: str, name: str) -> DataFrame:
    """Tau-b from inversion counts: inside blocks in numpy, across blocks by merge levels."""
    block = 1 << max(setting(df.sparkSession, "blockRows", 2_000_000).bit_length() - 1, 1)
    data = df.filter(ident(x).isNotNull() & ident(y).isNotNull()).select(
        *[ident(k) for k in keys], ident(x).cast("double").alias("__x"), ident(y).cast("double").alias("__y"))
    if not keys:
        data, keys = data.withColumn(ALL, F.lit(0)), [ALL]
    by = [ident(k) for k in keys]
    n = data.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))

    def tied(*cols: str, out: str) -> DataFrame:
        same = data.groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("__c"))
        return same.groupBy(*by).agg(F.sum(F.col("__c") * (F.col("__c") - 1) / 2).alias(out))

    pos = number_rows(data, keys, ["__x", "__y"]).withColumn("__r", F.col(RN) - 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*by).schema.fields)

    def count_block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("__r")["__y"].to_numpy()
        return pd.DataFrame([[*key[:-1], float(_inversions(ordered))]], columns=[*keys, "__q"])

    blocks = pos.withColumn("__b", F.floor(F.col("__r") / block)).select(*by, "__b", "__r", "__y")
    parts = blocks.groupBy(*by, "__b").applyInPandas(count_block, schema + ", __q double")
    longest = pos.agg(F.max("__r")).first()[0] if hot_groups(data, keys) is not None else 0
    levels = [2 * block << i for i in range(64) if block << i <= (longest or 0)]
    if levels:  # every level merges neighbouring halves: left rows above a right row's value
        wide = pos.withColumn("__size", F.explode(F.array(*[F.lit(s).cast("long") for s in levels])))
        wide = wide.withColumn("__g", F.floor(F.col("__r") / F.col("__size")))
        wide = wide.withColumn("__right", (F.pmod(F.col("__r"), F.col("__size")) >= F.col("__size") / 2).cast("int"))
        merge = Ordered(wide.select(*by, "__size", "__g", "__y", "__right"), [*keys, "__size", "__g"], ["__y", "__right"])
        merge.running(__seen=("sum", 1 - F.col("__right")))
        parts = parts.unionByName(merge.result().groupBy(*by).agg(
            F.sum(F.when(F.col("__right") == 1, F.lit(0) - F.col("__seen")).otherwise(0)).cast("double").alias("__q")))
        halves = wide.groupBy(*by, "__size", "__g").agg(F.sum("__right").alias("__m"), F.count(F.lit(1)).alias("__k"))
        parts = parts.unionByName(halves.groupBy(*by).agg(
            F.sum(F.col("__m") * (F.col("__k") - F.col("__m"))).cast("double").alias("__q")))
    out = n
    for piece in (parts.groupBy(*by).agg(F.sum("__q").alias("__q")), tied("__x", out="__n1"),
                  tied("__y", out="__n2"), tied("__x", "__y", out="__n3")):
        out = join_keys(out, piece, keys, "left")
    n0 = F.col("__n") * (F.col("__n") - 1) / 2
    score = n0 - F.col("__n1") - F.col("__n2") + F.col("__n3") - 2 * F.col("__q")
    tau = F.try_divide(score, F.sqrt(n0 - F.col("__n1")) * F.sqrt(n0 - F.col("__n2")))
    return out.select(*by, tau.alias(name)).drop(ALL)


def similarity(df: DataFrame, measures, fields, by=None, names=("field1", "field2"), strict: bool = False, diagonal: bool = False) -> DataFrame:
    """Measures between all pairs of columns: one row per (group, pair).

    All moment and table measures of all pairs share one aggregation. ``diagonal``
    also returns each column with itself and the reversed pairs.
    """
    keys, wanted = as_list(by), renames(measures)
    unknown = set(wanted) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown measures {sorted(unknown)}")
    cols = expand(df, fields)
    if diagonal:
        pairs = [(a, b) for a in cols for b in cols]
    else:
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    key_cols = [ident(k) for k in keys]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for a, b in pairs:
        both = ident(a).isNotNull() & ident(b).isNotNull()
        aggs.append(F.count(F.when(both, 1)).alias(f"{a}|{b}|n"))
        aggs += [pair(m, ident(a), ident(b)).alias(f"{a}|{b}|{m}") for m in wanted if m not in RANK_MEASURES]
    wide = df.groupBy(*key_cols).agg(*aggs)
    for m in (m for m in wanted if m in RANK_MEASURES):
        for a, b in pairs:
            part = (_spearman if m == "spearman" else _kendall)(df, keys, a, b, f"{a}|{b}|{m}")
            wide = _attach(wide, part, keys)

    def cell(a: str, b: str, m: str) -> Column:
        value = ident(f"{a}|{b}|{m}")
        return F.when(ident(f"{a}|{b}|n") == F.col("__rows"), value) if strict else value

    cells = [F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), *[cell(a, b, m).alias(dst) for m, dst in wanted.items()]) for a, b in pairs]
    return wide.select(*key_cols, F.explode(F.array(*cells)).alias("__s")).select(*key_cols, "__s.*")


def _label(number: Column, cuts: list[Column], n: int, style: str, reverse: bool) -> Column:
    """Bucket number, ``low_high`` range with open outer ends, or ``number:range``."""
    shown = (n + 1 - number) if reverse else number
    if style == "number":
        return shown
    text = F.lit(None).cast("string")
    for i in range(n, 0, -1):
        low = cuts[i - 2].cast("string") if i > 1 else F.lit("")
        high = cuts[i - 1].cast("string") if i < n else F.lit("")
        text = F.when(number == i, F.concat(low, F.lit("_"), high)).otherwise(text)
    return text if style == "range" else F.concat(shown.cast("string"), F.lit(":"), text)


def bucket(df: DataFrame, fields, n: int, by=None, equal_width: bool = False, style: str = "number", reverse: bool = False) -> DataFrame:
    """Number each value by equal frequency (default) or equal width inside its group.

    Equal frequency cuts at the exact i/n quantiles: equal values share a bucket.
    """
    keys, pairs = as_list(by), renames(fields)
    if equal_width:
        aggs = {}
        for src in pairs:
            aggs[f"__lo_{src}"], aggs[f"__hi_{src}"] = F.min(ident(src)), F.max(ident(src))
        out = totals(df, keys, aggs)
    else:
        points = {f"__q_{src}_{i}": (src, i / n) for src in pairs for i in range(1, n)}
        out = _attach_rows(df, quantiles(df, keys, points), keys)
    done = {}
    for src, dst in pairs.items():
        x = ident(src).cast("double")
        if equal_width:
            lo, hi = ident(f"__lo_{src}"), ident(f"__hi_{src}")
            width = (hi - lo) / F.lit(float(n))
            number = F.when(x.isNotNull(), F.least(F.coalesce(F.floor(F.try_divide(x - lo, width)), F.lit(0)) + 1, F.lit(n)))
            cuts = [lo + width * i for i in range(1, n)]
        else:
            cuts = [ident(f"__q_{src}_{i}") for i in range(1, n)]
            number = F.when(x.isNotNull(), reduce(lambda a, c: a + (x >= c).cast("long"), cuts, F.lit(1).cast("long")))
        done[dst] = _label(number, cuts, n, style, reverse)
    helper = [c for c in out.columns if c not in df.columns]
    return out.withColumns(done).drop(*helper)


def bucket_grid(df: DataFrame, fields, n: int, by=None, style: str = "number", reverse: bool = False, try_orders: bool = False) -> DataFrame:
    """Equal-frequency buckets in several dimensions: the second is cut inside the first, and so on.

    ``try_orders`` cuts in each rotation of the columns and keeps the one whose cells
    are most even (least variance of the cell counts).
    """
    keys, pairs = as_list(by), renames(fields)
    names = list(pairs)

    def cut(order: list[str]) -> DataFrame:
        out, inner = df, list(keys)
        for src in order:
            helper = f"__g_{src}"
            out = bucket(out, {src: helper}, n, inner)
            if style != "number" or reverse:
                out = bucket(out, {src: pairs[src]}, n, inner, style=style, reverse=reverse)
            else:
                out = out.withColumn(pairs[src], F.col(helper))
            inner.append(helper)
        return out

    orders = [names[i:] + names[:i] for i in range(len(names))] if try_orders else [names]

    def spread(order: list[str]) -> float:
        cells = cut(order).groupBy(*[ident(k) for k in keys], *[f"__g_{s}" for s in names]).agg(F.count(F.lit(1)).alias("__c"))
        return cells.agg(F.var_pop("__c")).first()[0] or 0.0

    best = min(orders, key=spread) if len(orders) > 1 else orders[0]
    return cut(best).select(*[ident(c) for c in df.columns], *[ident(d) for d in pairs.values()])

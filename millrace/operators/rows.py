"""Row filters with two outputs, sampling, duplicates, row multiplication, checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spec import as_list, expand, fold, ident, inside, intervals, order_keys
from millrace.operators.columns import _uniform
from millrace.plans.ordered import RN, Ordered, join_keys, number_rows, totals, with_row

Pair = tuple[DataFrame, DataFrame]


def split(df: DataFrame, cond: Column) -> Pair:
    """(match, rest): one shared predicate, NULL goes to the rest."""
    hit = F.coalesce(cond, F.lit(False))
    return df.filter(hit), df.filter(~hit)


def _split_fields(df: DataFrame, tests: list[Column], by, every: bool, invert: bool, group: bool, group_all: bool | None = None) -> Pair:
    """Fold the per-column tests; with ``group`` a key is kept or dropped as a whole."""
    hit = fold(tests, every)
    if group:
        keys = as_list(by)
        whole = every if group_all is None else group_all
        flag = (F.min if whole else F.max)(hit.cast("int"))
        marked = totals(df, keys, {"__hit": flag})
        cond = F.col("__hit") == 1
        a, b = split(marked, ~cond if invert else cond)
        return a.drop("__hit"), b.drop("__hit")
    return split(df, ~hit if invert else hit)


def select_text(df: DataFrame, fields, values, by=None, every: bool = False, invert: bool = False, group: bool = False,
                match: str = "equal") -> Pair:
    """Rows whose columns hold one of the values: equal, ``sub``, ``head`` or ``tail`` match."""
    values = as_list(values)

    def test(c: Column) -> Column:
        if match == "equal":
            return c.isin(*values)
        how = {"sub": c.contains, "head": c.startswith, "tail": c.endswith}[match]
        return fold([how(v) for v in values], every=False)

    return _split_fields(df, [test(ident(f).cast("string")) for f in expand(df, fields)], by, every, invert, group)


def select_number(df: DataFrame, fields, ranges, by=None, every: bool = False, invert: bool = False, group: bool = False) -> Pair:
    """Rows whose columns fall into one of the intervals, e.g. ``"[10,40)"``."""
    wanted = intervals(ranges)
    tests = [fold([inside(ident(f), r) for r in wanted], every=False) for f in expand(df, fields)]
    return _split_fields(df, tests, by, every, invert, group)


def select_if(df: DataFrame, cond: Column | str) -> Pair:
    return split(df, F.expr(cond) if isinstance(cond, str) else cond)


def drop_null(df: DataFrame, fields, by=None, every: bool = False, invert: bool = False, group: bool = False) -> Pair:
    """(kept, dropped): rows with a NULL in any column, or in all columns with ``every``."""
    tests = [ident(f).isNull() for f in expand(df, fields)]
    dropped, kept = _split_fields(df, tests, by, every, invert, group)
    return kept, dropped


def sample(df: DataFrame, by=None, n: int | None = None, percent: float | None = None, seed: int = 0, whole_groups: bool = False) -> Pair:
    """(sample, rest) without replacement: n rows or a share of each key, or of the keys.

    The order is a hash of the row and the seed, so both outputs agree and a lost task
    draws the same rows again.
    """
    keys = as_list(by)
    if (n is None) == (percent is None):
        raise ValueError("give either n or percent")
    if whole_groups:
        groups = df.select(*[ident(k) for k in keys]).distinct()
        chosen, _ = sample(groups, None, n, percent, seed)
        return join_keys(df, chosen, keys, "left_semi"), join_keys(df, chosen, keys, "left_anti")
    data = df.withColumn("__u", _uniform(seed, [ident(c) for c in df.columns]))
    data = number_rows(data, keys, ["__u"])
    if percent is not None:
        data = totals(data, keys, {"__m": F.count(F.lit(1))})
        keep = F.col(RN) <= F.ceil(F.col("__m") * (percent / 100.0))
    else:
        keep = F.col(RN) <= n
    return tuple(part.drop("__u", RN, "__m") for part in split(data, keep))


def unique(df: DataFrame, by, order=None) -> DataFrame:
    """One row per key: any (partial ``first``), or the first in ``order``."""
    keys = as_list(by)
    if order is None:
        return df.dropDuplicates(keys)
    # a one-field struct keeps NULL as the smallest value; descending needs the maximum
    ks = order_keys(order)
    if len({k.desc for k in ks}) > 1:
        return number_rows(df, by, order).filter(F.col(RN) == 1).drop(RN)
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if ks[0].desc else F.min_by)(F.struct(*[ident(c) for c in rest]), F.struct(*[k.value().alias(f"o{i}") for i, k in enumerate(ks)]))
    return df.groupBy(*[ident(k) for k in keys]).agg(pick.alias("__s")).select(*[
        ident(c) if c in keys else F.col("__s")[c].alias(c) for c in df.columns])


STEP = 100_000  # longest array one generated step may hold


def counted(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """One row per whole number in [low, high]; two short generators instead of one long array."""
    out = df.withColumn("__lo", low.cast("long")).withColumn("__hi", high.cast("long")).filter(F.col("__lo") <= F.col("__hi"))
    out = out.withColumn("__at", F.explode(F.sequence("__lo", "__hi", F.lit(STEP).cast("long"))))
    last = F.least(F.col("__at") + (STEP - 1), F.col("__hi"))
    return out.withColumn(name, F.explode(F.sequence(F.col("__at"), last, F.lit(1).cast("long")))).drop("__lo", "__hi", "__at")


def duplicate(df: DataFrame, times: int | str) -> DataFrame:
    """Each row ``times`` times (a number or a column); none for NULL or below one."""
    n = ident(times) if isinstance(times, str) else F.lit(times)
    return counted(df, F.lit(1), n, "__i").drop("__i")


# ticks of a padded column: value -> whole number -> value
_TICKS = {
    "n": (lambda c: c.cast("long"), lambda c, t: c.cast(t)),
    "d": (F.unix_date, lambda c, t: F.date_from_unix_date(c.cast("int")).cast(t)),
    "t": (lambda c: F.unix_seconds(c.cast("timestamp")), lambda c, t: F.timestamp_seconds(c).cast(t)),
}


def padding(df: DataFrame, field: str, by=None, start=None, end=None, value=None, null: bool = False) -> DataFrame:
    """Insert the missing steps of ``field`` (``%n`` number, ``%d`` day, ``%t`` second, ``r`` descending).

    Other columns repeat the previous row, or hold ``value`` or NULL. Each row expands
    to itself and the gap that follows, so no join is needed.
    """
    name, _, flags = field.partition("%")
    kind, desc, keys = (flags.replace("r", "") or "n"), "r" in flags, as_list(by)
    to_tick, from_tick = _TICKS[kind]
    dtype = df.schema[name].dataType
    sign = -1 if desc else 1
    o = Ordered(df.withColumn("__t", to_tick(ident(name)) * sign), keys, ["__t"])
    o.frame(1, 1, lambda w: {"__next": F.lead("__t").over(w), "__first": F.lag(F.lit(1)).over(w).isNull()})
    tick = F.col("__t")
    literal = lambda v: to_tick(F.lit(v).cast(dtype)) * sign
    low = tick if start is None else F.when(F.col("__first"), F.least(tick, literal(start))).otherwise(tick)
    after = tick if end is None else F.greatest(tick, literal(end))
    high = F.when(F.col("__next").isNull(), after).otherwise(F.greatest(tick, F.col("__next") - 1))
    out = counted(o.result(), low, high, "__v")
    own = F.col("__v") == tick
    cols = []
    for c in df.columns:
        if c == name:
            cols.append(F.when(own, ident(c)).otherwise(from_tick(F.col("__v") * sign, dtype)).alias(c))
        elif c in keys or (value is None and not null):
            cols.append(ident(c))
        else:
            other = F.lit(None if null else value).cast(df.schema[c].dataType)
            cols.append(F.when(own, ident(c)).otherwise(other).alias(c))
    return out.select(*cols)


def row_range(df: DataFrame, order, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset+limit of the given order.

    Cut by exact row numbers, which no single task has to sort; ties go by a row hash.
    """
    return number_rows(df, None, order).filter((F.col(RN) > offset) & (F.col(RN) <= offset + limit)).drop(RN)


def row_random(df: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``limit`` rows as a top-k of random numbers; nothing is sorted in full."""
    return df.withColumn("__u", F.rand(seed)).orderBy("__u").limit(limit).drop("__u")


def head_rows(df: DataFrame, order, n: int) -> Pair:
    """(first n rows, the others) of the given order."""
    return tuple(part.drop(RN) for part in split(number_rows(df, None, order), F.col(RN) <= n))


def best(df: DataFrame, order, by=None, start: int = 0, stop: int | None = None, size: int | None = None, ranges=None, invert: bool = False) -> Pair:
    """Rows by 0-based position in the sorted group: from/to/size, or ``"0,3_5"``."""
    keys = as_list(by)
    if ranges is not None:
        parts = [tuple(r.split("_")) for r in as_list(ranges)]
        spans = [(int(p[0]) if p[0] != "MIN" else 0, None if p[-1] == "MAX" else int(p[-1])) for p in parts]
    else:
        spans = [(start, stop if stop is not None else start + (size or 1) - 1)]
    pos = F.col(RN) - 1
    hit = fold([(pos >= lo) if hi is None else pos.between(lo, hi) for lo, hi in spans], every=False)
    match, rest = (part.drop(RN) for part in split(number_rows(df, keys, order), ~hit if invert else hit))
    return match, rest


def top(df: DataFrame, order, by, n: int) -> DataFrame:
    """First n rows per key. The limit is applied inside each map task before the shuffle,
    so a hot key sends at most n rows per task."""
    from pyspark.sql import Window

    w = Window.partitionBy(*[ident(k) for k in as_list(by)]).orderBy(*[k.sort() for k in order_keys(order)])
    return df.withColumn(RN, F.row_number().over(w)).filter(F.col(RN) <= n).drop(RN)


def duplicate_rows(df: DataFrame, by, order) -> DataFrame:
    """Rows whose key occurs at least twice: line number, total and running number in the key."""
    keys = as_list(by)
    out = number_rows(df, None, order, "line")
    out = totals(out, keys, {"total": F.count(F.lit(1))}).filter(F.col("total") > 1)
    return number_rows(out, keys, ["line"], "number")


def row_text(df: DataFrame) -> Column:
    return F.concat_ws(",", *[F.coalesce(ident(c).cast("string"), F.lit("")) for c in df.columns])


def diff(left: DataFrame, right: DataFrame, order, limit: int | None = None) -> DataFrame:
    """Compare two tables line by line in the given order: differing lines with their number.

    With a limit at most limit + 1 rows come back and ``exceeded`` tells that there were more.
    """
    a = number_rows(left.select("*", row_text(left).alias("left_row")), None, order).select(RN, "left_row")
    b = number_rows(right.select("*", row_text(right).alias("right_row")), None, order).select(RN, "right_row")
    out = a.join(b, RN, "full").filter(~F.col("left_row").eqNullSafe(F.col("right_row")))
    out = out.select(F.lit(False).alias("equal"), F.col(RN).alias("row_number"), "left_row", "right_row")
    if limit is None:
        return out.withColumn("exceeded", F.lit(False))
    out = out.orderBy("row_number").limit(limit + 1)
    return with_row(out, out.agg((F.count(F.lit(1)) > limit).alias("exceeded")))


def diff_bag(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that only one side has."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def diff_keyed(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Compare by unique key: columns of both sides for rows that differ or lack a partner."""
    keys = as_list(by)
    others = [c for c in left.columns if c not in keys]
    a = left.select(*[ident(k) for k in keys], F.struct(*[ident(c) for c in others]).alias("__a"))
    b = right.select(*[ident(k) for k in keys], F.struct(*[ident(c) for c in others]).alias("__b"))
    out = a.join(b, keys, "full").filter(~F.col("__a").eqNullSafe(F.col("__b")))
    return out.select(*[ident(k) for k in keys], *[F.col("__a")[c].alias(f"left_{c}") for c in others],
                      *[F.col("__b")[c].alias(f"right_{c}") for c in others])


def quality(df: DataFrame, name: str, key=(), fields=()) -> DataFrame:
    """Attach row and NULL counts as an observation; read them with ``pyspark.sql.Observation``."""
    from pyspark.sql import Observation

    checks = [F.count(F.lit(1)).alias("rows")]
    checks += [F.count_if(ident(c).isNull()).alias(f"null_{c}") for c in [*as_list(key), *as_list(fields)]]
    return df.observe(name if isinstance(name, Observation) else Observation(name), *checks)


def quality_report(before: DataFrame, after: DataFrame, key, fields_in, fields_out) -> DataFrame:
    """Row-count change and NULL counts in key, input and output columns, as one row."""
    nulls = lambda cols, tag: [F.count_if(ident(c).isNull()).alias(f"{tag}_{c}") for c in as_list(cols)]
    a = before.agg(F.count(F.lit(1)).alias("rows_in"), *nulls(key, "nullkey"), *nulls(fields_in, "nullin"))
    b = after.agg(F.count(F.lit(1)).alias("rows_out"), *nulls(fields_out, "nullout"))
    return with_row(a, b).withColumn("diff_size", F.col("rows_out") - F.col("rows_in"))


def bit_flags(df: DataFrame, field: str, names, same_length: bool = False) -> DataFrame:
    """Hex text to one 0/1 column per bit, first bit first; a bad digit or a missing bit gives NULL."""
    names = as_list(names)
    digits = F.filter(F.split(ident(field), ""), lambda d: d != "")
    bit = F.transform(digits, lambda d: F.when(d.rlike("^[0-9A-Fa-f]$"), F.lpad(F.conv(d, 16, 2), 4, "0")).otherwise("    "))
    bits = F.array_join(bit, "")
    if same_length:
        bits = F.when(F.length(bits) == math.ceil(len(names) / 4) * 4, bits)
    return df.withColumns({n: F.substring(bits, i + 1, 1).try_cast("int") for i, n in enumerate(names)})

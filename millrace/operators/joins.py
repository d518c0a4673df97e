"""Equi, step (as-of), interval, row-number joins, products and concatenation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spec import as_list, ident, no_clash, renames
from millrace.plans.ordered import ALL, BLOCK_ROWS, HOT_GROUPS, RESULT_TASKS, RN, Ordered, hot_groups, join_keys, number_rows, result_tasks, spread
from millrace.session import cut_lineage, setting


def _reference(ref: DataFrame, by: list[str], ref_by, fields) -> tuple[DataFrame, list[str]]:
    """The reference side with its keys named like the left keys and its picked columns."""
    rkeys = as_list(ref_by) or by
    if len(rkeys) != len(by):
        raise ValueError("key lists differ in length")
    pairs = renames(fields) if fields is not None else {c: c for c in ref.columns if c not in rkeys}
    out = ref.select(*[ident(r).alias(f"__k{i}") for i, r in enumerate(rkeys)], *[ident(s).alias(d) for s, d in pairs.items()])
    return out, list(pairs.values())


def _on(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [ident(k) == F.col(f"__k{i}") for i, k in enumerate(by)])


def _filled(out: DataFrame, columns: list[str], by: list[str], picked: list[str]) -> DataFrame:
    """Anti-joined reference rows in the shape of the join result: keys kept, the left's other columns NULL."""
    return out.select(
        *[F.col(f"__k{by.index(c)}").alias(c) if c in by else F.lit(None).alias(c) for c in columns],
        *[ident(p) for p in picked])


PAIRS = 1 << 22  # result rows that one join key may give


def _dealt(df: DataFrame, side: DataFrame, by: list[str], names: list[str], left: bool) -> tuple[DataFrame, DataFrame] | None:
    """Both sides of a join with repeated keys, with __salt and __part to meet on; None if keys with many pairs give few results.

    A key whose pairs are more than ``PAIRS`` is a grid of cells: its rows on either side are dealt by a hash, and copied
    once per deal of the other side. Where rows without a partner stay, only the left side is dealt, so that each of its
    rows meets all its partners in one place.
    """
    spark, whole = df.sparkSession, PAIRS
    n = df.groupBy(*[ident(k).alias(c) for k, c in zip(by, names)]).agg(F.count(F.lit(1)).alias("__n"))
    pairs = n.join(side.groupBy(*names).agg(F.count(F.lit(1)).alias("__m")), names).withColumn("__p", F.col("__n") * F.col("__m").cast("decimal(20,0)"))
    rows = pairs.filter(F.col("__p") > whole // 16).orderBy(F.desc("__p")).limit(HOT_GROUPS).collect()
    results = int(sum(r["__p"] for r in rows))
    if results <= whole:
        return None
    whole = max(whole, results // (4 * RESULT_TASKS))  # a quarter of a task's share: smaller cells are more copies and no more tasks
    edge = math.isqrt(whole)
    limit = setting(spark, "blockRows", BLOCK_ROWS)

    def deals(n: int, m: int) -> tuple[int, int]:
        if left:
            return max(min(n, -(-n * m // whole)), -(-n // limit)), 1
        return max(1, -(-n * min(m, edge) // whole)), max(1, -(-m * min(n, edge) // whole))

    grid = spark.createDataFrame([(*r[:len(names)], *deals(r["__n"], r["__m"])) for r in rows], T.StructType([
        *[T.StructField(c, pairs.schema[c].dataType) for c in names], T.StructField("__lefts", T.IntegerType()), T.StructField("__rights", T.IntegerType())]))
    alone = hot_groups(df, by)  # keys with many rows but few pairs or none
    if alone is not None:
        alone = alone.select(*[ident(k).alias(c) for k, c in zip(by, names)], F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__lefts"), F.lit(1).alias("__rights"))
        grid = grid.unionByName(join_keys(alone, grid, names, "left_anti"))

    def sides(rows: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
        values = [ident(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
        draw = F.pmod(F.xxhash64(*values, F.spark_partition_id()), F.coalesce(own, F.lit(1))).cast("int")
        named = grid.withColumnsRenamed(dict(zip(names, keys)))
        out = join_keys(rows, named, keys, "left", hint=True).withColumn("__own", draw)
        return out.withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    cells = lambda a, b: F.col(a).cast("long") * F.coalesce("__rights", F.lit(1)) + F.col(b)
    tasks = result_tasks(spark, results, PAIRS)
    out = sides(df, by, "__lefts", "__rights").withColumn("__salt", cells("__own", "__other")).drop("__lefts", "__rights", "__own", "__other")
    spread_out = side.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # the smaller table may be one split, and its copies are many
    copies = sides(spread_out, names, "__rights", "__lefts").withColumn("__part", cells("__other", "__own")).drop("__lefts", "__rights", "__own", "__other")
    return out.repartition(tasks, *[ident(k) for k in by], "__salt"), copies.repartition(tasks, *names, "__part")


def join(df: DataFrame, ref: DataFrame, by, ref_by=None, fields=None, left: bool = False, right: bool = False, unique: bool = True) -> DataFrame:
    """Equi-join; ``left``/``right`` also keep rows without a partner.

    With ``unique`` the reference must hold a key once; a repeated key raises at run
    time. That check aggregates by the join key, so the join reuses its shuffle. A full
    join is a left join plus an anti-join, which leaves skewed partitions splittable.
    """
    by = as_list(by)
    side, picked = _reference(ref, by, ref_by, fields)
    no_clash(df, picked)
    keys = [F.col(f"__k{i}") for i in range(len(by))]
    if unique:
        one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("reference key is not unique"))).otherwise(F.lit(True))
        grouped = side.groupBy(*keys).agg(F.first(F.struct(F.lit(1).alias("__one"), *[ident(p) for p in picked])).alias("__s"), one.alias("__ok"))
        side = grouped.filter("__ok").select(*keys, *[F.col("__s")[p].alias(p) for p in picked])
    names = [f"__k{i}" for i in range(len(by))]
    dealt = None if unique or df.isStreaming else _dealt(df, side, by, names, left)
    if dealt:
        salted, copies = dealt
        cond = _on(by) & (salted["__salt"] == copies["__part"])
    else:
        salted, copies, salt = spread(df, side, by, names)
        cond = _on(by) if salt is None else _on(by) & (salted[salt] == copies[salt])
    out = salted.join(copies, cond, "left" if left else "inner").select(*[ident(c) for c in df.columns], *[ident(p) for p in picked])
    if right:
        lone = side.join(df.select(*[ident(k) for k in by]).distinct(), _on(by), "left_anti")
        out = out.unionByName(_filled(lone, df.columns, by, picked))
    return out


def natural_join(df: DataFrame, ref: DataFrame, by, ref_by=None, fields=None, left: bool = False, right: bool = False) -> DataFrame:
    """Equi-join with repeated keys allowed on both sides."""
    return join(df, ref, by, ref_by, fields, left, right, unique=False)


def common(df: DataFrame, ref: DataFrame, by, ref_by=None, invert: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows whose key exists in ref, the other rows)."""
    by = as_list(by)
    side, _ = _reference(ref, by, ref_by, {})
    names = [f"__k{i}" for i in range(len(by))]
    salted, copies, salt = spread(df, side.distinct(), by, names)
    cond = _on(by) if salt is None else _on(by) & (salted[salt] == copies[salt])
    hit = tuple(salted.join(copies, cond, how).select(*[ident(c) for c in df.columns]) for how in ("left_semi", "left_anti"))
    return hit[::-1] if invert else hit


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all inputs, columns matched by name; a missing column is an error."""
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b), frames)


def paste(df: DataFrame, ref: DataFrame, order, ref_order, fields=None, left: bool = False, right: bool = False) -> DataFrame:
    """Join by row number in the given orders. Row numbers are unique, so no key is hot."""
    pairs = renames(fields) if fields is not None else {c: c for c in ref.columns}
    no_clash(df, pairs.values())
    a = number_rows(df, None, order)
    b = number_rows(ref, None, ref_order).select(RN, *[ident(s).alias(d) for s, d in pairs.items()])
    how = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}[left, right]
    return a.join(b, RN, how).drop(RN)


def product(df: DataFrame, ref: DataFrame, fields=None) -> DataFrame:
    """Every row of df with every row of ref.

    Both sides are cut into tiles by a row hash, and every pair of tiles is a key of its
    own: a row is copied once per tile of the other side, and the pairs spread over all
    tasks however unequal the sides are.
    """
    pairs = renames(fields) if fields is not None else {c: c for c in ref.columns}
    no_clash(df, pairs.values())
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = math.isqrt(16 * partitions) + 1

    def tiled(rows: DataFrame, own: str, other: str) -> DataFrame:
        values = [ident(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
        tile = F.pmod(F.xxhash64(*values, F.spark_partition_id()), F.lit(tiles))
        return rows.withColumn(own, tile).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))

    left = tiled(df, "__l", "__r")
    side = tiled(ref.select(*[ident(s).alias(d) for s, d in pairs.items()]), "__r", "__l")
    return left.join(side, ["__l", "__r"]).drop("__l", "__r")


def _keyed(df: DataFrame, ref: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, by
    return df.withColumn(ALL, F.lit(0)), [ALL]


def step_join(df: DataFrame, ref: DataFrame, value: str, ref_value: str, fields=None, by=None, ref_by=None,
              left: bool = False, lower_open: bool = False) -> DataFrame:
    """As-of join: each reference row starts a range that lasts until the next start.

    A value belongs to [R_j, R_j+1), or to (R_j, R_j+1] with ``lower_open``. Both sides
    are merged into one ordered run and each row takes the latest reference row seen:
    one shuffle and no pairs, however long the ranges are.
    """
    by = as_list(by)
    side, picked = _reference(ref, by, ref_by, fields)
    rkeys = as_list(ref_by) or by
    no_clash(df, picked)
    pairs = renames(fields) if fields is not None else {c: c for c in ref.columns if c not in rkeys}
    side = ref.filter(ident(ref_value).isNotNull()).select(
        *[ident(r).alias(k) for r, k in zip(rkeys, by)], ident(ref_value).alias("__v"), F.lit(1 if lower_open else 0).alias("__kind"),
        F.struct(F.lit(True).alias("__one"), *[ident(s).alias(d) for s, d in pairs.items()]).alias("__ref"))
    own = df.select(*[ident(k) for k in by], ident(value).alias("__v"), F.lit(0 if lower_open else 1).alias("__kind"),
                    F.struct(*[ident(c) for c in df.columns]).alias("__row"))
    both = own.unionByName(side, allowMissingColumns=True)
    o = Ordered(both, by, ["__v", "__kind"]).running(__hit=("last", F.col("__ref")))
    out = o.result().filter(F.col("__row").isNotNull())
    known = F.col("__v").isNotNull() & reduce(lambda a, k: a & ident(k).isNotNull(), by, F.lit(True))
    hit = F.when(known, F.col("__hit"))
    out = out.select(F.col("__row"), hit.alias("__hit"))
    if not left:
        out = out.filter(F.col("__hit").isNotNull())
    return out.select("__row.*", *[F.col("__hit")[p].alias(p) for p in picked])


def _bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """NULL ends stand for minus and plus infinity."""
    inf = float("inf")
    return F.coalesce(low.cast("double"), F.lit(-inf)), F.coalesce(high.cast("double"), F.lit(inf))


def covered(df: DataFrame, ref: DataFrame, value: str, low: str, high: str, by=None, ref_by=None, closed: str = "[)", flag: str = "covered") -> DataFrame:
    """Flag the rows whose value lies in at least one reference interval of the same key.

    Intervals and values are merged in order and the farthest interval end so far is
    carried along: a value is covered when that end lies beyond it. One shuffle, no pairs.
    """
    by = as_list(by)
    rkeys = as_list(ref_by) or by
    lo, hi = _bounds(ident(low), ident(high))
    starts_first = closed[0] == "["
    side = ref.select(*[ident(r).alias(k) for r, k in zip(rkeys, by)], lo.alias("__v"), F.lit(0 if starts_first else 1).alias("__kind"), hi.alias("__end"))
    own = df.select(*[ident(k) for k in by], ident(value).cast("double").alias("__v"), F.lit(1 if starts_first else 0).alias("__kind"),
                    F.struct(*[ident(c) for c in df.columns]).alias("__row"))
    both = own.unionByName(side, allowMissingColumns=True)
    o = Ordered(both, by, ["__v", "__kind"]).running(__far=("max", F.col("__end")))
    out = o.result().filter(F.col("__row").isNotNull())
    hit = (F.col("__v") <= F.col("__far")) if closed[1] == "]" else (F.col("__v") < F.col("__far"))
    known = reduce(lambda a, k: a & ident(k).isNotNull(), by, F.lit(True))
    return out.select("__row.*", F.coalesce(hit & known, F.lit(False)).alias(flag))


def range_common(df: DataFrame, ref: DataFrame, value: str, low: str, high: str, by=None, ref_by=None, closed: str = "[)", invert: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows inside some interval, the other rows)."""
    marked = covered(df, ref, value, low, high, by, ref_by, closed, "__in")
    hit = marked.filter("__in").drop("__in"), marked.filter("not __in").drop("__in")
    return hit[::-1] if invert else hit


def _reached(df: DataFrame, ref: DataFrame, value: str, low: str, high: str, by: list[str], rkeys: list[str], closed: str) -> DataFrame:
    """Reference rows that hold no value: the next value from the start on lies beyond the end."""
    lo, hi = _bounds(ident(low), ident(high))
    first = closed[0] == "["
    side = ref.select(*[ident(r).alias(k) for r, k in zip(rkeys, by)], lo.alias("__v"), F.lit(0 if first else 1).alias("__kind"),
                      hi.alias("__end"), F.struct(*[ident(c) for c in ref.columns]).alias("__row"))
    own = df.filter(ident(value).isNotNull()).select(*[ident(k) for k in by], ident(value).cast("double").alias("__v"),
                                                     F.lit(1 if first else 0).alias("__kind"), ident(value).cast("double").alias("__x"))
    both = side.unionByName(own, allowMissingColumns=True)
    o = Ordered(both, by, ["__v", "__kind"]).running(True, __next=("min", F.col("__x")))
    hit = (F.col("__next") <= F.col("__end")) if closed[1] == "]" else (F.col("__next") < F.col("__end"))
    known = reduce(lambda a, k: a & ident(k).isNotNull(), by, F.lit(True))
    return o.result().filter(F.col("__row").isNotNull() & ~F.coalesce(hit & known, F.lit(False))).select("__row.*")


SIZES = (0, 3, 6, 9, 12, 15)  # values in one segment of each level, as powers of two


def _places(values: DataFrame, side: DataFrame, by: list[str], end: str, after_equal: bool, name: str) -> DataFrame:
    """``side`` with ``name``: how many values of the same key lie before the end (up to and with it if ``after_equal``)."""
    own = values.select(*[ident(k) for k in by], "__v", F.lit(0 if after_equal else 1).alias("__kind"), F.lit(1).alias("__one"))
    ends = side.select(*[ident(k) for k in by], ident(end).alias("__v"), F.lit(1 if after_equal else 0).alias("__kind"), F.struct(*[ident(c) for c in side.columns]).alias("__row"))
    o = Ordered(own.unionByName(ends, allowMissingColumns=True), by, ["__v", "__kind"]).running(__n=("count", F.col("__one")))
    return o.result().filter(F.col("__row").isNotNull()).select("__row.*", F.coalesce("__n", F.lit(0)).cast("long").alias(name))


def _segments(side: DataFrame) -> DataFrame:
    """The positions from ``__first`` to before ``__end`` of each row as whole segments, the largest that fit: __level, __segment."""
    first, end, runs = F.col("__first"), F.col("__end"), []

    def run(level: int, lo: Column, hi: Column) -> None:
        runs.append(F.struct(F.lit(level).alias("__level"), lo.alias("__lo"), hi.alias("__hi")))

    for level, bits in enumerate(SIZES):
        lo, hi = F.shiftright(first + ((1 << bits) - 1), bits), F.shiftright(end, bits)
        if level + 1 == len(SIZES):
            run(level, lo, hi)
            continue
        up, more = SIZES[level + 1], SIZES[level + 1] - bits
        next_lo, next_hi = F.shiftright(first + ((1 << up) - 1), up), F.shiftright(end, up)
        inner = next_lo < next_hi
        run(level, lo, F.when(inner, F.shiftleft(next_lo, more)).otherwise(hi))
        run(level, F.when(inner, F.shiftleft(next_hi, more)).otherwise(hi), hi)
    kept = [c for c in side.columns if c not in ("__first", "__end")]
    out = side.select(*kept, F.inline(F.array(*runs))).filter("__lo < __hi")
    return out.select(*kept, "__level", F.explode(F.sequence(F.col("__lo"), F.col("__hi") - 1)).alias("__segment"))


def interval_pieces(df: DataFrame, ref: DataFrame, value: str, low: str, high: str, by: list[str], rkeys: list[str], columns: dict[str, str], closed: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the interval join as an equi-join, and its keys: every pair that meets is a result.

    The values of a key are numbered in order. An interval, whatever its ends, holds the values of a run of numbers, and
    the run is cut into segments of 1, 8, 64, 512, 4,096 and 32,768 numbers: at most 14 of each size but the largest, so never
    more than the results of the interval. A value belongs to one segment of each size. Where a segment has more
    intervals than give ``PAIRS`` results, or a task's share of all results if that is more, they are dealt over parts,
    and its values are copied to each part: all copies together are at most ``RESULT_TASKS`` segments.
    """
    known = reduce(lambda a, k: a & ident(k).isNotNull(), by, F.lit(True))
    own = df.filter(ident(value).isNotNull() & known).withColumn("__v", ident(value).cast("double"))
    lo, hi = _bounds(ident(low), ident(high))
    keyed = [ident(r).alias(f"__k{i}") for i, r in enumerate(rkeys)]
    payload = [f"__f{i}" for i in range(len(columns))]
    side = ref.select(*keyed, lo.alias("__lo"), hi.alias("__hi"), *[ident(s).alias(f) for f, s in zip(payload, columns)])
    names = [f"__k{i}" for i in range(len(by))]
    side = side.filter(reduce(lambda a, k: a & F.col(k).isNotNull(), names, F.lit(True)))
    values = own.select(*[ident(k).alias(n) for k, n in zip(by, names)], "__v")
    side = _places(values, side, names, "__lo", closed[0] != "[", "__first")
    side = _places(values, side, names, "__hi", closed[1] == "]", "__end").filter("__first < __end")
    # numbers come from few tasks; what is many times as many rows, segments and copies, is made by all
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = cut_lineage(side.select(*names, "__first", "__end", *payload).repartition(parts))  # read for its counts and again for the join
    results = int(side.agg(F.sum(F.col("__end") - F.col("__first"))).first()[0] or 0)
    tasks, each = result_tasks(df.sparkSession, results, PAIRS), max(PAIRS, results // RESULT_TASKS)
    cell = [*names, "__level", "__segment"]
    counts = _segments(side.select(*names, "__first", "__end")).groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    share = F.greatest(F.lit(1), F.lit(each) / F.element_at(F.array(*[F.lit(1 << b) for b in SIZES]), F.col("__level") + 1))
    hot = counts.withColumn("__parts", F.ceil(F.col("__n") / share).cast("int")).filter("__parts > 1").orderBy(F.desc("__n")).limit(HOT_GROUPS).drop("__n")
    hot = F.broadcast(df.sparkSession.createDataFrame(hot.collect(), hot.schema))  # the rest give ``each`` results at most
    side = _segments(side.withColumn("__draw", F.xxhash64(F.monotonically_increasing_id())))  # the rows are stored, so a task that runs again draws alike
    side = side.join(hot, cell, "left").select(*cell, F.pmod(F.col("__draw"), F.coalesce("__parts", F.lit(1))).cast("int").alias("__part"), *payload)
    o = number_rows(own, by, ["__v"])
    o = o.repartition(parts, *[ident(k) for k in by], F.shiftright(F.col(RN) - 1, SIZES[-1])).select(*[ident(c) for c in df.columns], *[ident(k).alias(n) for k, n in zip(by, names)], F.inline(F.array(*[
        F.struct(F.lit(i).alias("__level"), F.shiftright(F.col(RN) - 1, b).alias("__segment")) for i, b in enumerate(SIZES)])))
    o = o.join(hot, cell, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    keys = [*cell, "__part"]
    return o.repartition(tasks, *keys), side.repartition(tasks, *keys), keys


def interval_join(df: DataFrame, ref: DataFrame, value: str, low: str, high: str, by=None, ref_by=None, fields=None,
                  closed: str = "[)", left: bool = False, right: bool = False) -> DataFrame:
    """Join each value with every interval that holds it; NULL ends are open to infinity."""
    by = as_list(by)
    _, picked = _reference(ref, by, ref_by, fields)
    rkeys = as_list(ref_by) or by
    pairs = renames(fields) if fields is not None else {c: c for c in ref.columns if c not in rkeys}
    no_clash(df, picked)
    own, side, keys = interval_pieces(df, ref, value, low, high, by, rkeys, pairs, closed)
    out = own.join(side, keys).select(*[ident(c) for c in df.columns], *[F.col(f"__f{i}").alias(d) for i, d in enumerate(pairs.values())])
    if left:
        lone = range_common(df, ref, value, low, high, by, rkeys, closed)[1]
        out = out.unionByName(lone, allowMissingColumns=True)
    if right:
        lone = _reached(df, ref, value, low, high, by, rkeys, closed)
        out = out.unionByName(lone.select(*[ident(r).alias(k) for r, k in zip(rkeys, by)], *[ident(s).alias(d) for s, d in pairs.items()]), allowMissingColumns=True)
    return out

"""Ordered work on groups of any size.

A window over ``partitionBy(key)`` hands a whole key to one task. That is fine for
ordinary keys and hopeless for a key that holds a third of the table. ``Ordered``
looks for such keys first. When there are none the plain window is used. Otherwise
the rows of every key are numbered exactly with a two-pass scan (cut points from a
sample, per-chunk counts, offsets) and divided into blocks of ``blockRows`` rows:

* bounded frames copy the few rows a neighbouring block needs (``frame``),
* running values add what the earlier blocks contributed (``running``),
* folds in Python see one block at a time (``by``/``order``).

Both ways give the same rows; the tests run every caller through both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.functions.spec import Key, as_list, ident, order_keys
from millrace.session import cut_lineage, setting

BLOCK_ROWS = 2_000_000  # rows of one key that one task may hold
HOT_GROUPS = 20_000  # hot keys looked up: every other key has at most rows / 20,000 rows
SAMPLE_PER_CHUNK = 16
BRACKET_SAMPLE = 1 << 20  # values drawn to bracket the quantiles of all hot keys
RESULTS = 1 << 22  # results of a join that one task may give, with at most ``RESULT_TASKS`` tasks
RESULT_TASKS = 2_000

RN, BLK, CHUNK, TIE, ALL, HOME = "__rn", "__blk", "__chunk", "__tie", "__all", "__home"


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hint: bool = False) -> DataFrame:
    """Equi-join on equally named keys where NULL matches NULL; keys come from the left."""
    side = right.select(*[ident(k).alias(f"__r_{i}") for i, k in enumerate(keys)],
                        *[ident(c) for c in right.columns if c not in keys])
    if hint:
        side = F.broadcast(side)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & ident(k).eqNullSafe(F.col(f"__r_{i}"))
    out = left.join(side, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{i}" for i in range(len(keys))])


def result_tasks(spark: SparkSession, results: int, each: int | None = None) -> int:
    """Tasks for so many results. Adaptive execution would choose them by the size of the input, and may leave one."""
    return min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-results // (each or RESULTS))), RESULT_TASKS)


_COUNTED: list[tuple[DataFrame, tuple[str, ...], int, int, DataFrame | None]] = []


def hot_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more rows than one task should hold, largest first; None if there are none.

    At most ``HOT_GROUPS`` rows come back, so the result may be broadcast; a key that
    is left out holds less than a 20,000th of the table. One job counts the keys; the
    answer is kept, so that operators over the same rows and keys don't count again.
    """
    if df.isStreaming:  # a stream arrives in bounded batches
        return None
    spark, limit, wanted = df.sparkSession, setting(df.sparkSession, "blockRows", BLOCK_ROWS), tuple(keys)
    counts = df.groupBy(*[ident(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    files = hash(tuple(sorted(df.inputFiles())))  # a path that was written anew has other files
    for seen, names, size, read, hot in _COUNTED:
        if names == wanted and size == limit and read == files and seen.sparkSession is spark and seen.sameSemantics(counts):
            return hot
    rows = counts.filter(F.col("__n") > limit).orderBy(F.desc("__n")).limit(HOT_GROUPS).collect()
    hot = spark.createDataFrame(rows, counts.schema) if rows else None
    _COUNTED.append((counts, wanted, limit, files, hot))
    del _COUNTED[:-32]
    return hot


def _not_after(cut: Column, row: Sequence[Column], keys: Sequence[Key]) -> Column:
    """cut <= row in the given order; one-field structs compare NULL as smallest."""
    out = F.lit(True)
    for i in reversed(range(len(keys))):
        c, r = F.struct(cut[f"c{i}"].alias("v")), F.struct(row[i].alias("v"))
        before = c > r if keys[i].desc else c < r
        out = before | ((c == r) & out)
    return out


def _chunked(df: DataFrame, keys: list[str], order: list[Key], hot: DataFrame) -> DataFrame:
    """Add the chunk number inside the key: 0 for ordinary keys, by cut point for hot ones."""
    spark = df.sparkSession
    limit = setting(spark, "blockRows", BLOCK_ROWS)
    total = hot.agg(F.sum("__n")).first()[0]
    rows = max(limit, total // HOT_GROUPS)
    parts = F.ceil(F.col("__n") / F.lit(rows))
    plan = hot.withColumn("__parts", parts).withColumn("__share", F.lit(SAMPLE_PER_CHUNK) * parts / F.col("__n"))
    picked = (
        join_keys(df.select(*[ident(k) for k in keys], *[k.value().alias(f"c{i}") for i, k in enumerate(order)]),
                  plan, keys, hint=True)
        .filter(F.pmod(F.xxhash64(*[F.col(f"c{i}") for i in range(len(order))]), F.lit(1_000_003)) < F.col("__share") * 1_000_003)
    )
    w = Window.partitionBy(*[ident(k) for k in keys])
    wo = w.orderBy(*[Key(f"c{i}", desc=k.desc).sort() for i, k in enumerate(order)])
    here = F.floor(F.col("__i") * F.col("__parts") / F.col("__m"))
    cuts = (
        picked.withColumn("__i", F.row_number().over(wo) - 1).withColumn("__m", F.count(F.lit(1)).over(w))
        .filter((F.col("__i") > 0) & (here > F.floor((F.col("__i") - 1) * F.col("__parts") / F.col("__m"))))
        .groupBy(*[ident(k) for k in keys])
        .agg(F.array_sort(F.collect_list(F.struct("__i", F.struct(*[f"c{i}" for i in range(len(order))]).alias("cut")))).alias("__s"))
        .select(*[ident(k) for k in keys], F.col("__s.cut").alias("__cuts"))
    )
    cuts = cut_lineage(cuts)  # at most one array per hot key, about 2 x HOT_GROUPS cut points in all
    out = join_keys(df, cuts, keys, "left", hint=True)
    size = F.coalesce(F.size("__cuts"), F.lit(0))
    row = [k.value() for k in order]
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(16))])

    def step(acc, s):
        nxt = acc + s
        return F.when((nxt <= size) & _not_after(F.get(F.col("__cuts"), nxt - 1), row, order), nxt).otherwise(acc)

    return out.withColumn(CHUNK, F.when(size > 0, F.aggregate(steps, F.lit(0), step)).otherwise(F.lit(0))).drop("__cuts")


def _numbered(df: DataFrame, keys: list[str], order: list[Key], hot: DataFrame) -> DataFrame:
    """Add the exact 1-based position of each row in its key."""
    out = _chunked(df, keys, order, hot)
    by = [ident(k) for k in keys]
    counts = join_keys(out, hot.drop("__n"), keys, "left_semi", hint=True).groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, CHUNK, F.coalesce(before, F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy(*by, CHUNK).orderBy(*[k.sort() for k in order]))
    # offsets: one row per chunk of a hot key, about 2 x HOT_GROUPS in all
    out = join_keys(out, offsets, [*keys, CHUNK], "left", hint=True)
    return out.withColumn(RN, (local + F.coalesce("__off", F.lit(0))).cast("long")).drop("__off", CHUNK)


class Ordered:
    """Rows of each key in a fixed total order, ready for frames, running values and folds.

    ``like``: a table with as many rows of each key, or slightly more, that is cheaper to count.
    """

    def __init__(self, df: DataFrame, keys=None, order=None, number: bool = False, like: DataFrame | None = None):
        spark = df.sparkSession
        self.columns = df.columns
        self.block = setting(spark, "blockRows", BLOCK_ROWS)
        self.keys = as_list(keys)
        ks = order_keys(order)
        self.helpers = [RN, BLK, TIE]
        if not self.keys:
            df, like = df.withColumn(ALL, F.lit(0)), like.withColumn(ALL, F.lit(0)) if like is not None else None
            self.keys = [ALL]
            self.helpers.append(ALL)
        hashed = [ident(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        self.hot = hot = hot_groups(df if like is None else like, self.keys)
        self.split = hot is not None
        df = df.withColumn(TIE, F.xxhash64(*hashed))  # equal sort keys: any fixed order
        ks = [*ks, Key(TIE)]
        self.order = ks
        if self.split:
            df = _numbered(df, self.keys, ks, hot).withColumn(BLK, F.floor((F.col(RN) - 1) / F.lit(self.block)).cast("long"))
            self.order = [Key(RN)]
        elif number:
            df = df.withColumn(RN, F.row_number().over(self.window()).cast("long"))
        self.df = df

    @property
    def by(self) -> list[Column]:
        """Columns that bound what one task sees."""
        return [ident(k) for k in self.keys] + ([F.col(BLK)] if self.split else [])

    def window(self, flip: bool = False) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*[k.sort(flip) for k in self.order])

    def frame(self, before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]]) -> Ordered:
        """Columns over a frame that reaches ``before`` rows back and ``after`` rows ahead."""
        if not self.split:
            self.df = self.df.withColumns(make(self.window()))
            return self
        self.df = self._with_halo(before, after)
        self.df = self.df.withColumns(make(self.window())).filter(F.col(BLK) == F.col(HOME)).drop(HOME)
        return self

    def _with_halo(self, before: int, after: int) -> DataFrame:
        """Copy the first and last rows of each block into its neighbours; HOME is a row's own block."""
        if max(before, after) > self.block:  # rows are copied into the neighbouring block, not beyond
            self.block = max(before, after)
            self.df = self.df.withColumn(BLK, F.floor((F.col(RN) - 1) / F.lit(self.block)).cast("long"))
        size, home = self.block, F.col(BLK)
        place = (F.col(RN) - 1) - home * size
        targets = [home]
        if before:
            targets.append(F.when(place >= size - before, home + 1))
        if after:
            targets.append(F.when((place < after) & (home > 0), home - 1))
        return self.df.withColumn(HOME, home).withColumn(BLK, F.explode(F.filter(F.array(*targets), lambda b: b.isNotNull())))

    def blocks(self, before: int = 0, after: int = 0) -> DataFrame:
        """Rows with key, block (BLK), own block (HOME) and position (RN), for folds in Python."""
        if not self.split:
            rn = F.row_number().over(self.window()).cast("long")
            return self.df.withColumns({RN: rn, BLK: F.lit(0).cast("long"), HOME: F.lit(0).cast("long")}).drop(TIE)
        return self._with_halo(before, after).drop(TIE)

    def running(self, flip: bool = False, **specs: tuple[str, Column] | tuple[str, Column, bool]) -> Ordered:
        """Running ``sum``/``count``/``min``/``max``/``last`` from the start of the key.

        Each spec is (kind, column, inclusive=True). ``last`` is the latest non-NULL
        value; ``flip`` runs from the end of the key instead.
        """
        w = self.window(flip)
        full = {n: (*s, True) if len(s) == 2 else s for n, s in specs.items()}
        agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        local = {}
        for name, (kind, col, inclusive) in full.items():
            frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            local[name] = F.last(col, ignorenulls=True).over(frame) if kind == "last" else agg[kind](col).over(frame)
        if not self.split:
            self.df = self.df.withColumns(local)
            return self
        pick = F.min_by if flip else F.max_by
        parts = []
        for i, (name, (kind, col, _)) in enumerate(full.items()):
            if kind == "last":
                latest = pick(F.struct(col.alias("v")), F.when(col.isNotNull(), F.col(RN)))
                parts.append(F.when(F.count(col) > 0, latest).alias(f"__b{i}"))
            else:
                parts.append(agg[kind](col).alias(f"__b{i}"))
        blocks = self.df.groupBy(*self.by).agg(*parts)
        wb = Window.partitionBy(*[ident(k) for k in self.keys]).orderBy(F.desc(BLK) if flip else F.asc(BLK))
        wb = wb.rowsBetween(Window.unboundedPreceding, -1)
        carry = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        cols = [
            (F.last(f"__b{i}", ignorenulls=True) if kind == "last" else carry[kind](f"__b{i}")).over(wb).alias(f"__c{i}")
            for i, (kind, _, _) in enumerate(full.values())
        ]
        blocks = blocks.select(*self.by, *cols)
        df = join_keys(self.df.withColumns(local), blocks, [*self.keys, BLK], "left")
        done = {}
        for i, (name, (kind, _, _)) in enumerate(full.items()):
            here, earlier = ident(name), F.col(f"__c{i}")
            if kind == "last":
                done[name] = F.coalesce(here, earlier["v"])
            elif kind in ("sum", "count"):
                done[name] = F.coalesce(here + earlier, here, earlier)
            else:
                done[name] = (F.least if kind == "min" else F.greatest)(here, earlier)
        self.df = df.withColumns(done).drop(*[f"__c{i}" for i in range(len(full))])
        return self

    def with_columns(self, cols: dict[str, Column]) -> Ordered:
        self.df = self.df.withColumns(cols)
        return self

    def drop(self, *names: str) -> Ordered:
        self.df = self.df.drop(*names)
        return self

    def result(self, *drop: str) -> DataFrame:
        return self.df.drop(*drop, *self.helpers)


def number_rows(df: DataFrame, keys=None, order=None, name: str = RN) -> DataFrame:
    """1-based position of each row in its key, exact for groups of any size."""
    o = Ordered(df, keys, order, number=True)
    out = o.df.drop(*[h for h in o.helpers if h != RN])
    return out if name == RN else out.withColumnRenamed(RN, name)


LOOK = object()  # find the hot keys


def spread(left: DataFrame, right: DataFrame, keys: Sequence[str], right_keys: Sequence[str], hot=LOOK) -> tuple[DataFrame, DataFrame, str | None]:
    """Salt the hot keys of the left side of a join, and copy their right rows once per salt.

    Adaptive skew handling does not reach a join whose other side was aggregated by the
    join key, which is the usual case here, so the salt is put in by hand. It comes from
    the row and its partition, the same when a lost task runs again. Returns both sides
    and the name of the salt column, or None where no key is hot.
    """
    hot = hot_groups(left, keys) if hot is LOOK else hot
    if hot is None:
        return left, right, None
    limit = setting(left.sparkSession, "blockRows", BLOCK_ROWS)
    hot = hot.select(*[ident(k) for k in keys], F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__salts"))
    values = [ident(f.name) for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    draw = F.pmod(F.xxhash64(*values, F.spark_partition_id()), F.col("__salts")).cast("int")
    salted = join_keys(left, hot, keys, "left", hint=True).withColumn("__salt", F.coalesce(draw, F.lit(0))).drop("__salts")
    named = hot.select(*[ident(k).alias(r) for k, r in zip(keys, right_keys)], "__salts")
    copies = join_keys(right, named, right_keys, "left", hint=True)
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return salted, copies, "__salt"


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", hot=LOOK) -> DataFrame:
    """``join_keys`` (inner or left) that divides the hot keys of the left side."""
    left, right, salt = spread(left, right, keys, keys, hot)
    out = join_keys(left, right, [*keys, salt] if salt else keys, how)
    return out.drop(salt) if salt else out


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row table to every row as a scalar subquery: no join, no shuffle of the rows."""
    cell = one.select(F.struct(*[ident(c) for c in one.columns]).alias("__one")).scalar()
    return df.withColumn("__one", cell).select(*[ident(c) for c in df.columns], F.col("__one.*"))


def totals(df: DataFrame, keys, aggs: dict[str, Column]) -> DataFrame:
    """Attach group aggregates to every row: partial aggregation, then a join back.

    Unlike an unordered window this never gathers a group; the joined side has one
    row per key, broadcast by adaptive execution when small, and hot keys are salted.
    """
    keys = as_list(keys)
    cols = [c.alias(n) for n, c in aggs.items()]
    if not keys:
        return with_row(df, df.agg(*cols))
    return join_spread(df, df.groupBy(*[ident(k) for k in keys]).agg(*cols), keys)


def quantiles(df: DataFrame, keys, points: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact interpolated quantiles: {output: (column, share)}, one row per key.

    Ordinary keys use the built-in aggregate. The wanted ranks of a hot key are bracketed by a sample first; then values
    are counted, those outside the brackets together, and the ranks are read off running counts, so only the values
    inside are ordered and no task holds all values of a key.
    """
    keys = as_list(keys)
    by = [ident(k) for k in keys]
    hot = hot_groups(df.withColumn(ALL, F.lit(0)) if not keys else df, keys or [ALL])
    if hot is None:
        return _percentiles(df, keys, points)
    group = keys or [ALL]
    base = df if keys else df.withColumn(ALL, F.lit(0))
    out = hot.select(*[ident(k) for k in group])
    for column in dict.fromkeys(c for c, _ in points.values()):
        wanted = {n: float(p) for n, (c, p) in points.items() if c == column}
        out = join_keys(out, _hot_quantiles(base, group, column, wanted, hot), group, "left", hint=True)
    out = out.select(*by, *[ident(n) for n in points])
    if keys:
        out = _percentiles(join_keys(df, hot.drop("__n"), keys, "left_anti", hint=True), keys, points).unionByName(out)
    return out


def _percentiles(df: DataFrame, keys: list[str], points: dict[str, tuple[str, float]]) -> DataFrame:
    """The built-in aggregate: one map of values per column, whatever the number of points."""
    shares = {c: list(dict.fromkeys(float(p) for x, p in points.values() if x == c)) for c, _ in points.values()}
    at = {c: F.percentile(ident(c), F.array(*map(F.lit, ps))) for c, ps in shares.items()}
    return df.groupBy(*[ident(k) for k in keys]).agg(*[F.get(at[c], F.lit(shares[c].index(float(p)))).alias(n) for n, (c, p) in points.items()])


def _hot_quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float], hot: DataFrame) -> DataFrame:
    """{output: share} of one column, one row per hot key that has a value."""
    by = [ident(k) for k in keys]
    shares = sorted(set(wanted.values()))
    values = df.filter(ident(column).isNotNull()).select(*by, ident(column).alias("__x"))
    brackets = cut_lineage(_brackets(values, keys, shares, hot))  # drawn once: a row per hot key
    found = cut_lineage(_ranked(values, keys, wanted, shares, brackets))
    names = [ident(n) for n in wanted]
    missed = F.lit(False)
    for n in names:
        missed = missed | n.isNull()
    if found.filter(missed).isEmpty():
        return found
    # a sample that lies: these keys are ordered whole
    again = join_keys(brackets, found.filter(missed), keys, "left_semi", hint=True)
    again = again.withColumns({c: F.lit(None).cast(again.schema[c].dataType) for c in again.columns if c not in keys})
    return found.filter(~missed).unionByName(_ranked(values, keys, wanted, shares, again))


def _brackets(values: DataFrame, keys: list[str], shares: list[float], hot: DataFrame) -> DataFrame:
    """__a{i}, __b{i} per hot key: values that lie five deviations below and above the i-th share in a sample; NULL is no bound."""
    most = max(BRACKET_SAMPLE // hot.count(), 1_000)  # per key
    rates = hot.select(*[ident(k) for k in keys], (F.lit(float(most)) / F.col("__n")).alias("__rate"))
    drawn = join_keys(values, rates, keys, hint=True).filter(F.rand(17) < F.col("__rate")).drop("__rate")
    w = Window.partitionBy(*[ident(k) for k in keys])
    drawn = drawn.withColumns({"__i": F.row_number().over(w.orderBy("__x")) - 1, "__m": F.count(F.lit(1)).over(w)})
    ends = []
    for i, p in enumerate(shares):
        pos, reach = F.lit(p) * (F.col("__m") - 1), F.ceil(5 * F.sqrt(F.col("__m") * (p * (1 - p)))) + 2
        ends += [F.max(F.when(F.col("__i") == F.floor(pos) - reach, F.col("__x"))).alias(f"__a{i}"), F.max(F.when(F.col("__i") == F.ceil(pos) + reach, F.col("__x"))).alias(f"__b{i}")]
    return join_keys(hot.drop("__n"), drawn.groupBy(*[ident(k) for k in keys]).agg(*ends), keys, "left")


def _ranked(values: DataFrame, keys: list[str], wanted: dict[str, float], shares: list[float], brackets: DataFrame) -> DataFrame:
    """The quantiles per key; NULL where a wanted rank lies outside its bracket."""
    by, x = [ident(k) for k in keys], F.col("__x")
    kept, gap = F.lit(False), F.lit(None)
    for i in reversed(range(len(shares))):
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        kept = kept | ((a.isNull() | (x >= a)) & (b.isNull() | (x <= b)))
        gap = F.when(x < a, a).otherwise(gap)  # values between two brackets stand just before the next one
    rows = join_keys(values, brackets, keys, hint=True).withColumns({"__kept": kept, "__x": F.when(kept, x).otherwise(gap)})
    counts = cut_lineage(rows.groupBy(*by, "__x", "__kept").agg(F.count(F.lit(1)).alias("__w")))  # read several times below
    o = Ordered(counts.filter(x.isNotNull()), keys, ["__x", "__kept"]).running(__cum=("sum", F.col("__w")))
    total = counts.groupBy(*by).agg(F.sum("__w").alias("__total"))
    ranked = join_spread(o.result(), total, keys, hot=o.hot).filter("__kept")
    aggs = []
    for name, p in wanted.items():
        pos = F.lit(p) * (F.col("__total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        at = lambda rank: F.max(F.when((F.col("__cum") - F.col("__w") <= rank) & (rank < F.col("__cum")), x.cast("double")))
        a, b = at(low), at(high)
        aggs.append((a + (b - a) * F.max(pos - low)).alias(name))
    return join_keys(total.select(*by), ranked.groupBy(*by).agg(*aggs), keys, "left")

"""Column selection, naming and computed columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spec import as_list, expand, ident, no_clash, order_keys, renames


def cut(df: DataFrame, fields, drop: bool = False, by_index: bool = False) -> DataFrame:
    """Select columns in the given order; ``a:b`` renames, wildcards expand, ``drop`` inverts."""
    if isinstance(fields, str) and ":" not in fields or not isinstance(fields, (str, dict)):
        pairs = {n: n for n in expand(df, fields, by_index)}
    else:
        pairs = {}
        for src, dst in renames(fields).items():
            for name in expand(df, src, by_index):
                pairs[name] = dst if dst != src else name
    if drop:
        return df.select(*[ident(c) for c in df.columns if c not in pairs])
    return df.select(*[ident(s).alias(d) for s, d in pairs.items()])


def rename(df: DataFrame, pairs=None, names: Sequence[str] | None = None) -> DataFrame:
    """Rename some columns (``a:b``) or all of them (``names``)."""
    if names is not None:
        return df.toDF(*as_list(names))
    return df.withColumnsRenamed(renames(pairs))


def set_constant(df: DataFrame, values: dict[str, object]) -> DataFrame:
    no_clash(df, values)
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


def _uniform(seed: int, parts: Sequence[Column]) -> Column:
    """A number in [0, 1) that depends only on the row's values and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def text_hash(seed: int, key) -> Column:
    """Hex sha256 of ``seed:a:b`` for the columns a, b of a key as text, null as an empty string."""
    parts = [F.coalesce(ident(k).cast("string"), F.lit("")) for k in as_list(key)]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def random_column(df: DataFrame, name: str, by=None, seed: int = 0, low: int | None = None, high: int | None = None, key=None) -> DataFrame:
    """Append a random real in [0, 1), or an integer in [low, high].

    With ``by`` all rows of a key share one value, drawn from a hash of the key, so
    no shuffle is needed and a lost task redraws the same value. With ``key``, the columns
    that name a row, the value is the first 52 bits of ``text_hash``, which any other tool
    can repeat.
    """
    keys = as_list(by)
    no_clash(df, [name])
    if key:
        u = F.conv(F.substring(text_hash(seed, key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    else:
        u = _uniform(seed, [ident(k) for k in keys]) if keys else F.rand(seed)
    if low is not None and high is not None:
        u = F.floor(u * (high - low + 1) + low).cast("long")
    return df.withColumn(name, u)


def reorder(df: DataFrame, head=None, tail=None) -> DataFrame:
    """Move matched columns to the front or the back."""
    first, last = expand(df, head), expand(df, tail)
    if not first and not last:
        raise ValueError("give head, tail or both")
    if set(first) & set(last):
        raise ValueError(f"columns both head and tail: {sorted(set(first) & set(last))}")
    middle = [c for c in df.columns if c not in first and c not in last]
    return df.select(*[ident(c) for c in first + middle + last])


def _marked(name: str, mark, delimiter: str, prefix: bool) -> str:
    return f"{mark}{delimiter}{name}" if prefix else f"{name}{delimiter}{mark}"


def unique_names(names: Sequence[str], delimiter: str = "^^", prefix: bool = False, by_position: bool = False,
                 allow_clash: bool = False, blank: str = "") -> list[str]:
    """Number every name that occurs more than once."""
    total, seen, out = Counter(names), Counter(), []
    for pos, name in enumerate(names, 1):
        seen[name] += 1
        if total[name] > 1:
            name = _marked(name or blank, pos if by_position else seen[name], delimiter, prefix)
        out.append(name)
    if not allow_clash and len(set(out)) < len(out):
        raise ValueError(f"names still clash: {out}")
    return out


def blank_names(names: Sequence[str], blank: str = "", delimiter: str = "^^", prefix: bool = False, by_position: bool = False) -> list[str]:
    """Give blank names the marker and a number; other names stay."""
    out, n = [], 0
    for pos, name in enumerate(names, 1):
        if not name:
            n += 1
            name = _marked(blank, pos if by_position else n, delimiter, prefix)
        out.append(name)
    return out


def group_names(names: Sequence[str], groups: Sequence[tuple[str, str]], ends: Sequence[str] = (), delimiter: str = "_",
                suffix: bool = False, mark_start: bool = False) -> list[str]:
    """Add a group name to the columns after each start column, up to the next start or the given end."""
    starts, search = [], 0
    for start, _ in groups:
        search = names.index(start, search)
        starts.append(search)
        search += 1
    out = list(names)
    for i, (_, group) in enumerate(groups):
        stop = starts[i + 1] if i + 1 < len(starts) else len(names)
        if i < len(ends) and ends[i] in names[starts[i]:stop]:
            stop = names.index(ends[i], starts[i]) + 1
        for j in range(starts[i] if mark_start else starts[i] + 1, stop):
            out[j] = _marked(names[j], group, delimiter, prefix=not suffix)
    return out


def apply_names(df: DataFrame, namer: Callable[..., list[str]], *args, **kwargs) -> DataFrame:
    """Rename all columns by one of the naming rules above; the rows are untouched."""
    return df.toDF(*namer(df.columns, *args, **kwargs))


def column_list(df: DataFrame, n: int, order=None, numbered: bool = False) -> DataFrame:
    """Columns turned into rows, with the first n (at most 100) rows as value columns.

    Without ``order`` they are whichever rows Spark reads first.
    """
    if not 0 <= n <= 100:
        raise ValueError(f"0 to 100 rows can become columns, not {n}")
    cols = df.columns
    top = df.orderBy(*[k.sort() for k in order_keys(order)]).limit(n) if order else df.limit(n)
    packed = top.agg(F.array_sort(F.collect_list(F.struct(
        *[k.value().alias(f"o{i}") for i, k in enumerate(order_keys(order))],
        F.array(*[ident(c).cast("string") for c in cols]).alias("cells")))).alias("rows"))  # at most 100 rows
    out = packed.select("rows", F.posexplode(F.array(*[F.lit(c) for c in cols])).alias("__pos", "field_name"))
    values = [F.get(F.get(F.col("rows"), F.lit(i))["cells"], F.col("__pos")).alias(f"value_{i + 1}") for i in range(n)]
    number = [(F.col("__pos") + 1).alias("no")] if numbered else []
    return out.select(*number, "field_name", *values)


def formulas(df: DataFrame, steps: Sequence[tuple[str, Column | str]]) -> DataFrame:
    """Named expressions in sequence; a later one may use an earlier one."""
    for name, expr in steps:
        df = df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)
    return df


def formula_over(df: DataFrame, fields, expr: Callable[[Column], Column], pattern: str = "new&", by_index: bool = False) -> DataFrame:
    """One expression over every matched column; ``&`` in the pattern is the column name."""
    if "&" not in pattern:
        raise ValueError("the output pattern must contain &")
    wanted = {pattern.replace("&", c): expr(ident(c)) for c in expand(df, fields, by_index)}
    return df.withColumns({n: e for n, e in wanted.items() if n not in df.columns})

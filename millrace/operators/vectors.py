"""Delimited vectors: one text cell with several items. Work happens on arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spec import as_list, expand, ident, order_keys, renames
from millrace.plans.ordered import join_spread


def items(c: Column, delim: str = " ") -> Column:
    """Text cell -> array; NULL and '' are the empty vector."""
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.split(c, re.escape(delim), -1))


def text(arr: Column, delim: str = " ") -> Column:
    """Array -> text cell; the empty vector is NULL, a NULL item is empty text."""
    return F.nullif(F.array_join(arr, delim, ""), F.lit(""))


def _apply(df: DataFrame, fields, delim: str, fn, out_delim: str | None = None) -> DataFrame:
    """Rewrite vector columns in place, or into new ones with ``a:b``."""
    return df.withColumns({dst: text(fn(items(ident(src), delim)), delim if out_delim is None else out_delim)
                           for src, dst in renames(fields).items()})


def split_columns(df: DataFrame, field: str, names, delim: str = " ", drop: bool = False) -> DataFrame:
    """Split a text column into named columns; surplus parts are dropped."""
    parts = F.split(ident(field), re.escape(delim), -1)
    out = df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(as_list(names))})
    return out.drop(field) if drop else out


def sort_across(df: DataFrame, fields, numeric: bool = False, reverse: bool = False) -> DataFrame:
    """Sort the values of several columns inside each row; NULL is the smallest."""
    names = expand(df, fields)
    cells = F.array(*[F.struct((ident(n).try_cast("double") if numeric else ident(n).cast("string")).alias("s"), ident(n).cast("string").alias("v")) for n in names])
    ordered = F.sort_array(cells, asc=not reverse)
    out = df.withColumn("__s", ordered)
    return out.withColumns({n: F.get(F.col("__s"), F.lit(i))["v"].cast(df.schema[n].dataType) for i, n in enumerate(names)}).drop("__s")


def rows_to_vector(df: DataFrame, field: str, by, order=None, delim: str = " ") -> DataFrame:
    """One vector per key in the given order. The result cell holds the whole group by definition."""
    keys = [ident(k) for k in as_list(by)]
    ks = order_keys(order or field)
    entry = F.struct(*[k.value().alias(f"o{i}") for i, k in enumerate(ks)], ident(field).cast("string").alias("v"))
    held = F.collect_list(F.when(ident(field).isNotNull(), entry))

    def compare(a: Column, b: Column) -> Column:
        """Key by key in its own direction, NULL as the smallest value; then by the cell."""
        out = F.lit(0)
        for name, desc in reversed([*((f"o{i}", k.desc) for i, k in enumerate(ks)), ("v", ks[0].desc)]):
            x, y = F.struct(a[name].alias("c")), F.struct(b[name].alias("c"))
            out = F.when(x < y, F.lit(1 if desc else -1)).when(x > y, F.lit(-1 if desc else 1)).otherwise(out)
        return out

    mixed = len({k.desc for k in ks}) > 1
    arr = F.array_sort(held, compare) if mixed else F.sort_array(held, asc=not ks[0].desc)
    return df.groupBy(*keys).agg(text(F.transform(arr, lambda s: s["v"]), delim).alias(field))


def vector_to_rows(df: DataFrame, field: str, delim: str = " ") -> DataFrame:
    return df.withColumn(field, F.explode(items(ident(field), delim)))


def fields_to_vector(df: DataFrame, name: str, fields, delim: str = " ", sign: str = "=", values_only: bool = False) -> DataFrame:
    """Several columns -> one vector of ``name=value`` items; NULL is skipped."""
    cols = expand(df, fields)
    parts = [ident(c).cast("string") if values_only else F.concat(F.lit(c + sign), ident(c).cast("string")) for c in cols]
    out = df.withColumn("__v", F.nullif(F.concat_ws(delim, *parts), F.lit("")))
    return out.drop(*cols).withColumnRenamed("__v", name)


def vector_to_fields(df: DataFrame, field: str, names, delim: str = " ", sign: str = "=") -> DataFrame:
    """``name=value`` items back to columns; the first value of a name counts."""
    arr = items(ident(field), delim)

    def value(n: str) -> Column:
        hit = F.get(F.filter(arr, lambda s: s.startswith(n + sign)), F.lit(0))
        return F.substr(hit, F.lit(len(n + sign) + 1))

    return df.withColumns({n: value(n) for n in as_list(names)}).drop(field)


def flags_to_vector(df: DataFrame, name: str, fields, delim: str = " ") -> DataFrame:
    """Names of the columns that hold a value."""
    cols = expand(df, fields)
    out = df.withColumn("__v", F.nullif(F.concat_ws(delim, *[F.when(ident(c).isNotNull(), F.lit(c)) for c in cols]), F.lit("")))
    return out.drop(*cols).withColumnRenamed("__v", name)


def vector_to_flags(df: DataFrame, field: str, names, delim: str = " ") -> DataFrame:
    """1 where the vector holds the name, else NULL."""
    arr = items(ident(field), delim)
    return df.withColumns({n: F.when(F.array_contains(arr, n), F.lit(1)) for n in as_list(names)}).drop(field)


def vector_concat(df: DataFrame, fields, name: str, delim: str = " ", drop: bool = True) -> DataFrame:
    cols = expand(df, fields)
    out = df.withColumn("__v", text(F.concat(*[items(ident(c), delim) for c in cols]), delim))
    return (out.drop(*cols) if drop else out).withColumnRenamed("__v", name)


def vector_count(df: DataFrame, fields, delim: str = " ") -> DataFrame:
    """``v:n`` adds the number of items; an empty vector has none."""
    return df.withColumns({dst: F.size(items(ident(src), delim)) for src, dst in renames(fields).items()})


def vector_delimiter(df: DataFrame, fields, new: str, delim: str = " ") -> DataFrame:
    return _apply(df, fields, delim, lambda a: a, new)


def vector_drop_empty(df: DataFrame, fields, delim: str = " ") -> DataFrame:
    return _apply(df, fields, delim, lambda a: F.filter(a, lambda v: v != ""))


def vector_fill_empty(df: DataFrame, fields, value: str | None = None, previous: bool = False, other: str | None = None, delim: str = " ") -> DataFrame:
    """Replace empty items by a value or by the item before; ``other`` replaces the rest."""
    def fill(a: Column) -> Column:
        rest = (lambda v: F.lit(other)) if other is not None else (lambda v: v)
        if not previous:
            return F.transform(a, lambda v: F.when(v == "", F.lit(value)).otherwise(rest(v)))
        kept = F.aggregate(a, F.array().cast("array<string>"), lambda acc, v: F.array_append(
            acc, F.when((v == "") & (F.size(acc) > 0), F.element_at(acc, -1)).otherwise(rest(v))))
        return F.when(F.size(a) > 0, kept).otherwise(a)

    return _apply(df, fields, delim, fill)


def vector_sort(df: DataFrame, fields, numeric: bool = False, reverse: bool = False, delim: str = " ") -> DataFrame:
    def order(a: Column) -> Column:
        if not numeric:
            return F.sort_array(a, asc=not reverse)
        pairs = F.transform(a, lambda v: F.struct(v.try_cast("double").alias("n"), v.alias("v")))
        return F.transform(F.sort_array(pairs, asc=not reverse), lambda s: s["v"])

    return _apply(df, fields, delim, order)


def vector_unique(df: DataFrame, fields, adjacent: bool = False, delim: str = " ") -> DataFrame:
    """Distinct items in first-seen order, or only neighbouring repeats collapsed."""
    def once(a: Column) -> Column:
        if not adjacent:
            return F.array_distinct(a)
        return F.filter(a, lambda v, i: (i == 0) | (v != F.get(a, i - 1)))

    return _apply(df, fields, delim, once)


def _item_lookup(df: DataFrame, field: str, ref: DataFrame, key: str, value: str | None, delim: str, make) -> DataFrame:
    """Look up every item in the reference and rebuild the vector from the results.

    Each distinct vector is taken apart once and put together under its own text, so
    no row id is needed and repeated vectors cost one look-up.
    """
    vectors = df.select(ident(field).alias("__vec")).filter(F.col("__vec").isNotNull()).distinct()
    parts = vectors.select("__vec", F.posexplode(items(F.col("__vec"), delim)).alias("__pos", "__item"))
    cols = [F.min(ident(value).cast("string")).alias("__val")] if value else [F.lit(None).cast("string").alias("__val")]
    side = ref.filter(ident(key).isNotNull()).groupBy(ident(key).cast("string").alias("__item")).agg(*cols).withColumn("__has", F.lit(True))
    looked = join_spread(parts, side, ["__item"]).withColumn("__new", make(F.col("__item"), F.col("__val"), F.col("__has").isNotNull()))
    entry = F.struct("__pos", "__new")
    built = looked.groupBy("__vec").agg(F.flatten(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["__new"])).alias("__arr"))
    return built.select("__vec", text(F.col("__arr"), delim).alias("__text"))


def _rejoin(df: DataFrame, built: DataFrame, field: str, name: str) -> DataFrame:
    out = join_spread(df, built.withColumnRenamed("__vec", field), [field])
    return out.withColumn(name, F.col("__text")).drop("__text")


def vector_common(df: DataFrame, field: str, ref: DataFrame, key: str, name: str | None = None, invert: bool = False, delim: str = " ") -> DataFrame:
    """Keep the items that exist in the reference column (``invert``: that do not)."""
    keep = lambda item, val, has: F.when(~has if invert else has, F.array(item)).otherwise(F.array().cast("array<string>"))
    return _rejoin(df, _item_lookup(df, field, ref, key, None, delim, keep), field, name or field)


def vector_join(df: DataFrame, field: str, ref: DataFrame, key: str, value: str, name: str | None = None, default: str | None = None, delim: str = " ") -> DataFrame:
    """Insert the looked-up value right after its item; no match inserts the default or nothing."""
    none = F.array(F.lit(default)) if default is not None else F.array().cast("array<string>")
    add = lambda item, val, has: F.concat(F.array(item), F.when(has, F.array(F.coalesce(val, F.lit("")))).otherwise(none))
    return _rejoin(df, _item_lookup(df, field, ref, key, value, delim, add), field, name or field)


def vector_replace(df: DataFrame, field: str, ref: DataFrame, key: str, value: str, name: str | None = None, default: str | None = None, delim: str = " ") -> DataFrame:
    """Replace each item by its looked-up value; no match gives the default or an empty item."""
    put = lambda item, val, has: F.array(F.coalesce(F.when(has, val), F.lit(default if default is not None else "")))
    return _rejoin(df, _item_lookup(df, field, ref, key, value, delim, put), field, name or field)

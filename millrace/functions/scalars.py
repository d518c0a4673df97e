"""Value rewriting and scalar helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spec import as_list, expand, fold, ident, inside, renames
from millrace.plans.ordered import Ordered

# fixed value: what counts as a number
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """Text to double; anything that is not a plain number is NULL."""
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def round_sig(c: Column, digits: int = 10) -> Column:
    """Round to significant digits."""
    return F.format_string(f"%.{digits - 1}e", c).try_cast("double")


def epoch(c: Column) -> Column:
    """Timestamp to seconds with microseconds."""
    return F.unix_micros(c) / F.lit(1e6)


def parse_time(c: Column) -> Column:
    """``YYYYMMDDhhmmss[.ffffff]`` or ``YYYYMMDD`` text to a timestamp; bad text is NULL."""
    s = c.cast("string")
    part = lambda start, n: F.substring(s, start, n).try_cast("int")
    secs = F.substring(s, 13, 9).try_cast("decimal(16,6)")
    full = F.try_make_timestamp(part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), secs)
    day = F.try_make_timestamp(part(1, 4), part(5, 2), part(7, 2), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return F.when(s.rlike(r"^\d{14}(\.\d{1,6})?$"), full).when(s.rlike(r"^\d{8}$"), day)


def format_time(c: Column, fraction: bool = False) -> Column:
    return F.date_format(c, "yyyyMMddHHmmss.SSSSSS" if fraction else "yyyyMMddHHmmss")


def format_day(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def _targets(df: DataFrame, fields) -> dict[str, str]:
    if isinstance(fields, dict) or (isinstance(fields, str) and ":" in fields):
        return renames(fields)
    return {f: f for f in expand(df, fields)}


def change_number(df: DataFrame, fields, bounds, labels=None, other=None, keep: bool = False, right_closed: bool = False) -> DataFrame:
    """Numbers to labels by range. Bounds may start with MIN and end with MAX; outside -> other / NULL / kept."""
    edges = as_list(bounds) if isinstance(bounds, str) else [str(b) for b in bounds]
    ends = [None if e in ("MIN", "MAX") else float(e) for e in edges]
    names = as_list(labels) or ["_".join("" if b in ("MIN", "MAX") else b for b in edges[i:i + 2]) for i in range(len(edges) - 1)]
    if len(names) != len(edges) - 1:
        raise ValueError("give one label per range")
    brackets = ("(", "]") if right_closed else ("[", ")")

    def change(x: Column) -> Column:
        out = x.cast("string") if keep else F.lit(other).cast("string")
        for i in reversed(range(len(names))):
            out = F.when(inside(x, (brackets[0], ends[i], ends[i + 1], brackets[1])), F.lit(names[i])).otherwise(out)
        return out

    return df.withColumns({dst: change(ident(src)) for src, dst in _targets(df, fields).items()})


def change_text(df: DataFrame, fields, mapping, other=None, keep: bool = False, substring: bool = False) -> DataFrame:
    """Map texts ``from:to``; unmatched -> other / NULL / kept. ``substring`` replaces inside the text."""
    pairs = renames(mapping)

    def change(x: Column) -> Column:
        x = x.cast("string")
        if substring:
            hit, out = fold([x.contains(a) for a in pairs], every=False), x
            for a, b in pairs.items():
                out = F.replace(out, F.lit(a), F.lit(b))
        else:
            hit = x.isin(*pairs)
            out = F.get(F.array(*[F.lit(b) for b in pairs.values()]), F.array_position(F.array(*[F.lit(a) for a in pairs]), x).cast("int") - 1)
        return F.when(hit, out).otherwise(x if keep else F.lit(other).cast("string"))

    return df.withColumns({dst: change(ident(src)) for src, dst in _targets(df, fields).items()})


_TOKEN = re.compile(r"\$(&|`|'|[0-9]+)")


def regex_replace(df: DataFrame, fields, pattern: str, value: str, every: bool = False) -> DataFrame:
    """Replace the first match, or all. ``$&`` match, ``$N`` group, ``$``` text before, ``$'`` text after."""
    tokens, at = [], 0
    for m in _TOKEN.finditer(value):
        tokens += [("text", value[at:m.start()]), ("token", m[1])]
        at = m.end()
    tokens.append(("text", value[at:]))

    def built(match: Column, group, before: Column, after: Column) -> Column:
        pick = {"&": lambda: match, "`": lambda: before, "'": lambda: after}
        return F.concat(*[F.lit(t) if kind == "text" else pick.get(t, lambda: group(int(t)))() for kind, t in tokens])

    def first(x: Column) -> Column:
        pos = F.regexp_instr(x, F.lit(pattern))
        match = F.regexp_extract(x, pattern, 0)
        before = F.substr(x, F.lit(1), pos - 1)
        after = F.substr(x, pos + F.length(match))
        new = built(match, lambda i: F.regexp_extract(x, pattern, i), before, after)
        return F.when(pos > 0, F.concat(before, new, after)).otherwise(x)

    def all_of(x: Column) -> Column:
        if not any(kind == "token" and t in "`'" for kind, t in tokens):
            new = "".join(t.replace("\\", "\\\\").replace("$", "\\$") if kind == "text" else "$" + ("0" if t == "&" else t) for kind, t in tokens)
            return F.regexp_replace(x, pattern, new)
        # text before and after differ per match: walk over the pieces between the matches
        pieces = F.split(x, pattern, -1)
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        start = F.struct(F.get(pieces, F.lit(0)).alias("seen"), F.get(pieces, F.lit(0)).alias("out"))

        def walk(acc, i):
            match, piece = F.get(found, i), F.get(pieces, i + 1)
            after = F.substr(x, F.length(acc["seen"]) + F.length(match) + 1)
            group = lambda n: F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(n)), i)
            new = built(match, group, acc["seen"], after)
            return F.struct(F.concat(acc["seen"], match, piece).alias("seen"), F.concat(acc["out"], new, piece).alias("out"))

        index = F.transform(found, lambda m, i: i)
        return F.when(F.size(found) > 0, F.aggregate(index, start, walk)["out"]).otherwise(x)

    change = all_of if every else first
    return df.withColumns({dst: change(ident(src)) for src, dst in _targets(df, fields).items()})


def fill_null(df: DataFrame, fields, value=None, previous: bool = False, by=None, order=None, other=None) -> DataFrame:
    """NULL to a value, or to the last non-NULL value in the key's order; ``other`` replaces the rest."""
    targets = _targets(df, fields)

    def present(x: Column, dtype) -> Column:
        return x if other is None else F.when(x.isNotNull(), F.lit(other).cast(dtype))

    if not previous:
        return df.withColumns({d: F.coalesce(present(ident(s), df.schema[s].dataType), F.lit(value).cast(df.schema[s].dataType)) for s, d in targets.items()})
    names = {s: f"__p{i}" for i, s in enumerate(targets)}
    o = Ordered(df, by, order).running(**{n: ("last", ident(s)) for s, n in names.items()})
    out = o.result().withColumns({d: F.coalesce(present(ident(s), df.schema[s].dataType), F.col(names[s])) for s, d in targets.items()})
    return out.drop(*names.values())


def to_null(df: DataFrame, fields, values, substring: bool = False) -> DataFrame:
    """Listed values, or texts that contain them, become NULL."""
    values = as_list(values)

    def change(x: Column) -> Column:
        s = x.cast("string")
        return F.when(~(fold([s.contains(v) for v in values], every=False) if substring else s.isin(*values)), x)

    return df.withColumns({dst: change(ident(src)) for src, dst in _targets(df, fields).items()})


# fixed values: date and time parts of a format and the text they accept
_PARTS = {"Y": r"(\d{1,4})", "y": r"(\d{1,2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "H": r"(\d{1,2})", "M": r"(\d{1,2})",
          "S": r"(\d{1,2})", "s": r"(\d{1,2}(?:\.\d{1,6})?)"}


def parse_format(c: Column, fmt: str) -> Column:
    """Date or timestamp from text by ``%Y %y %m %d %H %M %S %s``; text that does not fit is NULL."""
    s, pattern, order, i = c.cast("string"), "", [], 0
    while i < len(fmt):
        if fmt[i] == "%" and fmt[i + 1:i + 2] in _PARTS:
            part = fmt[i + 1]
            # parts that touch take their full width, otherwise up to it
            touching = fmt[i + 2:i + 3] == "%"
            pattern += _PARTS[part].replace("{1,", "{") if touching and part != "s" else _PARTS[part]
            order.append(part)
            i += 2
        else:
            pattern += re.escape(fmt[i])
            i += 1
    group = lambda p: F.regexp_extract(s, f"^{pattern}$", order.index(p) + 1)
    num = lambda p, default: group(p).try_cast("int") if p in order else F.lit(default)
    year = num("Y", 1970)
    if "y" in order:
        two = num("y", 70)
        year = F.when(two < 69, two + 2000).otherwise(two + 1900)
    secs = (group("s") if "s" in order else group("S") if "S" in order else F.lit("0")).try_cast("decimal(16,6)")
    stamp = F.try_make_timestamp(year, num("m", 1), num("d", 1), num("H", 0), num("M", 0), secs)
    stamp = F.when(s.rlike(f"^{pattern}$"), stamp)
    return stamp if set(order) & set("HMSs") else stamp.cast("date")


def format_dates(df: DataFrame, fields, fmt: str) -> DataFrame:
    return df.withColumns({dst: parse_format(ident(src), fmt) for src, dst in _targets(df, fields).items()})


def previous(df: DataFrame, fields, order, by=None, rows: int = 1) -> DataFrame:
    """Bring the value of an earlier row along: ``a:b`` adds b."""
    pairs = renames(fields)
    return Ordered(df, by, order).frame(rows, 0, lambda w: {d: F.lag(ident(s), rows).over(w) for s, d in pairs.items()}).result()



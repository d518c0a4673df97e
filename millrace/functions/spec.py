"""Argument conventions shared by the operators: column lists, order keys, intervals."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(spec) -> list[str]:
    """``"a,b"``, ``["a", "b"]`` and None all become a list of names."""
    if spec is None:
        return []
    if isinstance(spec, str):
        return [s.strip() for s in spec.split(",") if s.strip()]
    return list(spec)


def ident(name: str) -> Column:
    """Column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def expand(df: DataFrame, spec, by_index: bool = False) -> list[str]:
    """Resolve names with ``*``/``?`` wildcards, or 0-based numbers with ``by_index``."""
    names = df.columns
    out: list[str] = []
    for item in as_list(spec):
        item = str(item)
        if by_index:
            hit = [names[i] for i in _positions(item, len(names))]
        elif item in names:
            hit = [item]
        elif "*" in item or "?" in item:
            hit = [n for n in names if fnmatch.fnmatchcase(n, item)]
        else:
            raise ValueError(f"unknown column {item!r}; have {names}")
        out += [h for h in hit if h not in out]
    return out


def _positions(item: str, n: int) -> list[int]:
    def one(text: str) -> int:
        pos = n - 1 - int(text[:-1]) if text.endswith("L") else int(text)
        if not 0 <= pos < n:
            raise ValueError(f"column number {text} outside 0..{n - 1}")
        return pos

    if "-" in item:
        lo, hi = (one(p) for p in item.split("-", 1))
        step = 1 if lo <= hi else -1
        return list(range(lo, hi + step, step))
    return [one(item)]


def renames(spec) -> dict[str, str]:
    """``"a:b,c"`` or a mapping -> {source: target}; no target keeps the name."""
    if isinstance(spec, dict):
        return dict(spec)
    pairs = (item.partition(":") for item in as_list(spec))
    return {src: (dst or src) for src, _, dst in pairs}


@dataclass(frozen=True)
class Key:
    """One order key. NULL counts as the smallest value in both directions."""

    name: str
    numeric: bool = False
    desc: bool = False

    def value(self) -> Column:
        return ident(self.name).try_cast("double") if self.numeric else ident(self.name)

    def sort(self, flip: bool = False) -> Column:
        down = self.desc != flip
        return self.value().desc_nulls_last() if down else self.value().asc_nulls_first()


def order_keys(spec: str | Sequence[str | Key] | None) -> list[Key]:
    """``c``, ``c%n``, ``c%r``, ``c%nr``: natural, numeric, descending, both."""
    out = []
    for item in as_list(spec):
        if isinstance(item, Key):
            out.append(item)
            continue
        name, _, flags = item.partition("%")
        if set(flags) - set("nr"):
            raise ValueError(f"order flags must be n or r: {item!r}")
        out.append(Key(name, "n" in flags, "r" in flags))
    return out


def sort_columns(spec, flip: bool = False) -> list[Column]:
    return [k.sort(flip) for k in order_keys(spec)]


_INTERVAL = re.compile(r"^([\[(])([^,]*),([^,]*)([\])])$")


def intervals(spec: str | Iterable[str]) -> list[tuple[str, float | None, float | None, str]]:
    """``"[1,5),(9,MAX]"`` -> open/closed ends with None for MIN / MAX."""
    if isinstance(spec, str):
        spec = re.findall(r"[\[(][^\[\](),]*,[^\[\](),]*[\])]", spec)
    out = []
    for text in spec:
        m = _INTERVAL.match(text.replace(" ", ""))
        if not m:
            raise ValueError(f"not an interval: {text!r}")
        lo = None if m[2] in ("", "MIN") else float(m[2])
        hi = None if m[3] in ("", "MAX") else float(m[3])
        out.append((m[1], lo, hi, m[4]))
    return out


def inside(x: Column, interval) -> Column:
    left, lo, hi, right = interval
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x >= lo if left == "[" else x > lo)
    if hi is not None:
        cond = cond & (x <= hi if right == "]" else x < hi)
    return cond


def no_clash(df: DataFrame, names: Iterable[str]) -> None:
    clash = sorted(set(names) & set(df.columns))
    if clash:
        raise ValueError(f"output columns already exist: {clash}")


def fold(conditions: Sequence[Column], every: bool) -> Column:
    """AND (``every``) or OR over conditions; NULL counts as false."""
    out = None
    for c in conditions:
        c = F.coalesce(c, F.lit(False))
        out = c if out is None else (out & c if every else out | c)
    return F.lit(True) if out is None else out

"""Repair of messy CSV text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.spec import as_list, ident
from millrace.plans.folds import fold
from millrace.plans.ordered import Ordered
from millrace.sources import ranges

_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # a comma outside quotes


def cells(line: Column) -> Column:
    """CSV line to its raw cells, quotes kept."""
    return F.split(line, _COMMA, -1)


def align(df: DataFrame, field: str, width: int) -> DataFrame:
    """Pad every CSV line with empty cells, or cut it, to ``width`` cells."""
    parts = cells(ident(field))
    fixed = F.slice(F.concat(parts, F.array_repeat(F.lit(""), F.lit(width))), 1, width)
    return df.withColumn(field, F.when(F.size(parts) == width, ident(field)).otherwise(F.array_join(fixed, ",")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file with their 1-based number; a file may have any size."""
    lines = ranges.read_lines(spark, path)
    return lines.select("file", "line", F.regexp_replace("value", r"\r$", "").alias("text"))


def _exclusion(text: str, start: str | None, start_blank: bool, end: str | None, end_blank: bool, end_rows: int | None):
    """State: 1 while lines are left out, and the number of lines since the start line.

    The start line itself is never tested for the end.
    """
    begins = re.compile(start) if start is not None else re.compile("^$") if start_blank else None
    ends = re.compile(end) if end is not None else re.compile("^$") if end_blank else None

    def walk(pdf: pd.DataFrame, out: float, n: float):
        flags = []
        for line in pdf[text].fillna("").tolist():
            if not out:
                hit = begins is not None and begins.search(line) is not None
                flags.append(int(hit))
                if hit and not (ends is None and end_rows == 1):
                    out, n = 1.0, 1.0
                continue
            n += 1
            flags.append(1)
            if ends is not None:
                done = ends.search(line) is not None
            else:
                done = n == end_rows if end_rows is not None else False
            if done:
                out, n = 0.0, 0.0
            elif end_rows is None or ends is not None:
                n = 1.0  # only a row count needs it; a steady state lets blocks agree sooner
        return flags, out, n

    return walk


def cut_region(df: DataFrame, line: str, text: str, header_line: int, first_line: int, by=None, start: str | None = None, start_blank: bool = False,
               end: str | None = None, end_blank: bool = False, end_rows: int | None = None) -> DataFrame:
    """Cut the CSV region out of messy text, file by file.

    Keeps the header line and the lines from ``first_line`` on, without the ranges that
    begin at a regex or blank line and end at a regex, a blank line or after n lines.
    """
    head = df.filter(ident(line) == header_line) if header_line < first_line else df.limit(0)
    body = df.filter(ident(line) >= first_line)
    flagged = fold(Ordered(body, by, [line]), [text], _exclusion(text, start, start_blank, end, end_blank, end_rows), "__out")
    return head.unionByName(flagged.filter("__out = 0").drop("__out", "__tie"))


def header_width(lines: DataFrame, line: str, text: str, by=None) -> DataFrame:
    """Number of cells of each file's header line."""
    keys = as_list(by)
    return lines.filter(ident(line) == 1).select(*[ident(k) for k in keys], F.size(cells(ident(text))).alias("width"))

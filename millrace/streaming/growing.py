"""Follow growing files: a streaming source whose offsets are byte positions per file.

Whole lines only: what stands behind the last line end waits until its line end comes. The offsets are in the query's
own log, so a query that is started again goes on behind the last line it took. A file that got shorter was replaced
and is read from its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.sources import ranges

SCHEMA = "path string, position long, value string"


class _Range(InputPartition):
    def __init__(self, path: str, first: int, lo: int, hi: int):
        self.path, self.first, self.lo, self.hi = path, first, lo, hi


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.lines = int(options["lastlines"]) if "lastlines" in options else None
        self.size = int(options.get("rangebytes", ranges.RANGE))
        self.fs = None

    def _files(self) -> dict[str, int]:
        self.fs = ranges.file_system(self.path)[0]
        return ranges.sizes(self.path)

    def initialOffset(self) -> dict:
        """The start of every file, or of the last lines of those that are there."""
        if self.lines is None:
            return {}
        return {f: ranges.line_start(self.fs, f, n, self.lines) for f, n in self._files().items()}

    def latestOffset(self) -> dict:
        """Behind the last whole line of every file."""
        return {f: ranges.line_start(self.fs, f, n) for f, n in self._files().items()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        begin = {f: start.get(f, 0) if start.get(f, 0) <= n else 0 for f, n in end.items()}
        return [_Range(*p) for f, n in sorted(end.items()) for p in ranges.ranges(f, begin[f], n, self.size)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = ranges.file_system(self.path)
        for places, lines in ranges.lines_in(fs, part.path, part.first, part.lo, part.hi):
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines)), pa.array(places, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], ["path", "position", "value"])


class GrowingFiles(DataSource):
    """``format("growing_lines")``; options: path (a file or folder), lastLines, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def follow_lines(spark: SparkSession, path: str, last_lines: int | None = None, range_bytes: int = ranges.RANGE) -> DataFrame:
    """A stream of (path, position, value) with the lines of a growing file, or of all files of a folder.

    ``last_lines``: begin with so many lines at the end of each file that is there; without it, with the first.
    """
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_lines").option("path", path).option("rangeBytes", range_bytes)
    return (reader if last_lines is None else reader.option("lastLines", last_lines)).load()

"""Lines of files by byte range: no task and no cell ever holds a whole file.

Files are reached through Arrow's file systems, so a path may be local or a URI (``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that one task reads.
RANGE = 32 << 20
#: Bytes fetched at a time.
STEP = 1 << 20
#: Tasks of a read of small ranges; more only for more than ``RANGE`` bytes each.
PARALLEL = 256
#: Most tasks of one read; each then takes several ranges.
TASKS = 20_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    return pafs.FileSystem.from_uri(path)


def sizes(path: str) -> dict[str, int]:
    """Size of each file: the file itself, or all files of a folder but hidden ones (``_`` or ``.`` in front)."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return {inner: info.size}
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    return {x.path: x.size for x in found if x.type == pafs.FileType.File and x.base_name[:1] not in "._"}


def line_start(fs: pafs.FileSystem, path: str, end: int, lines: int = 0, floor: int = 0) -> int:
    """Where the last ``lines`` whole lines before ``end`` begin; for 0, where the last whole line ends."""
    with fs.open_input_file(path) as f:
        at, left = end, lines + 1
        while at > floor:
            lo = max(floor, at - (1 << 16))
            f.seek(lo)
            data = f.read(at - lo)
            place = len(data)
            while (place := data.rfind(b"\n", 0, place)) >= 0:
                left -= 1
                if not left:
                    return lo + place + 1
            at = lo
    return floor


def ranges(path: str, start: int, end: int, size: int = RANGE) -> list[tuple[str, int, int, int]]:
    """(path, first byte that counts, from, to) of each piece of a file."""
    return [(path, start, lo, min(lo + size, end)) for lo in range(start, end, size)]


def _ends(data: bytes, odd: int, quotes: bool) -> tuple[np.ndarray, int]:
    """Places of the line ends, with ``quotes`` only of those outside quotes, and whether quotes are open behind."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    if quotes:
        open_ = (np.cumsum(raw == 34) + odd) & 1
        ends, odd = ends[open_[ends] == 0], int(open_[-1])
    return ends, odd


def _origin(first: int, lo: int) -> int:
    """Where reading for the lines that begin at ``lo`` or later starts: the byte before tells whether one begins there."""
    return lo if lo == first else lo - 1


def lines_in(fs: pafs.FileSystem, path: str, first: int, lo: int, hi: int, odd: int | None = None, step: int = STEP) -> Iterator[tuple[list[int], list[bytes]]]:
    """Positions and bytes of the lines that begin at ``lo`` or later and before ``hi``, without their line ends.

    A line belongs to the range it begins in, so neighbouring ranges share none and miss none. ``first``: where reading
    of the file begins; a line begins there. The last line counts without a line end too. ``odd``: whether quotes are
    open where reading starts, and then line ends inside quotes end no line; None for text without quotes.
    """
    with fs.open_input_file(path) as f:
        begin = at = _origin(first, lo)
        f.seek(at)
        held, skip, state = [], lo != first, odd or 0  # a line that goes on into this range is the one before's
        while data := f.read(step):
            places, lines, cut = [], [], 0
            ends, state = _ends(data, state, odd is not None)
            for end in ends.tolist():
                if not skip and begin < hi:
                    places.append(begin)
                    lines.append(b"".join([*held, data[cut:end]]))
                held, skip, cut = [], False, end + 1
                begin = at + cut
            if not skip:
                held.append(data[cut:])
            at += len(data)
            if lines:
                yield places, lines
            if begin >= hi or (skip and at >= hi - 1):
                return
        if any(held) and begin < hi:
            yield [begin], [b"".join(held)]


def _counts(fs: pafs.FileSystem, path: str, first: int, lo: int, hi: int, quotes: bool, step: int = STEP) -> tuple[int, int, int]:
    """Quotes in a range, and the lines that begin in it if quotes are closed or open where it starts."""
    marks, begun = 0, [int(lo == first), int(lo == first)]
    with fs.open_input_file(path) as f:
        left = hi - 1 - _origin(first, lo)
        f.seek(_origin(first, lo))
        while left > 0 and (data := f.read(min(step, left))):
            left -= len(data)
            raw = np.frombuffer(data, np.uint8)
            for odd in (0, 1) if quotes else (0,):
                begun[odd] += len(_ends(data, (odd + marks) & 1, quotes)[0])
            marks += int((raw == 34).sum()) if quotes else 0
    return marks, *begun


def read_lines(spark: SparkSession, path: str, quotes: bool = False, size: int = RANGE, encoding: str = "utf-8") -> DataFrame:
    """file, line (from 1), position (bytes), value: the lines of all files that Spark finds under a path or pattern.

    Each task reads ranges of bytes, whatever the size of a file. Lines are counted per range first; their sums give
    the number of a range's first line. With ``quotes`` a line end inside double quotes ends no line: the quotes are
    counted along, so every range knows whether it starts inside. Works for encodings that keep ASCII bytes.
    """
    found = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).where("bytes > 0")
    todo = found.select("file", F.lit(0).cast("long").alias("first"), "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("lo"))
    todo = todo.select("file", "first", "lo", F.least(F.col("lo") + size, F.col("bytes")).alias("hi"))
    n, whole = todo.agg(F.count("*"), F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()
    tasks = min(max(min(n, PARALLEL), -(-whole // RANGE), 1), TASKS)  # small ranges share a task

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                n = _counts(*file_system(p["file"]), p["first"], p["lo"], p["hi"], quotes)
                yield pa.RecordBatch.from_pylist([{**p, "marks": n[0], "closed": n[1], "open": n[2]}])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                fs, inner = file_system(p["file"])
                number = p["before"] + 1
                for places, lines in lines_in(fs, inner, p["first"], p["lo"], p["hi"], p["odd"] if quotes else None):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([p["file"]] * len(lines)), pa.array(range(number, number + len(lines)), pa.int64()), pa.array(places, pa.int64()), pa.array([x.decode(encoding, "replace") for x in lines], pa.string()),
                    ], ["file", "line", "position", "value"])
                    number += len(lines)

    place = "file string, first long, lo long, hi long"
    earlier = Window.partitionBy("file").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counted = todo.repartitionByRange(tasks, "file", "lo").mapInArrow(count, f"{place}, marks long, closed long, open long")
    counted = counted.withColumn("odd", F.coalesce(F.sum("marks").over(earlier), F.lit(0)) % 2)
    counted = counted.withColumn("before", F.coalesce(F.sum(F.when(F.col("odd") == 0, F.col("closed")).otherwise(F.col("open"))).over(earlier), F.lit(0)))
    counted = counted.select("file", "first", "lo", "hi", F.col("odd").cast("int").alias("odd"), "before")
    return counted.repartitionByRange(tasks, "file", "lo").mapInArrow(read, "file string, line long, position long, value string")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, size: int = RANGE, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A CSV table whose quoted cells may hold line ends, read by ranges of bytes; an empty cell is NULL."""
    lines = read_lines(spark, path, True, size, encoding)
    lines = lines.where("line > 1") if header else lines
    options = {"sep": sep, "escape": '"', "nullValue": "", "mode": "PERMISSIVE", "multiLine": "true"}
    return lines.select(F.from_csv(F.regexp_replace("value", r"\r$", ""), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), options).alias("row")).select("row.*")


def heads(spark: SparkSession, path: str, size: int) -> DataFrame:
    """path, head: the first ``size`` bytes of each file; no more of it is read."""
    files = spark.read.format("binaryFile").load(path).select("path")  # without the content column no file is opened

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, inner = file_system(name)
                with fs.open_input_file(inner) as f:
                    yield pa.RecordBatch.from_pylist([{"path": name, "head": f.read(size)}])

    return files.mapInArrow(read, "path string, head binary")

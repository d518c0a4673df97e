"""Source divergence audit: how far apart the sources of a language are in their use of its terms.

Every kept term of a language is one row: its nonzero counts by source, in source order. A source that lacks the term
has a share that depends on the source alone, so the distance of two sources is what it would be without any count,
corrected for each nonzero count by itself, and corrected again for each pair of nonzero counts in one row. The pair
corrections come from a frequent-pattern tree: rows are inserted with their multiplicities, rows that begin alike share
a path, and each node is set against each of its ancestors once, whatever the number of rows through it.

The rows are sorted and divided by range, so rows that begin alike stand together, and a beginning that many rows have
may be divided: it is then a path in several trees, which changes no sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.stored import stored
from millrace.llm.text import byte_table, slices

#: Terms are letters of ASCII and everything outside ASCII: [^\x00-\x40\x5B-\x60\x7B-\x7F]+
_OUTSIDE = byte_table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_SPACES = bytes(0x20 if _OUTSIDE[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Different terms by group that a task counts before it hands them on.
HELD = 300_000
#: Cells of one tree.
CELLS = 200_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have the term); several rows each, to be added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, having) in found.items():
                terms = list(n)
                for lo in range(0, len(terms), 50_000):
                    part = terms[lo:lo + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()), pa.array([having[t] for t in part], pa.int64()),
                    ], ["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch, texts in slices(batches):
            for key, text in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()), texts):
                terms = text.translate(_SPACES).split()
                n, having = found.setdefault(key, (Counter(), Counter()))
                held -= len(n)
                n.update(terms)
                having.update(set(terms))
                held += len(n)
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, width: str) -> Column:
    """1 + floor(10^9 * (count + 5) / width), in whole numbers."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 5 as decimal(20, 0))) div cast({width} as decimal(20, 0))")


def pair_corrections(lang: np.ndarray, first: np.ndarray, source: np.ndarray, p: np.ndarray, z: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the pair corrections of sorted rows, by language and pair of sources: lang, ancestor, node, value.

    Row i is a path: cells ``first[i]`` to ``first[i + 1]`` hold its sources in order, their shares ``p`` and their
    shares without any count ``z``; it counts ``times[i]`` times. Rows that begin alike must stand together.
    """
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    depth = np.arange(len(row)) - first[row]
    above = np.maximum(first[np.maximum(row - 1, 0)] + depth, 0)
    same = (row > 0) & (depth < size[np.maximum(row - 1, 0)])
    above = np.where(same, above, 0)
    same &= (lang[row] == lang[np.maximum(row - 1, 0)]) & (source[above] == source) & (p[above] == p)
    parted = np.cumsum(~same)
    fresh = parted - (parted[first[row]] - ~same[first[row]]) > 0  # unlike the row above from here on: a node of its own
    order = np.lexsort((row, depth))
    node = np.empty(len(row), np.int64)
    node[order] = np.cumsum(fresh[order]) - 1  # other cells stand in the node of the row above
    n = int(fresh.sum())
    cell = np.empty(n, np.int64)
    cell[node[fresh]] = np.flatnonzero(fresh)
    through = np.zeros(n, np.int64)
    np.add.at(through, node, times[row])
    parent = np.where(depth[cell] > 0, node[np.maximum(cell - 1, 0)], -1)
    keys, values = [], []
    here, up = np.arange(n), parent
    while True:
        here, up = here[up >= 0], up[up >= 0]
        if not len(here):
            break
        a, b = cell[up], cell[here]
        change = np.abs(p[a] - p[b]) - np.abs(p[a] - z[b]) - np.abs(z[a] - p[b]) + np.abs(z[a] - z[b])
        keys.append(np.stack([lang[row[b]], source[a], source[b]], 1))
        values.append(change * through[here])
        up = parent[up]
    if not keys:
        return (np.zeros(0, np.int64),) * 4
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.lexsort(key.T[::-1])
    key, value = key[order], value[order]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    return (*key[start].T, np.add.reduceat(value, start))


def _tree_sums(rows: DataFrame) -> DataFrame:
    """lang, source, other, value from rows of (lang, path, times), which come sorted; several rows a pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("path")).to_numpy().astype(np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = lo + max(int(np.searchsorted(np.cumsum(size[lo:]), CELLS, "right")), 1)
                part = batch.slice(lo, hi - lo)
                path = part.column("path").flatten()
                source, lang = path.field("source").dictionary_encode(), part.column("lang").dictionary_encode()
                number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(size[lo:hi])])
                k, a, b, v = pair_corrections(number(lang.indices), first, number(source.indices), number(path.field("p")), number(path.field("z")), number(part.column("times")))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(k)), source.dictionary.take(pa.array(a)), source.dictionary.take(pa.array(b)), pa.array(v, pa.int64())], ["lang", "source", "other", "value"])
                lo = hi

    return rows.mapInArrow(run, "lang string, source string, other string, value long")


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of sources and their most typical terms.

    Needs text, lang and source; null is ''. Terms are runs of letters, A-Z lower-cased; a language keeps the terms in
    at least ``least`` of its rows. In every (lang, source) and in the language a kept term has the share
    1 + floor(10^9 * (count + 5) / (N + 5 V)). Part ``pair``: every other source of the language and the sum of the
    shares' differences over all kept terms, 0 without any. Part ``term``: the ``top`` kept terms that the source has
    and uses most above the language's share. Ranks go by value, the larger first, then by item. All numbers are exact.

    Repeated rows count as often as they occur. Groups without any term take part. An empty table gives no rows, a
    source alone in its language no pairs. Other columns are not looked at, texts are read whole.
    """
    docs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    # a task adds its counts up itself; one term has a row per task and source at most until they are added here
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("row"))
    rows = stored(rows.where(F.col("docs") >= least).select("lang", "term", "total", "row"), "terms")
    cells = rows.select("lang", "term", "total", F.inline("row"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    whole = rows.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("own", F.lit(0)) + 5 * F.col("kept")).alias("width"), (F.col("whole") + 5 * F.col("kept")).alias("lang_width"))
    groups = stored(groups.withColumn("z", F.coalesce(_share("0L", "width"), F.lit(0))), "groups")  # one row per group
    shares = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "width").alias("p"), "z", _share("total", "lang_width").alias("q"))
    shares = stored(shares, "shares")

    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("far"))
    alone = shares.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("times")).join(other, "lang").where("source <> other")
    alone = alone.groupBy("lang", "source", "other").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("far")) - F.abs(F.col("z") - F.col("far")))).alias("value"))
    paths = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("path")).where(F.size("path") > 1)
    paths = stored(paths.groupBy("lang", "path").agg(F.count("*").alias("times")), "paths")
    tree = _tree_sums(paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path"))
    sums = alone.unionByName(tree).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    both = both.groupBy("lang", "source", "other").agg(F.sum("value").alias("change"))
    pairs = groups.join(other, "lang").where("source <> other").join(both, ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("kept") * F.abs(F.col("z") - F.col("far")) + F.coalesce("change", F.lit(0))).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(rank)).unionByName(terms)

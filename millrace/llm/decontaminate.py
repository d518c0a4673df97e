"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame functions only.

An item's windows (13 consecutive words, or the whole item if shorter) must be contained in a document in full. So any
one shingle of a window is necessary; the join uses the one that is rarest in the documents. A document's place whose
shingle equals a window's rarest one fixes where the window would begin (position) and end (length); only if both lie
inside the document are the words compared in full. Windows are joined in blocks of bounded size, so that each
broadcast is small whatever the size of the benchmark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import ascii_lower
from millrace.session import cut_lineage

#: Between words, which are runs of digits, letters and characters outside ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, none for null; A-Z is lower-cased first."""
    return F.filter(cells(ascii_lower(text)), lambda w: w != "")


def cells(text: Column) -> Column:
    """The words, with an empty one at an end where the text has separators; for long texts, where a filter costs."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def word_count(text: Column) -> Column:
    c = cells(text)
    n = F.size(c)
    return (n - (F.get(c, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(c, n - 1) == "")).cast("int")).cast("long")


def folded(text: Column) -> Column:
    """The cells with all letters lower-cased, which is much faster: as many in the same places, and equal where those
    with A-Z lower-cased are. (A capital sigma's lower case depends on its neighbours, so it is replaced first.)"""
    return cells(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u03a3"), F.lit("\u03c3"))))


def _fold_words(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.lower(F.replace(w, F.lit("\u03a3"), F.lit("\u03c3"))))


def _shingle(ws: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from place ``at`` (0-based); null where fewer are left."""
    return F.when(at + size <= F.size(ws), F.xxhash64(*(F.get(ws, at + i) for i in range(size))))


def windows(items: DataFrame, length: int) -> DataFrame:
    """window (its words joined by a space), n, ws, items: the distinct windows and the items that hold them."""
    w = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    cut = w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i") + 1, F.lit(length)).alias("ws"))
    return cut.select("item_id", "ws", F.array_join("ws", " ").alias("window")).distinct()


def occurrences(docs: DataFrame, items: DataFrame, length: int = 13, shingle: int = 3, block: int = 50_000, key: str = "doc_key") -> DataFrame:
    """key, start, n, window: every place of a window in a document. ``docs`` has ``key``, which names a document, and text."""
    held = cut_lineage(windows(items, length))
    wins = held.select("window", _fold_words(F.col("ws")).alias("ws")).distinct().withColumn("size", F.least(F.size("ws"), F.lit(shingle)))
    sizes = [r["size"] for r in wins.select("size").distinct().collect()]  # at most ``shingle`` rows
    if not sizes:
        return docs.select(key, F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("window")).where("false")
    parts = [
        wins.where(F.col("size") == s).select("window", F.array_join("ws", " ").alias("folded"), "size", F.size("ws").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("ws") - s), lambda i: _shingle(F.col("ws"), i, s))).alias("at", "shingle"))
        for s in sizes
    ]
    grams = cut_lineage(reduce(DataFrame.unionByName, parts))
    places = docs.select(key, "text", folded(F.col("text")).alias("w"))
    each = places.select(key, "text", "w", F.posexplode("w").alias("pos", "first")).drop("first")

    def blocks(df: DataFrame) -> list[DataFrame]:
        n = max(-(-df.count() // block), 1)
        return [df.where(F.pmod(F.xxhash64("shingle"), F.lit(n)) == i).drop("slot") for i in range(n)] if n > 1 else [df]

    # how often each shingle of a window stands in the documents, zero where it doesn't
    distinct = cut_lineage(grams.select("size", "shingle").distinct())
    seen = []
    for s in sizes:
        for part in blocks(distinct.where(F.col("size") == s).select("shingle")):
            found = each.select(_shingle(F.col("w"), F.col("pos"), s).alias("shingle")).join(F.broadcast(part), "shingle", "left_semi")
            seen.append(found.groupBy("shingle").agg(F.count("*").alias("often")).withColumn("size", F.lit(s)))
    counts = cut_lineage(reduce(DataFrame.unionByName, seen))
    ranked = grams.join(counts, ["size", "shingle"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    order = Window.partitionBy("window").orderBy("often", "shingle", "at")  # a window has at most ``length`` shingles
    prefix = cut_lineage(ranked.withColumn("r", F.row_number().over(order)).where("r = 1 AND often > 0").select("window", "folded", "size", "n", "at", "shingle"))
    out = []
    for s in sizes:
        for part in blocks(prefix.where(F.col("size") == s).select("window", "folded", "n", "at", "shingle")):
            place = each.select(key, "text", "w", "pos", _shingle(F.col("w"), F.col("pos"), s).alias("shingle"))
            start = F.col("pos") - F.col("at")
            near = place.join(F.broadcast(part), "shingle").where((start >= 0) & (start + F.col("n") <= F.size("w")))
            near = near.where(F.array_join(F.slice("w", start + 1, F.col("n")), " ") == F.col("folded"))
            near = near.where(F.array_join(F.slice(cells(ascii_lower(F.col("text"))), start + 1, F.col("n")), " ") == F.col("window"))  # letters outside ASCII by case, for the few that are left
            out.append(near.select(key, start.alias("start"), "n", "window"))
    return reduce(DataFrame.unionByName, out)


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, percent: int = 5, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) with n_words, n_hit, n_items, items_sha256 and contaminated.

    n_hit: words inside an occurrence of a window; n_items: items with such a window; items_sha256: hash of their
    item_ids, sorted as strings, comma-joined; contaminated: n_hit > 0 and at least ``percent`` % of the words are hit.
    Null and empty texts have no words and are clean. Items without words have no window, items of null id count as
    the id "null"; an item that occurs twice counts once. Rows alike in doc_id and text get equal results, each in its
    own row. Input columns named like a result are replaced. With an empty benchmark all rows are clean.
    """
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = docs.drop(*made, "__doc_key")
    docs = docs.withColumn("__doc_key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.xxhash64("text", F.lit(1)).alias("hash2")))
    found = cut_lineage(occurrences(docs.select("__doc_key", "text").where("text IS NOT NULL"), items, length, shingle, key="__doc_key").distinct())
    until = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("__doc_key").orderBy("start", "n", "window").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("n")
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(until, F.lit(0))), F.lit(0))
    hits = found.select("__doc_key", "start", "n", "window").withColumn("fresh", fresh).groupBy("__doc_key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    held = windows(items, length).select("window", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")).distinct()
    named = found.select("__doc_key", "window").distinct().join(held, "window").select("__doc_key", "item").distinct()
    named = named.groupBy("__doc_key").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("list"))
    marks = hits.join(named, "__doc_key")
    none = F.sha2(F.lit("").cast("binary"), 256)
    counted = docs.withColumn("n_words", word_count(F.col("text"))).join(marks, "__doc_key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    return counted.select(
        *(f"`{c}`" for c in docs.columns if c != "__doc_key"), "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.col("list").cast("binary"), 256), none).alias("items_sha256"), ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )

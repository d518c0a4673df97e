"""Near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Rows of equal shingle sets form one class, represented by its smallest doc_id. Each class gets ``bands * rows`` bins
from a single hash per shingle; empty bins borrow from bins drawn by a hash (optimal densification). Members of a bucket
are linked with the bucket's smallest member only, so a bucket of m classes gives m - 1 candidates. Members that turn
out not to be similar to that centre get others, and what is left apart goes through an exact join. Every candidate is
confirmed on the full sets. Components come from label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.stored import stored
from millrace.llm.text import SPACED, Texts, mix, slices

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_ATTEMPTS = 64
#: A key with more than one row in so many is hot.
HOT = 2000
#: Copies of the right row of a hot key.
SALTS = 256


def _kept(df: DataFrame) -> DataFrame:
    """The rows as a table. A checkpoint would keep the optimizer's guess of their size, a product over all joins before;
    after some rounds that number alone takes longer than the work."""
    return stored(df, "near")


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    t = Texts(texts, SPACED, lower=True)
    word, bounds = t.hashes(), t.bounds()
    roll = np.zeros(len(word), np.uint64)
    for n in range(words):
        roll[:max(len(word) - n, 0)] = roll[:max(len(word) - n, 0)] * _STEP + word[n:]
    roll = mix(roll)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= words:
            out.append(np.unique(roll[lo:hi - words + 1]))
        elif hi > lo:
            one = np.array([hi - lo], np.uint64)
            for x in word[lo:hi]:
                one = mix(one * _STEP + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _donors(bins: int, which: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """The bins that each empty bin asks, in order, from its ``first`` question on; the same in every set."""
    which = np.arange(bins) if which is None else which
    seeds = (which.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(first, first + _ATTEMPTS, dtype=np.uint64)
    return (mix(seeds * _STEP + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int, donors: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin of the hash range; an empty bin takes the value of the first full bin it asks.

    It asks until it meets one, so the donor depends on which bins are full and not on how many are.
    """
    own = (((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    full, first = np.unique(own, return_index=True)
    out, has = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[full], has[full] = shingles[first], True
    empty, asked = np.flatnonzero(~has), 0
    if len(full) == 1:
        out[:], empty = shingles[0], empty[:0]
    while len(empty):
        ask = donors[empty] if not asked else _donors(bins, empty, asked)
        found = has[ask]
        met = found.any(1)
        out[empty[met]] = out[ask[met, found[met].argmax(1)]]
        empty, asked = empty[~met], asked + _ATTEMPTS
    return out


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit name of the set) and the bands' keys, null without shingles."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        donors, band = _donors(bins), np.arange(bands, dtype=np.uint64)
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, words)
            keys, names = [], []
            for s in sets:
                if not len(s):
                    keys.append(None)
                    names.append((None, None))
                    continue
                table, key = signature(s, bins, donors).reshape(bands, rows), band * _STEP
                for r in range(rows):
                    key = mix(key * _STEP + table[:, r])
                keys.append(key.view(np.int64))
                names.append((int(mix(s).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s * _STEP)).view(np.int64))))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array(keys, pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, shingles: the whole sets of the named documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(texts, words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(run, "id long, shingles array<long>")


def _confirmed(sets: DataFrame, edges: DataFrame, percent: int, per_salt: int = 256) -> DataFrame:
    """The candidate edges (a, b) with ``linked``: whether their full sets are similar enough. A centre's set is
    copied once per ``per_salt`` of its edges, so that no task gets all edges of a centre."""
    salts = edges.groupBy("a").agg(F.ceil(F.count("*") / per_salt).alias("salts"))
    left = sets.join(salts, F.col("id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("shingles").alias("set_a"))
    right = edges.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    right = right.join(sets, F.col("b") == F.col("id")).select("a", "b", "salt", F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return right.join(left, ["a", "salt"]).select("a", "b", (100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).alias("linked"))


def _dealt(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Join rows (with ``id``) with the one row of their key, whose column ``count`` says how many rows the key has. Rows
    of a key with more than a 2000th of all rows, so of at most 2000 keys, are dealt by id over ``SALTS`` copies of its
    row. Every row takes part in one join, so the join gives no more rows than there are."""
    right = _kept(right)
    limit = max((right.agg(F.sum(count)).first()[0] or 0) // HOT, 256)
    hot = [r[0] for r in right.where(F.col(count) > limit).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    often = F.expr(f"coalesce({key} IN ({', '.join(map(str, hot))}), false)")
    left = left.withColumn("dealt", F.when(often, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0))
    right = right.withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(often, F.lit(SALTS - 1)).otherwise(0).cast("long"))))
    return left.join(right, [key, "dealt"], how).drop("dealt")


def _stars(members: DataFrame) -> DataFrame:
    """Members of each bucket beside its smallest one, the centre; buckets of one are gone."""
    centres = members.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count("*").alias("held")).where("centre < last").drop("last")
    return _dealt(members, centres, "key", "held").where("id <> centre").select("key", "id", "band", "centre")


def _apart(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges whose ends are not known to be in one component."""
    for end in "ab":
        edges = edges.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    return edges.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _undecided(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id: all members, the centre too, of the buckets of three or more whose members are not in one component.
    In a bucket of two the only pair is the star's."""
    own, far = labels.select("id", "label"), labels.select(F.col("id").alias("centre"), F.col("label").alias("far"))
    rest = stars.join(own, "id", "left").join(far, "centre", "left").withColumn("apart", F.coalesce("label", "id") != F.coalesce("far", "centre"))
    torn = rest.groupBy("key").agg(F.min("centre").alias("centre"), F.bool_or("apart").alias("apart"), F.count("*").alias("n")).where("apart AND n > 1")
    return _kept(stars.join(torn.select("key"), "key", "left_semi").select("key", "id").unionByName(torn.select("key", F.col("centre").alias("id"))))


def _hubs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (a, b) from the member of each bucket that has most links, a, to the others. An original is linked to many
    of its copies, whatever its doc_id, while copies may be linked to nothing else."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    best = members.join(degree, "id", "left").groupBy("key").agg(F.max(F.when(F.col("degree").isNotNull(), F.struct("degree", (-F.col("id")).alias("minus")))).alias("best"), F.count("*").alias("held"))
    best = best.where("best IS NOT NULL").select("key", (-F.col("best.minus")).alias("hub"), "held")
    return _dealt(members, best, "key", "held").select(F.col("hub").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()


def _untried(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges (a, b) not yet confirmed or refused, once each."""
    tried = known.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    once = edges.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).dropDuplicates(["low", "high"])
    return once.join(tried, ["low", "high"], "left_anti").select("a", "b")


def _rivals(rows: DataFrame, score: Column) -> DataFrame:
    """cell, first, most, next: each cell's largest score, the label that has it, and the largest among its other labels."""
    each = rows.groupBy("cell", "label").agg(F.max(score).alias("score"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), "label"))
    two = each.withColumn("i", place).where("i <= 2")
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    return two.groupBy("cell").agg(at(1, "label").alias("first"), at(1, "score").alias("most"), at(2, "score").alias("next"))


def _sides(sets: DataFrame, ids: DataFrame, percent: int, per_salt: int = 256) -> tuple[DataFrame, DataFrame]:
    """The rows x and y of ``ids`` (id, label) that meet on cell, salt and own: of the pairs with different labels that can
    be similar enough, by prefix, length and position, none is missing.

    With the shingles of all sets in one order, the rarest first, two similar sets x and y, x not the larger, share one
    of the first n - ceil(n * 2p / (100 + p)) + 1 of x and the first n - ceil(n * p / 100) + 1 of y. After their first
    common shingle, at i and j, at most min(n_x - i, n_y - j) more can be common. So a set's ``reach`` at a shingle is the
    size beyond which no other is similar enough, and a pair has n_x <= n_y <= reach_x and n_x <= reach_y. Members of a
    family have their own shingles first and the family's beyond the shorter prefix, so unlike ones seldom meet.

    Pairs of one shingle would be as many as the square of a family. Rows go to cells, of a shingle and a range of sizes:
    y to its own, x to those from its size to its reach. An x stays only if its cell has a y of another label that reaches
    it, a y only if it reaches an x of another label that stayed. Of what stays, the pairs within the label that reaches
    farthest in a cell don't meet.
    """
    each = sets.join(ids, "id").select("id", "label", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    order = Window.partitionBy("id").orderBy(F.coalesce("often", F.lit(1)), "shingle")  # one document's set
    ranked = _dealt(each, often, "shingle", "often", "left").withColumn("r", F.row_number().over(order).cast("long"))
    reach = F.floor((100 * F.col("n") - (100 + percent) * (F.col("r") - 1)) / percent)
    prefix = ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & F.col("often").isNotNull())
    prefix = _kept(prefix.select("id", "label", "n", reach.alias("reach"), "shingle"))
    band = lambda n: F.floor(F.log(F.col(n)) / F.log(F.lit(1.05)))
    cell, columns = F.xxhash64("shingle", "band").alias("cell"), ("id", "label", "n", "reach")
    y = prefix.withColumn("band", band("n")).select(cell, *columns)
    x = prefix.where("n <= reach").withColumn("band", F.explode(F.sequence(band("n"), band("reach")))).select(cell, *columns)
    reached = _rivals(y, F.col("reach")).join(x.groupBy("cell").agg(F.count("*").alias("held")), "cell")
    x = _dealt(x, reached, "cell", "held").where(F.when(F.col("label") != F.col("first"), F.col("most")).otherwise(F.col("next")) >= F.col("n"))
    x = _kept(x.select("cell", *columns, F.col("first").alias("main")))
    sizes = x.groupBy("cell").agg(F.ceil(F.count("*") / per_salt).alias("salts"), F.count("*").alias("shorts"), F.max("main").alias("main"))
    met = _kept(_rivals(x, -F.col("n")).join(sizes, "cell"))
    y = _dealt(y, met.drop("shorts").join(y.groupBy("cell").agg(F.count("*").alias("held")), "cell"), "cell", "held")
    y = y.where(-F.when(F.col("label") != F.col("first"), F.col("most")).otherwise(F.col("next")) <= F.col("reach"))
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("own", F.col("label") == F.col("main"))
    x = _dealt(x, met.select("cell", "salts", "shorts"), "cell", "shorts").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    x = x.withColumn("own", F.explode(F.when(F.col("label") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    return tuple(side.select("cell", "salt", "own", *(F.col(c).alias(f"{c}_{s}") for c in columns)) for side, s in ((x, "x"), (y, "y")))


def _exact_candidates(sets: DataFrame, ids: DataFrame, percent: int, per_salt: int = 256) -> DataFrame:
    """All pairs (a, b) of ``ids`` with different labels that can be similar enough; none that is similar enough is missing."""
    x, y = _sides(sets, ids, percent, per_salt)
    fits = (F.col("label_x") != F.col("label_y")) & F.col("n_y").between(F.col("n_x"), F.col("reach_x")) & (F.col("n_x") <= F.col("reach_y"))
    return x.join(y, ["cell", "salt", "own"]).where(fits).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def linked_components(docs: DataFrame, sketches: DataFrame, words: int, percent: int, exact: int | None = 40, first: int = 8) -> DataFrame:
    """id, label: the components of the class representatives that have a confirmed link.

    The stars of the first bands join most of each group. After that only candidates between different components are
    worth confirming, so a large group of near copies costs a few candidates per member, not one per band. Members of a
    bucket in several components are also compared with the one among them that has most links. Among the members of
    buckets that are in several components even then, linked or not, and among all sets of up to ``exact`` shingles and
    what can be similar to them, a prefix-filtered join on their full sets finds every link that is missing.
    """
    classes = sketches.where("bands IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"))
    small = classes.where("true" if exact is None else f"100 * {exact} >= {percent} * n").select("id")
    members = sketches.join(classes, (F.col("doc_id") == F.col("id")) & (sketches["set_a"] == classes["set_a"]) & (sketches["set_b"] == classes["set_b"]))
    stars = _kept(_stars(members.select("id", F.posexplode("bands").alias("band", "key"))))
    ids = stars.select("id").unionByName(stars.select(F.col("centre").alias("id"))).unionByName(small).distinct()
    sets = _kept(_full_sets(docs, ids, words).dropDuplicates(["id"]))
    pairs = lambda s: s.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    early = _kept(_confirmed(sets, pairs(stars.where(F.col("band") < first)), percent))
    labels = components(early.where("linked").select("a", "b"))
    torn = _undecided(stars, labels)
    tried = _apart(pairs(stars).unionByName(_hubs(torn, early.where("linked"))), labels)
    known = early.unionByName(_kept(_confirmed(sets, _kept(_untried(tried, early)), percent)))
    labels = components(known.where("linked").select("a", "b"))
    left = _undecided(stars, labels).select("id").unionByName(small).distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    last = _kept(_untried(_exact_candidates(sets, _kept(left), percent), known))
    known = known.unionByName(_kept(_confirmed(sets, last, percent)))
    return components(known.where("linked").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that each id reaches. Labels spread over the edges, then jump to their label's label;
    they only fall, so they are final when their sum stays.

    Centres of stars and labels of large components would each be one join key with many rows. Those with more than one
    row in 2000 are at most that many, and take part by broadcast.
    """
    spark = edges.sparkSession
    both = _kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = _kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("edges")))
    size = labels.agg(F.coalesce(F.sum("edges"), F.lit(0)), F.count("*")).first()
    limit = max(size[0] // HOT, 256)
    hubs = labels.where(F.col("edges") > limit).select("id").collect()
    hubs = F.broadcast(spark.createDataFrame(hubs, "id long")) if hubs else None
    others = both.join(hubs, both["b"] == hubs["id"], "left_anti") if hubs is not None else both
    to_hubs = both.join(hubs, both["b"] == hubs["id"], "left_semi") if hubs is not None else None
    labels, total = labels.select("id", "label"), None
    while True:
        near = others.join(labels, F.col("b") == F.col("id")).select("a", "label")
        if hubs is not None:
            near = near.unionByName(to_hubs.join(F.broadcast(labels.join(hubs, "id")), F.col("b") == F.col("id")).select("a", "label"))
        near = near.groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        large, jumped = [], None
        if size[1] > limit:
            spread = _kept(spread)
            large = spread.groupBy("label").count().where(F.col("count") > limit).select("label").collect()
        if large:
            large = F.broadcast(spark.createDataFrame(large, "via long"))
            jumped = spread.join(F.broadcast(jump.join(large, "via")), F.col("label") == F.col("via"))
            spread = spread.join(large, F.col("label") == F.col("via"), "left_anti")
        out = spread.join(jump, F.col("label") == F.col("via"), "left")
        out = out.unionByName(jumped) if jumped is not None else out
        labels = _kept(out.select("id", F.least("label", "far").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, exact: int | None = 40) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per row of ``docs`` (columns doc_id, text).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. Two documents are linked when their shingle
    sets' Jaccard similarity is at least ``percent`` / 100; component_id is the smallest doc_id in reach, and kept the
    row that has it. Null, empty and word-less texts have no shingles and stand alone. Rows without doc_id stand alone
    too: component_id null, kept. Repeated doc_ids are one document with several texts. A pair of similarity s meets in
    some bucket with probability 1 - (1 - s**rows)**bands: over 0.99999 at 0.8. Components lose no link between
    documents that meet. Sets of up to ``exact`` shingles are also joined exactly, so they lose no link at all; None
    joins all sets so, at the cost of a prefix of every set.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = _kept(_sketches(docs, words, bands, rows))
    linked = linked_components(docs, sketches, words, percent, exact)
    whole = sketches.where("bands IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_a", "set_b")
    classes = whole.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"))
    named = _kept(classes.join(linked, "id", "left").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), F.coalesce("label", "id").alias("component_id")))
    found = whole.join(named, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b"))).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("bands IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

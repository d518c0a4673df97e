"""Token counts kept by deltas: signed inserts, deletes and revised counts add to totals by source, language, tokenizer.

A batch is aggregated to one signed row per group and written once under its id; a batch whose id is already committed
changes nothing, so a job can be run again after any failure. Totals are sums over the committed batches, so order does
not matter. ``compact`` folds the batches into one table that names them; such tables have names of their own, which no
batch id can take.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import byte_texts
from millrace.llm.tokens import encoder

GROUP = ["source", "lang", "tokenizer"]
ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batches array<string>"


def count_words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def count_bytes(text: Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def count_ids(docs: DataFrame, vocabulary: str, spaced: bool, name: str = "n_tokens") -> DataFrame:
    """The rows with the number of ids that a tokenizer file gives; null texts have none. Needs ``text``. An input column
    of the result's name is replaced, repeated rows count alike, an empty table gives no rows."""
    schema = docs.drop(name).schema.add(name, "long")
    keep = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, spaced).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([len(encode(t.decode("utf-8", "replace"))) // 4 for t in byte_texts(batch)], pa.int64())], [*keep, name])

    return docs.mapInArrow(run, schema)


def inserts(counts: DataFrame) -> DataFrame:
    """Changes for new documents: source, lang, tokenizer and n_tokens, null counting as 0; other columns are left out.
    Every row is a document, repeated ones too; no rows, no changes."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes for documents that go, read like ``inserts``."""
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens"))


def revisions(counts: DataFrame, old: str = "old_tokens", new: str = "n_tokens") -> DataFrame:
    """A document stays, its count goes from ``old`` to ``new``; null counts as 0."""
    return counts.select(*GROUP, F.lit(0).cast("long").alias("docs"), (F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).cast("long").alias("tokens"))


class Rollup:
    """Totals in a folder that all executors can reach, a subfolder per committed batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"a batch id is made of letters, digits, - and _: {batch!r}")
        return f"{self.folder}/batch-{batch}"

    def _folders(self, kind: str) -> list[str]:
        """Names behind ``kind-`` of the folders whose data is complete."""
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        return sorted(n[len(kind) + 1:] for n in names if n.startswith(f"{kind}-") and self._files.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        return self._folders("batch")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit signed changes (source, lang, tokenizer, docs, tokens) under an id; False if that id is in already.

        Null source, language and tokenizer are groups of their own. The sums are written aside and moved into place
        in one step, so a run that dies half-way leaves nothing behind that counts. Of two runs that commit one id at
        the same time one is told False.
        """
        place = self._named(batch)
        if batch in self.committed():
            return False
        sums = changes.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).withColumn("batches", F.array(F.lit(batch)))
        return self._put(place, sums)

    def _put(self, place: str, rows: DataFrame) -> bool:
        aside = f"_aside-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{aside}")
        left = [f"{self.folder}/{aside}", f"{place}/{aside}"]  # some stores move a folder into one that stands there
        done = not self._files.exists(self._path(place)) and self._files.rename(self._path(left[0]), self._path(place)) and not self._files.exists(self._path(left[1]))
        for path in () if done else left:
            self._files.delete(self._path(path), True)
        return done

    def _read(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema(ROLLUP).parquet(*places) if places else self.spark.createDataFrame([], ROLLUP)

    def _live(self) -> tuple[list[str], list[str]]:
        """Folders that count, and the ids of all batches in them: compacted tables, the larger ones first, as long as
        they share no batch, and the batches that none of them holds."""
        packed = {}
        for name in self._folders("packed"):
            first = self._read([f"{self.folder}/packed-{name}"]).select("batches").first()  # the same list on every row
            packed[name] = set(first["batches"]) if first else set()
        places, held = [], set()
        for name in sorted(packed, key=lambda n: (-len(packed[n]), n)):
            if packed[name] and not packed[name] & held:
                places.append(f"{self.folder}/packed-{name}")
                held |= packed[name]
        rest = [b for b in self.committed() if b not in held]
        return places + [self._named(b) for b in rest], sorted(held.union(rest))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups whose documents are all gone are left out."""
        rows = self._read(self._live()[0])
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Fold all that counts into one table that names its batches; what it holds stays and no longer counts.

        Two runs at the same time may both succeed: their tables share batches, so only one of them counts.
        """
        places, names = self._live()
        if len(places) < 2:
            return False
        rows = self._read(places).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self._put(f"{self.folder}/packed-{uuid.uuid4().hex}", rows.withColumn("batches", F.array(*map(F.lit, names))))

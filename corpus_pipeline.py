"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is all that the stage before kept. All but the
last return the columns of documents, unchanged: an operator sees the id and the text beside the whole row, so a column
named like one of its results keeps its values. Between stages the rows are written to the shared folder as Parquet.

Rows of one doc_id and equal texts are judged alike, so all or none of them stay, and each is packed. Rows without a
doc_id are judged by their text alone. Null texts are empty: the first stage rejects them. Empty tables pass through.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, near_dedup, packing, quality_classifier
from millrace.llm.queries import remainder, rules
from millrace.session import shared_folder


def _beside(docs: DataFrame, *columns: str) -> DataFrame:
    """What an operator reads, and all other columns in one that no result is named like."""
    return docs.select(F.struct(F.lit(True).alias("_one"), *(f"`{c}`" for c in docs.columns if c not in columns)).alias("_row"), *columns)


def _columns(docs: DataFrame, *columns: str) -> list[Column]:
    """The columns of ``docs`` again, from a row of ``_beside``."""
    return [F.col(c) if c in columns else F.col("_row")[c].alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of fewer than 10 words, or with too much repetition, go."""
    return rules(_beside(docs, "text")).where("kept").select(*_columns(docs, "text"))


def quality_classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go; it learns from the labels of the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels, remainder(F.col("doc_id")) != 0)
    return quality_classifier.classify(_beside(docs, "text"), model).where("predicted = 1").select(*_columns(docs, "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at similarity 0.8 on five-word shingles the document of smallest id stays."""
    ids = near_dedup.near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least 5 % stand in benchmark windows go."""
    found = decontaminate.contamination(_beside(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*_columns(docs, "doc_id", "text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classify),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: The tokenizer, the classifier and the packing have no SQL; tests/llm checks the stages one by one.
ORACLE_SQL = None

#: Rows of one Arrow batch while a stage is written. Whole texts of 10,000 documents, Spark's default, are held in every task
#: several times over, outside the heap too.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows while jobs run inside; the session's own setting comes back."""
    given = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(int(given), BATCH_ROWS) if int(given) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, given)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    with small_batches(spark):
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
            docs = spark.read.parquet(f"{place}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)

"""Quality classifier: labelled documents vote for their nearest neighbours in a latent-semantic space.

Features are hashed word shapes, word ends, symbols and a few text-wide ratios, weighted by inverse document frequency
over all documents. The latent space is spanned by the leading eigenvectors of the weighted Gram matrix of all
documents, so it is the exact truncated singular value decomposition. Labelled vectors (a bounded sample) are broadcast,
and every document's cosines with all of them are computed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.merge import SCHEMA, pieces, total
from millrace.llm.text import SPACED, Texts, byte_table, mix, slices

WORD_BUCKETS, SHAPE_BUCKETS = 256, 192
#: Columns past the buckets: a constant, so that an empty text has a direction too, and text-wide ratios.
RATIOS = 24
FEATURES = WORD_BUCKETS + SHAPE_BUCKETS + RATIOS
#: Bytes by class: lower, upper, digit, outside ASCII, sentence marks, symbols, white space, others.
_CLASS = np.full(256, 7, np.uint8)
for _k, _ranges in enumerate(([(97, 122)], [(65, 90)], [(48, 57)], [(128, 255)], [(33, 33), (44, 44), (46, 46), (63, 63)], [(35, 38), (42, 43), (60, 62), (64, 64), (94, 96), (123, 126)], [(9, 13), (32, 32)])):
    _CLASS[byte_table(_ranges)] = _k
_STEP = np.uint64(0xA0761D6478BD642F)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of term frequencies (log scale) and ratios per text; whole texts."""
    t = Texts(texts, SPACED)
    out = np.zeros((t.n, FEATURES), np.float32)
    if len(t.start):
        kind = _CLASS[t.data]
        size = t.end - t.start
        hashes = t.hashes()
        word = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
        # a word's shape: class of its first byte, of its last three, and its length in steps
        shape = kind[t.start].astype(np.uint64)
        for back in (1, 2, 3):
            shape = shape * np.uint64(8) + kind[np.maximum(t.end - back, t.start)]
        shape = (mix(shape * np.uint64(16) + np.minimum(size // 3, 15).astype(np.uint64) + _STEP) % np.uint64(SHAPE_BUCKETS)).astype(np.int64)
        for column, shift in ((word, 0), (shape, WORD_BUCKETS)):
            counts = np.bincount(t.doc * FEATURES + column + shift, minlength=t.n * FEATURES).reshape(t.n, FEATURES)
            out += np.log1p(counts, dtype=np.float32)
        by_class = np.stack([t.per_text(kind == k) for k in range(8)], 1)
        n_bytes = np.maximum(by_class.sum(1) - 1, 1)
        words = np.bincount(t.doc, minlength=t.n)
        distinct = np.unique(mix(hashes + t.doc.astype(np.uint64) * _STEP), return_index=True)[1]
        seen = np.bincount(t.doc[distinct], minlength=t.n)
        base = WORD_BUCKETS + SHAPE_BUCKETS
        out[:, base + 1:base + 9] = 6 * np.sqrt(by_class / n_bytes[:, None])
        ends = np.bincount(t.doc, kind[t.end - 1] == 4, t.n)
        marks = np.bincount(t.doc, kind[t.end - 1] == 5, t.n)
        upper = np.bincount(t.doc, (kind[t.start] == 1) & (kind[np.minimum(t.start + 1, t.end - 1)] == 1), t.n)
        alone = np.bincount(t.doc, (size == 1) & (kind[t.start] >= 4), t.n)
        for i, x in enumerate((ends, marks, upper, alone)):
            out[:, base + 9 + i] = 8 * np.sqrt(x / np.maximum(words, 1))
        out[:, base + 13] = 6 * seen / np.maximum(words, 1)
        out[:, base + 14] = np.log1p(words)
        out[:, base + 15] = by_class[:, :6].sum(1) / np.maximum(words, 1) / 2
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (t.doc[1:] == t.doc[:-1])) + 1
        out[:, base + 17] = 12 * np.sqrt(np.bincount(t.doc[again], minlength=t.n) / np.maximum(words, 1))
        out[:, base + 18] = 8 * (1 - seen / np.maximum(words, 1)) ** 2
        out[:, base + 16] = 6 * by_class[:, 6] / n_bytes
    out[:, WORD_BUCKETS + SHAPE_BUCKETS] = 4
    return out


def _weights(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each feature, and all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FEATURES + 1)
        for _, texts in slices(batches):
            counts[:-1] += (features(texts) > 0).sum(0)
            counts[-1] += len(texts)
        yield pieces(counts, TaskContext.get().partitionId())

    found = total(docs.mapInArrow(run, SCHEMA), FEATURES + 1)
    return found[:-1], int(found[-1])


def _gram(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((FEATURES, FEATURES))
        for _, texts in slices(batches):
            x = _scaled(features(texts), idf)
            out += x.T @ x
        yield pieces(out, TaskContext.get().partitionId())

    return total(docs.mapInArrow(run, SCHEMA), FEATURES * FEATURES).reshape(FEATURES, FEATURES)


def _scaled(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = x * idf.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(vectors: np.ndarray, labelled: np.ndarray, labels: np.ndarray, k: int, power: float, block: int = 256) -> np.ndarray:
    """Similarity-weighted share of label 1 among each vector's k nearest labelled vectors."""
    out = np.full(len(vectors), labels.mean() if len(labels) else 0.5)
    if not len(labels):
        return out
    k = min(k, len(labels))
    for lo in range(0, len(vectors), block):
        sims = vectors[lo:lo + block] @ labelled.T
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** power
        mass = weight.sum(1)
        share = (weight * labels[near]).sum(1) / np.maximum(mass, 1e-12)
        out[lo:lo + block] = np.where(mass > 0, share, labels.mean())
    return out


class Model:
    """Inverse document frequencies, the latent projection, and the labelled vectors. A few MB, whatever the corpus."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int, power: float):
        self.idf, self.axes, self.vectors, self.labels, self.k, self.power = idf, axes, vectors, labels, k, power

    def project(self, texts: list[bytes]) -> np.ndarray:
        x = _scaled(features(texts), self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.clip(vote(self.project(texts), self.vectors, self.labels, self.k, self.power), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", most: int = 5000, axes: int = 48, k: int = 15, power: float = 4.0) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, label).

    Document frequencies and the latent space use every document and no label. Only rows where ``train`` holds lend
    their labels, at most ``most`` of them: those with the smallest hash of doc_id (so a fixed sample). Null labels
    and ids are left out; a doc_id labelled twice takes the larger label.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    having, n = _weights(docs)
    idf = np.log((1 + n) / (1 + having)) + 1
    values, vectors = np.linalg.eigh(_gram(docs, idf))
    space = vectors[:, np.argsort(-values)[:axes]]
    space = (space * np.sign(space[np.abs(space).argmax(0), np.arange(space.shape[1])])).astype(np.float32)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).where(train)
    chosen = chosen.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            x = _scaled(features(texts), idf) @ space
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["doc_id", "label", "vector"])

    rows = docs.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, label int, vector binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["vector"], np.float32) for r in rows]) if rows else np.zeros((0, space.shape[1]), np.float32)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return Model(idf, space, x, np.array([float(r["label"]) for r in rows]), k, power)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold, else 0); needs text.

    The text alone decides: equal texts get equal scores, whatever their ids. Null and empty texts are scored by their
    constant feature, like very short texts. Input columns named score or predicted are replaced. Without any label every score is 0.5.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*(f"`{c}`" for c in keep)).schema.add("score", "double").add("predicted", "integer")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            score = held.value.score(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)

"""Whole texts as numpy arrays: word and line spans of many documents at once, and 64-bit hashes of the spans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled in one go.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_table(ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    """True for the bytes inside the ranges, both ends included."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = ~byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words of digits, lower-case letters and everything outside ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = ~byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; letters outside ASCII stay as they are."""
    return F.translate(text, UPPER, LOWER)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [x or b"" for x in pc.cast(values, kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows with about ``most`` bytes of text, one row at least."""
    for batch in batches:  # the texts of a slice only are objects at a time
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = held = 0
        for i, size in enumerate(sizes):
            held += size
            if held >= most or i + 1 == len(sizes):
                part = batch.slice(first, i + 1 - first)
                yield part, byte_texts(part, column)
                first, held = i + 1, 0


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer spans are hashed by xxhash, one by one.
_LONG = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes mixed in at a time. Equal bytes give equal hashes everywhere;
    spans of up to eight bytes have equal hashes only if they are equal and of one length."""
    size = end - start
    out = mix(size.astype(np.uint64) + _BASE)
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].tobytes())
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = np.flatnonzero((size > 0) & (size <= _LONG))
    at = start[left]
    while len(left):
        rest = end[left] - at
        out[left] = mix(out[left] ^ (eight[at] & _KEEP[np.minimum(rest, 8)]))
        more = rest > 8
        left, at = left[more], at[more] + 8
    return out


class Texts:
    """Several texts in one buffer, each followed by a line end, and the spans of their words."""

    def __init__(self, texts: list[bytes], word: np.ndarray, lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.n = len(texts)
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        inside = word[self.data]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8)]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = self.doc_of(self.start)
        self.inside = inside

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def bounds(self) -> np.ndarray:
        """Words of text i: bounds[i] to bounds[i + 1]."""
        return np.searchsorted(self.doc, np.arange(self.n + 1))

    def characters(self) -> np.ndarray:
        """Code points before each byte."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])

    def per_text(self, flag: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        return np.add.reduceat(flag.astype(np.int64), self.first) if self.n else np.zeros(0, np.int64)


def first_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: does it repeat an earlier one; does any other equal it."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    same = np.ones(max(n - 1, 0), bool)
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    later = np.zeros(n, bool)
    either = np.zeros(n, bool)
    later[order[1:]] = same
    either[order[1:]] |= same
    either[order[:-1]] |= same
    return later, either

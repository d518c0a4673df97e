"""Fill-in-middle: texts cut at two code points and put in an order that asks for the middle last.

A cut is given as a number of code points, while the text is UTF-8 bytes. A learned rank index takes one to the other:
the offsets of all code points, as a function of their rank, are covered by straight segments that miss no offset by
more than ``error`` bytes; what each segment misses is kept as one small number per code point. A cut is predicted from
its segment and corrected by that number, so it is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest miss of a segment, in bytes; residuals then fit one signed byte.
ERROR = 100
_LOOK = 256


class RankIndex:
    """Byte offsets by rank as straight segments and residuals. ``offsets`` ascend; ranks count from 0."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 < error <= 126:
            raise ValueError("error must be from 1 to 126")
        self.first, self.slope = _segments(offsets, error)
        self.base = offsets[self.first]
        lengths = np.diff(np.append(self.first, len(offsets)))
        run = np.arange(len(offsets)) - np.repeat(self.first, lengths)
        guess = np.repeat(self.base, lengths) + np.rint(np.repeat(self.slope, lengths) * run).astype(np.int64)
        self.residual = (offsets - guess).astype(np.int8)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of the given ranks: predicted by segment, corrected by residual."""
        at = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[at] + np.rint(self.slope[at] * (ranks - self.first[at])).astype(np.int64) + self.residual[ranks]


def _segments(offsets: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray]:
    """First rank and slope of each segment. From a segment's first point, every further point allows a range of
    slopes; the segment ends before the point whose range leaves nothing of the ranges so far."""
    first, slope, start, n = [], [], 0, len(offsets)
    while start < n:
        low, high, end, look = -np.inf, np.inf, start + 1, _LOOK
        while end < n:
            run = np.arange(end - start, min(end + look, n) - start, dtype=np.float64)
            rise = (offsets[end:end + len(run)] - offsets[start]).astype(np.float64)
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            fits = len(run) if lows[-1] <= highs[-1] else int(np.argmax(lows > highs))
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            end += fits
            if fits < len(run):
                break
            look *= 2
        first.append(start)
        slope.append((low + high) / 2 if end > start + 1 else 0.0)
        start = end
    return np.array(first, np.int64), np.array(slope)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the id; a null id counts as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def cut(texts: list[bytes], ids: list[int | None], seed: int, rate: int, spm_rate: int) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """Code points, form, prefix and middle length, and output of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    rank = np.searchsorted(begins, ends - sizes)  # of each text's first code point
    units = np.searchsorted(begins, ends) - rank
    drawn = np.array([draws(i, seed) for i in ids], np.int64).reshape(len(ids), 4)
    cuts = np.sort(drawn[:, :2] % (units + 1)[:, None], 1)
    index = RankIndex(np.append(begins, len(data)))
    places = index.offsets(rank[:, None] + cuts) - (ends - sizes)[:, None]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for text, n, (a, b), (at, to), (_, _, h3, h4) in zip(texts, units.tolist(), cuts.tolist(), places.tolist(), drawn.tolist()):
        if not text or p in text or s in text or m in text or h3 % 100 >= rate:
            out.append((n, "plain", None, None, text))
        elif h4 % 100 < spm_rate:
            out.append((n, "spm", a, b - a, b"".join((s, text[to:], p, text[:at], m, text[at:to]))))
        else:
            out.append((n, "psm", a, b - a, b"".join((p, text[:at], s, text[to:], m, text[at:to]))))
    return out


COLUMNS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """The rows, their text replaced by ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Needs doc_id and text. ``rate`` percent of the texts are transformed, ``spm_rate`` percent of those as spm. Both
    and the cuts depend on seed and doc_id alone, so repeated rows get equal results. Null texts are empty; empty texts
    and texts that hold a marker stay plain. A null id counts as an empty string. Input columns named like a result are
    replaced. Texts of any length are cut whole, one row at a time beyond a megabyte.
    """
    keep = [c for c in docs.columns if c not in (*COLUMNS, "text")]
    schema = docs.select(*(f"`{c}`" for c in keep)).schema
    for name, kind in zip(COLUMNS, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            n, form, prefix, middle, output = zip(*cut(texts, batch.column("doc_id").to_pylist(), seed, rate, spm_rate))
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *COLUMNS])

    return docs.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that was cut; the parts of a transformed text hold no marker, so splitting at markers finds them."""
    part = F.split(output, "<[PSM]>", -1)
    first, second, middle = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)

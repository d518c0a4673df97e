"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines, by rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.text import SPACED, Texts, byte_table, first_of_equal, mix, slices, span_hashes

#: Largest share, in percent of the characters in words, that may lie inside n-grams found twice or more; by n.
GRAM_LIMITS = {5: 25, 6: 24, 8: 22, 10: 20}
#: Largest share, in percent, of lines with a word that repeat an earlier line, and of their characters.
LINE_LIMIT, LINE_CHAR_LIMIT = 40, 40
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
LINE_END = byte_table([(10, 10)])
_ROLL = np.uint64(0x9FB21C651E98DF25)


def measure(texts: list[bytes], grams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts per text.

    Words are runs without ASCII white space. ``gram_chars_n``: code points of words inside n-word windows that stand
    twice or more in the text, the first included; ``repeat_words_n``: those words. A line repeats when it equals an
    earlier line of its text and has a word. Windows are compared by a 64-bit rolling hash over 64-bit word hashes.
    """
    t = Texts(texts, SPACED)
    chars, bounds = t.characters(), t.bounds()
    size = chars[t.end] - chars[t.start]
    per_text = lambda doc, weight=None: np.bincount(doc, weight, t.n).astype(np.int64)
    out = {"n_words": np.diff(bounds), "word_chars": per_text(t.doc, size), "n_symbols": t.per_text(SYMBOLS[t.data])}
    stop = np.flatnonzero(LINE_END[t.data])
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    worded = np.searchsorted(t.start, stop) > np.searchsorted(t.start, start)
    start, stop = start[worded], stop[worded]
    doc, length = t.doc_of(start), chars[stop] - chars[start]
    later, _ = first_of_equal(doc, span_hashes(t.data, start, stop))
    out |= {"n_lines": per_text(doc), "line_chars": per_text(doc, length), "n_dup_lines": per_text(doc[later]), "dup_line_chars": per_text(doc[later], length[later])}
    word = t.hashes()
    at, roll, n = np.arange(len(word)), np.zeros(len(word), np.uint64), 0
    for wanted in sorted(grams):
        while n < wanted:  # from n words to n + 1: one more product and sum for every window that is left
            at = at[at + n < len(word)]
            at = at[t.doc[at + n] == t.doc[at]]
            roll[at] = roll[at] * _ROLL + word[at + n]
            n += 1
        _, twice = first_of_equal(t.doc[at], mix(roll[at]))
        at = at[twice]  # only repeated windows can begin longer repeated ones
        step = np.bincount(at, minlength=len(word) + 1) - np.bincount(at + n, minlength=len(word) + 1)
        inside = np.cumsum(step[:-1]) > 0
        out[f"repeat_words_{n}"] = per_text(t.doc[inside])
        out[f"gram_chars_{n}"] = per_text(t.doc[inside], size[inside])
    return out


def verdict(m: dict[str, np.ndarray], limits: dict[int, int], line_limit: int, line_char_limit: int) -> np.ndarray:
    """True for texts whose repetition stays within all limits; a text without words has none."""
    good = 100 * m["n_dup_lines"] <= line_limit * m["n_lines"]
    good &= 100 * m["dup_line_chars"] <= line_char_limit * m["line_chars"]
    for n, limit in limits.items():
        good &= 100 * m[f"gram_chars_{n}"] <= limit * m["word_chars"]
    return good


def repetition(docs: DataFrame, text: str = "text", limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT, line_char_limit: int = LINE_CHAR_LIMIT) -> DataFrame:
    """The rows with columns ``n_words``, ``word_chars``, ``n_symbols``, line and n-gram counts, and ``varied``, the verdict.

    A null text counts as empty: zeros, and varied. Texts of any length are measured whole. Input columns named like a
    result are replaced. Each row is judged alone, so repeated rows get equal results; an empty table gives no rows.
    """
    limits = dict(limits or GRAM_LIMITS)
    grams = tuple(sorted({5, *limits}))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "line_chars", "n_dup_lines", "dup_line_chars", *(f"{k}_{n}" for n in grams for k in ("repeat_words", "gram_chars"))]
    keep = [c for c in docs.columns if c not in (*counts, "varied")]
    schema = docs.select(*(f"`{c}`" for c in keep)).schema
    for c in counts:
        schema = schema.add(c, "long")
    schema = schema.add("varied", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            m = measure(texts, grams)
            columns = [batch.column(c) for c in keep] + [pa.array(m[c], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(verdict(m, limits, line_limit, line_char_limit))], [*keep, *counts, "varied"])

    return docs.mapInArrow(run, schema)

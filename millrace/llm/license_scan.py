"""License scans: short notices searched with a bounded number of edits.

A notice that occurs with at most k edits leaves one of any k + 1 parts of it untouched (pigeonhole). So each notice is
split into k + 1 seeds; an exact search for the seeds finds the places worth a look, and there the regex library matches
the notice with at most k edits, between word ends, and reports the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.text import ALNUM, byte_texts

#: Phrases whose exact places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_SPACED = bytes(b if ALNUM[b] else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """Words joined by single spaces, the label, and how many characters may be inserted, deleted or replaced."""

    text: str
    label: str
    edits: int


NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("licensed under the apache license", "apache", 3),
    Notice("apache license version 2 0", "apache-2.0", 2),
    Notice("cc by nc", "cc-by-nc", 0),
    Notice("cc by sa", "cc-by-sa", 0),
    Notice("cc by nd", "cc-by-nd", 0),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("mozilla public license", "mpl", 2),
    Notice("all rights reserved", "all-rights-reserved", 2),
)


def normal(text: bytes) -> str:
    """Lower-cased words (A-Z), one space between them and around the whole."""
    return " " + b" ".join(text.translate(_SPACED).split()).decode("utf-8", "replace") + " "


def seeds(notice: Notice) -> list[tuple[str, int]]:
    """The k + 1 parts and where they begin in the notice."""
    n, parts = len(notice.text), notice.edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(notice.text[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Exact places of phrases and bounded-error places of notices in normalised texts."""

    def __init__(self, phrases: dict[str, str], notices: tuple[Notice, ...]):
        self.phrases, self.notices = phrases, notices
        self.patterns = [regex.compile(rf"(?be)(?<= )(?:{regex.escape(n.text)}){{e<={n.edits}}}(?= )" if n.edits else rf"(?<= ){regex.escape(n.text)}(?= )") for n in notices]
        self.automaton = ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for seed, at in seeds(notice):
                by_seed.setdefault(seed, []).append((i, at))
        for phrase in phrases:
            by_seed.setdefault(f" {phrase} ", [])
        self.first = min(map(len, by_seed), default=0)
        for seed, users in by_seed.items():
            self.automaton.add_word(seed, (seed, users))
        if by_seed:
            self.automaton.make_automaton()
        #: Letters that every seed of a notice has in common are not known; the rarest seed test is by substring.
        self.seed_list = sorted(by_seed, key=len)

    def scan(self, words: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, int]]]:
        """Phrase places (start, phrase), and spans (start, end, label, edits) in a normalised text."""
        present = [s for s in self.seed_list if s in words]
        if not present:
            return [], []
        exact, windows = [], {}
        for end, (seed, users) in self.automaton.iter(words):
            start = end - len(seed) + 1
            if seed[1:-1] in self.phrases:
                exact.append((start + 1, seed[1:-1]))
            for i, at in users:
                k, n = self.notices[i].edits, len(self.notices[i].text)
                windows.setdefault(i, []).append((max(start - at - k - 1, 0), start - at + n + k + 1))
        spans = set()
        for i, places in windows.items():
            k = self.notices[i].edits
            for lo, hi in places:
                if self.phrase_far(i, words, lo, hi):
                    continue
                found = self.patterns[i].search(words, lo, hi)
                if found:
                    spans.add((found.start(), found.end(), self.notices[i].label, sum(found.fuzzy_counts) if k else 0))
        return sorted(exact), sorted(spans)

    def phrase_far(self, i: int, words: str, lo: int, hi: int) -> bool:
        """A cheap necessary test: at most k edits change at most k of the notice's letters, counted by kind."""
        notice, part = self.notices[i], words[lo:hi]
        lacking = 0
        for letter, n in self.letters(i):
            lacking += max(n - part.count(letter), 0)
            if lacking > notice.edits:
                return True
        return False

    def letters(self, i: int) -> list[tuple[str, int]]:
        known = self.__dict__.setdefault("_letters", {})
        if i not in known:
            text = self.notices[i].text
            known[i] = sorted(((c, text.count(c)) for c in set(text)), key=lambda x: -x[1])
        return known[i]


SPAN = "struct<start_word:long,end_word:long,start:long,end:long,label:string,edits:int>"


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """The rows with ``n_words``, ``places`` (exact phrases: word and phrase) and ``spans`` (words and characters of the
    normalised text, label, edits).

    Null text is empty: no words, empty lists. Whole texts of any length. Input columns named like a result are
    replaced; repeated rows are scanned alike; an empty table gives no rows.
    """
    phrases = dict(PHRASES if phrases is None else phrases)
    made = ("n_words", "places", "spans")
    keep = [c for c in docs.columns if c not in made]
    schema = docs.select(*(f"`{c}`" for c in keep)).schema
    from pyspark.sql.types import ArrayType, _parse_datatype_string

    place_type, span_type = _parse_datatype_string("struct<word:long,phrase:string>"), _parse_datatype_string(SPAN)
    schema = schema.add("n_words", "long").add("places", ArrayType(place_type)).add("spans", ArrayType(span_type))
    to_place = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))
    to_span = pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            counts, places, spans = [], [], []
            for text in byte_texts(batch):
                words = normal(text)
                counts.append(max(words.count(" ") - 1, 0) if words.strip(" ") else 0)
                exact, near = scanner.scan(words)
                word, last, n = {}, 0, -1  # the words before each place, counted once along the text
                for at in sorted({*(at for at, _ in exact), *(x for a, b, _, _ in near for x in (a, b))}):
                    n += words.count(" ", last, at)
                    word[at], last = n, at
                places.append([{"word": word[at], "phrase": p} for at, p in exact])
                spans.append([{"start_word": word[a], "end_word": word[b], "start": a - 1, "end": b - 1, "label": label, "edits": e} for a, b, label, e in near])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(places, to_place), pa.array(spans, to_span)], [*keep, *made])

    return docs.mapInArrow(run, schema)

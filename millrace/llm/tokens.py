"""Token ids by the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import struct

import regex
from tokenizers import Tokenizer

#: A text with one of these goes through the library as a whole: unusual white space, NUL, control strings.
ODD = [*map(chr, (0, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)), "<|"]
ODD_ASCII = [x for x in ODD if x.isascii()]
#: In byte-level vocabularies runs of white space are tokens too; such texts also go as a whole.
RUNS = ["  ", " \n", "\n ", "\n\n", "\t", "\r"]
#: Fixed patterns of the two kinds of vocabulary.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as U+0100 and on, in order.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINT)}
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
_LOADED: dict[str, Encoder] = {}


class _Known(dict):
    """Word -> ids, for the first ``most`` words met, so for nearly all frequent ones; others are encoded each time."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        packed = self.encode(word)
        if len(self) < self.most:
            self[word] = packed
        return packed


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``spaced``: the vocabulary is byte-level and a word's token holds the space before it; otherwise white space only
    separates. Either way no token crosses the places where a text is split, so the words' ids in a row are the
    text's ids. ``most``: words remembered.
    """

    def __init__(self, path: str, spaced: bool, most: int = 400_000):
        self.library, self.spaced = Tokenizer.from_file(path), spaced
        self.size = self.library.get_vocab_size()
        self.known = _Known(self._word, most)
        self.parts = _Known(self._part, most // 2)
        self.tokenize, self.normalize = self.library.model.tokenize, self.library.normalizer.normalize_str if self.library.normalizer else str
        self.find = regex.compile(SPACED if spaced else PLAIN).findall

    def _word(self, word: str) -> bytes:
        """A word falls into runs of letters, digits and others, as the library's own splitting does."""
        space = ""
        if self.spaced:
            if word[:1] == "\0":
                word = word[1:]
            elif word != "\n":
                space = " "
        plain = word.isascii()
        if not plain and max(word) >= "\u0180":  # the library's Unicode tables may be of another version
            ids = self.library.encode(space + word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if not self.spaced:
            word = word.lower() if plain else self.normalize(word)
        core = word.rstrip(".,")
        if core.isalpha() and (plain or max(core) < "\u0180"):
            if len(core) == len(word):
                return self.parts[space + word]
            return self.parts[space + core] + self.parts[word[len(core):]]
        return b"".join(map(self.parts.__getitem__, self.find(space + word)))

    def _part(self, part: str) -> bytes:
        if not part.isascii() or not part.isprintable():
            part = part.encode().decode("latin-1").translate(BYTES)
        elif part[0] == " ":
            part = "\u0120" + part[1:]
        ids = [t.id for t in self.tokenize(part)]
        return PACK[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in (ODD_ASCII if text.isascii() else ODD)) or self.spaced and (any(x in text for x in RUNS) or text[-1:].isspace()):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if not self.spaced:
            words = text.split()
        elif text:
            words = ("\0" + text.replace("\n", " \n \0")).split(" ")
        else:
            words = []
        return b"".join(map(self.known.__getitem__, words))


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, spaced)
    return _LOADED[path]

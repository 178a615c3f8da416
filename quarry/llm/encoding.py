"""Encoding of whole texts with the tokenizers library, with the ids of frequent words kept per worker.

A text of ordinary letters is the sequence of its words: the pre-tokenizers of both vocabulary files never
match across a single space, so the library's ids of a text are those of its words in turn. Words are looked
up; a new one is cut into its matches, which the library's model encodes. A text with any other character or
with adjacent white space, and every text under another pre-tokenizer, is given to the library whole. The
strings of special tokens are ordinary text.
"""

from __future__ import annotations

import gc
import json
import re
import struct

import numpy as np

#: Characters whose class (letter, space, other) and lower case are the same in every Unicode version and that
#: normalisation leaves alone: line feed, ASCII from space on, letters of Latin-1 and Latin Extended-A.
_PLAIN = re.compile("[\n\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įĴ-ķĹ-ľŁ-ňŊ-ž]*")
_ADJACENT = re.compile("[ \n][ \n]")
#: The pre-tokenizers' patterns, as they read over plain characters. Fixed values of the vocabulary files.
_MATCHES = {
    "byte": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    "word": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"),
}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print in
    Latin-1 stand for themselves, the others follow from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """ids of the pattern's matches, filled when asked."""

    def __init__(self, model, keep: int):
        self.tokenize, self.letters, self.keep = model.tokenize, _byte_letters(), keep
        self.space = self.letters[32]

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and "\n" not in piece:  # of plain ASCII, space and line feed alone have other letters
            shown = piece.replace(" ", self.space)
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(shown)]
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.keep:
            self[piece] = ids
        return ids


class _Words(dict):
    """ids of words between spaces, filled when asked."""

    def __init__(self, pieces: _Pieces, pattern: re.Pattern, space: str, keep: int):
        self.piece, self.cut, self.space, self.keep = pieces.__getitem__, pattern.findall, space, keep

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.piece, self.cut(self.space + word)))
        if len(self) < self.keep:
            self[word] = ids
        return ids


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes. keep: most words, and most pieces, held (about 150
    bytes each)."""

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)["pre_tokenizer"] or {}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind = None
        if made.get("type") == "ByteLevel" and made["use_regex"] and not made["add_prefix_space"]:
            self.kind = "byte"
        elif made.get("type") == "Sequence" and [x["type"] for x in made["pretokenizers"]] == ["Split", "ByteLevel"]:
            self.kind = "word"
        if self.kind:
            pieces = _Pieces(self.library.model, keep)
            self.first = _Words(pieces, _MATCHES[self.kind], "", keep)
            self.later = _Words(pieces, _MATCHES[self.kind], " ", keep)

    def _line(self, line: str) -> bytes:
        head, *rest = line.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """null counts as the empty text, which has no ids."""
        if not text:
            return b""
        if self.kind == "word" and _PLAIN.fullmatch(text):
            return b"".join(map(self.first.__getitem__, text.lower().split()))
        if self.kind == "byte" and _PLAIN.fullmatch(text) and not _ADJACENT.search(text):
            return self.first["\n"].join(map(self._line, text.split("\n")))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, keep: int) -> Encoder:
    """The worker's encoder of a vocabulary file; it outlives a task."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = Encoder(path, keep)
        gc.freeze()  # a worker collects garbage after each task, and would walk through all words held
    return _ENCODERS[path, keep]

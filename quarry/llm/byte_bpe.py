"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one last token in its encoding: of the tokens that end there, the one that may
stand after the last token of the prefix before it. Two tokens may stand side by side when merging their bytes
would leave the border between them; that is decided by undoing the merges around the border, latest first. The table of
last tokens is extended by appends without touching what it holds, and after an edit it is recomputed only until it
agrees with the old one again over as many bytes as the longest token has. The encoding is read off backwards.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import plain
from quarry.llm.encoding import _ADJACENT, _MATCHES, _PLAIN


HEAD = 9  # bytes of a prefix that is short


class Vocabulary:
    """Tokens by rank; single bytes must be among them."""

    def __init__(self, ranks: dict[bytes, int], keep_pairs: int = 200_000, keep_heads: int = 150_000):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.made = {t: r for t, r in ranks.items() if self.split(r) is not None}  # tokens that merges can make
        self.pairs: dict[int, bool] = {}  # by left token << 32 | right token
        self.heads: dict[bytes, int] = {}  # last tokens of short prefixes, which many strings share
        self.keep_pairs, self.keep_heads = keep_pairs, keep_heads

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, itself twice for a byte, None if merges never make it."""
        if token in self.parts:
            return self.parts[token]
        data, ranks = self.tokens[token], self.ranks
        bits = [data[i : i + 1] for i in range(len(data))]
        while len(bits) > 2:
            best, at = min(((ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(bits, bits[1:], strict=False))), default=(token, 0))
            if best >= token:
                break
            bits[at : at + 2] = [bits[at] + bits[at + 1]]
        found = (token, token) if len(data) == 1 else (ranks[bits[0]], ranks[bits[1]]) if len(bits) == 2 else None
        self.parts[token] = found
        return found

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged together, are the tokens a and b."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known = self._border(a, b)
            if len(self.pairs) < self.keep_pairs:
                self.pairs[a << 32 | b] = known
        return known

    def _border(self, a: int, b: int) -> bool:
        tokens, ranks, limit = self.tokens, self.ranks, 1 << 62
        while True:
            merged = ranks.get(tokens[a] + tokens[b])
            if merged is not None and merged < limit:
                return False
            # Undo the later of the two merges; of equal ranks the left one was made first.
            long_a, long_b = len(tokens[a]) > 1, len(tokens[b]) > 1
            if long_a and (a > b or not long_b):
                limit, a = a, self.split(a)[1]
            elif long_b:
                limit, b = b + 1, self.split(b)[0]
            else:
                return True


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, first: int, edge: int = 0, old: list[int] | None = None) -> int:
        """Adds the entries of all prefixes from `first` on, the longest candidate first. With `old` entries of the prefixes beyond
        `edge`, it stops where as many in a row agree as the longest token has bytes. Returns the last prefix whose entry was made."""
        v, data, last = self.vocabulary, self.data, self.last
        token_of, pairs, longest, heads = v.made.get, v.pairs, v.longest, v.heads
        same = 0
        for i in range(first, len(data) + 1):
            token = heads.get(data[:i]) if i <= HEAD else None
            if token is None:
                for a in range(i - longest if i > longest else 0, i):
                    token = token_of(data[a:i])
                    if token is not None:
                        if not a:
                            break
                        good = pairs.get(last[a] << 32 | token)
                        if good or good is None and v.adjacent(last[a], token):
                            break
                else:
                    raise ValueError("a byte has no token")
                if i <= HEAD and len(heads) < v.keep_heads:
                    heads[data[:i]] = token
            last.append(token)
            if old is not None and i > edge:
                same = same + 1 if token == old[i - edge - 1] else 0
                if same >= longest:
                    return i
        return len(data)

    def append(self, data: bytes) -> None:
        """Exact: what is in the table stays as it is."""
        done, self.data = len(self.data), self.data + data
        self._fill(done + 1)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts `data` in place of bytes [start, end). Returns how many entries were computed anew."""
        old = self.last[end + 1 :]
        self.data = self.data[:start] + data + self.data[end:]
        self.last = self.last[: start + 1]
        edge = start + len(data)
        done = self._fill(start + 1, edge, old)
        self.last += old[done - edge :]
        return done - start

    def ids(self) -> list[int]:
        out, i, tokens = [], len(self.data), self.vocabulary.tokens
        while i:
            out.append(self.last[i])
            i -= len(tokens[self.last[i]])
        return out[::-1]


class _Matches(dict):
    def __init__(self, vocabulary: Vocabulary, keep: int):
        self.vocabulary, self.keep = vocabulary, keep

    def __missing__(self, match: str) -> bytes:
        data = match.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).ids()
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.keep:
            self[match] = ids
        return ids


class _Words(dict):
    def __init__(self, matches: _Matches, space: str, keep: int):
        self.match, self.space, self.keep = matches.__getitem__, space, keep

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.match, _MATCHES["byte"].findall(self.space + word)))
        if len(self) < self.keep:
            self[word] = ids
        return ids


class Codec:
    """Texts to ids and back; a match that is a token is that token, any other goes through a prefix table. Ids of frequent words and
    matches are held per worker (about 200 bytes apiece); matches matter more, as they cost more."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, keep_words: int = 200_000, keep_matches: int = 400_000):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        matches = _Matches(vocabulary, keep_matches)
        self.match = matches.__getitem__
        self.first, self.later = _Words(matches, "", keep_words // 4), _Words(matches, " ", keep_words)
        self.plain = pattern == _SPLIT

    def _line(self, line: str) -> bytes:
        head, *rest = line.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain and _PLAIN.fullmatch(text) and not _ADJACENT.search(text):
            return self.first["\n"].join(map(self._line, text.split("\n")))
        return b"".join(map(self.match, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The pattern for which plain texts can be cut at spaces and line feeds first. A fixed value of the vocabulary files.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file; it outlives a task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(Vocabulary.load(path), pattern)
        gc.freeze()  # a worker collects garbage after each task, and would walk through all words held
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text; decoded: also the bytes that the ids stand
    for. A null text counts as empty and has no ids, null and repeated keys are kept, other columns are ignored, an
    empty table gives no rows. No shuffle; texts pass one at a time."""
    schema = "doc_id long, ids binary" + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = [c.encode(t.as_py()) for t in part.column(1)]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(c.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    docs, (key, text) = plain(docs, key, text)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the bytes that `ids` stand for; null ids count as none. Null and repeated keys are kept, other columns are ignored, an empty
    table gives no rows; an id that isn't in the vocabulary ends the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())], ["doc_id", "decoded"])

    encoded, (key, ids) = plain(encoded, key, ids)
    return encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")

"""Secret scans through nested encodings.

The base patterns run over the whole text. Then a worklist unwraps it: in each layer all percent and Unicode escapes are
undone in place, and all base64 runs whose bytes read as text or hold something to find, or unpack (gzip, zlib, bz2), are put in clear in
place, so that a keyword outside a run still stands before its value. A run is read from each of its first four characters, as
what stands before it (a path, say) may use the same characters, and as UTF-8, UTF-16 or single bytes; each reading makes a layer. Runs are
taken line by line, and for another layer the lines of a wrapped run together. Every new layer is scanned again and unwrapped
again until no layer is new; a layer seen before (by digest) ends a cycle. Each character of a layer carries the span
of the text that it came from, so that what is found in a layer is reported where it stands in the text.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import plain

#: The base patterns with their least lengths (of group 2, or of the match). Fixed values of the contract.
_A = re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _A | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", _A)
HEX = re.compile(r"[0-9a-f]+", _A)
KINDS = ("assign", "access", "hex")
LEAST = (12, 18, 16)
_HEX_LONG = re.compile(r"[0-9a-f]{16,}", _A)  # the same matches as HEX, of LEAST characters or more

#: Repeats of an escaped escape sign (%2525..., \\u005cu005c...) that are undone one by one. Of a longer chain the surplus is undone at once: the layers
#: left out differ from the others in the length of the chain alone.
CHAIN = 16
_CHAINS = rf"%(?:25){{{CHAIN + 1},}}|\\(?:u005[Cc]){{{CHAIN + 1},}}|\\(?:x5[Cc]){{{CHAIN + 1},}}"
_ESCAPE = re.compile(_CHAINS + r"|(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}", _A)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", _A)
#: The next line of a wrapped run: a line break, written out or as an escape, then marks of a quotation or comment.
_NEXT = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t>#*|]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])", _A)
#: Most bytes that one compressed run unpacks to as a text of its own. Of more, what matters is taken out window by window, up to FAR bytes.
UNPACKED = 1 << 26
FAR = 1 << 30
_STANDARD = str.maketrans("-_", "+/")
_WINDOW, _OVERLAP = 1 << 22, 1 << 20


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds as numbers of KINDS."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST[0]:
            yield m.start(), 0, m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST[1]:
                yield m.start(), 1, m.end()
    for m in _HEX_LONG.finditer(text):
        yield m.start(), 2, m.end()


class _Reading(NamedTuple):
    """Clear text of a run, the bytes of each character (None: it was compressed), and the run's characters and bytes before it."""

    text: str
    sizes: np.ndarray | None
    skipped: int = 0
    before: int = 0


#: What bytes must have for anything to be found in them: a quick test before scan().
_HINT = re.compile(rb"password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{16}|%[0-9a-f]{2}|\\[ux]|[a-z0-9+/_-]{16}", re.IGNORECASE)
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]")


def _telling(data: bytes, text: str) -> bool:
    return _HINT.search(data) is not None and (next(scan(text), None) is not None or _ESCAPE.search(text) is not None or _BASE64.search(text) is not None)


def _texts(data: bytes, skipped: int) -> Iterator[_Reading]:
    """The ways to read the bytes that start behind `skipped` characters of a run: any UTF-8 from its start; other bytes
    and starts if there is something to find in them."""
    if len(data) < 4:
        return
    text = None
    if not skipped:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            pass
    if text is not None:
        if len(text) > 3:
            yield _Reading(text, _utf8_sizes(text))
    elif _telling(data, text := data.decode("latin-1")):
        yield _Reading(text, np.ones(len(text), np.int64), skipped)
    if 4 * data.count(0) >= len(data):
        for odd in (0, 1):
            wide = data[odd : len(data) - (len(data) - odd) % 2].decode("utf-16-le", "replace")
            if _telling(wide.encode("utf-8", "replace"), wide):
                yield _Reading(wide, np.fromiter((4 if ord(c) > 0xFFFF else 2 for c in wide), np.int64, len(wide)), skipped, odd)


def _utf8_sizes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)).astype(np.int64)


#: Heads of gzip, bzip2 and zlib streams.
_HEAD = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\x78[\x01\x5e\x9c\xda]", re.DOTALL)


def _packed(data: bytes) -> bool:
    return _HEAD.match(data) is not None


def _member(data: bytes) -> Iterator[bytes]:
    """Pieces of the first member; returns what follows it. A broken or cut member raises."""
    if data[:3] == b"BZh":
        b = bz2.BZ2Decompressor()
        while not b.eof:
            yield b.decompress(data, _WINDOW)
            data = b""
            if b.needs_input and not b.eof:
                raise ValueError("cut off")
        return b.unused_data
    z = zlib.decompressobj(47)
    while not z.eof:
        piece = z.decompress(data, _WINDOW)
        data = z.unconsumed_tail
        if not (piece or data or z.eof):
            raise ValueError("cut off")
        yield piece
    return z.unused_data


def _pieces(data: bytes) -> Iterator[bytes]:
    """All members, then what follows them as it is. Raises if the first is no whole member."""
    data = yield from _member(data)
    while _packed(data):
        try:
            data = yield from _member(data)
        except (OSError, ValueError, zlib.error):
            break
    if data.strip(b"\0"):
        yield data


def _unpack(data: bytes) -> bytes | None:
    out, rest = bytearray(), _pieces(data)
    try:
        for piece in rest:
            out += piece
            if len(out) > UNPACKED:
                return _excerpt(out, rest)
    except (OSError, ValueError, zlib.error):
        return None
    return bytes(out)


def _excerpt(window: bytearray, rest: Iterator[bytes]) -> bytes:
    """Of a text too long to hold: its secrets and all its encoded parts with what stands before them, each once."""
    kept, seen, done = [], set(), 0
    while window:
        while len(window) < _WINDOW + _OVERLAP and (piece := next(rest, None)) is not None:
            window += piece
        text = window[: _WINDOW + _OVERLAP].decode("latin-1")  # the patterns are ASCII
        spans = [(a, min(b, a + 4096)) for a, _, b in scan(text)]
        spans += [(max(0, m.start() - 64), m.end()) for m in _ESCAPE.finditer(text)]
        spans += [(max(0, m.start() - 64), m.end()) for m in _BASE64.finditer(text) if _clear(m[0])]
        spans += [(max(0, lines[0][0] - 64), lines[-1][1]) for lines, _ in _wrapped(text)]
        for a, b in spans:
            if (mark := _digest(text[a:b])) not in seen:
                seen.add(mark)
                kept.append(text[a:b])
        done += _WINDOW
        if len(text) < _WINDOW + _OVERLAP or done >= FAR:
            break
        del window[:_WINDOW]
    return "\n".join(kept).encode("latin-1")


def _decoded(body: str) -> bytes:
    """Bytes of base64 characters; a last one that holds no whole byte is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _unpacked(data: bytes) -> bytes | None:
    """The bytes from the first compressed stream on, with every stream in them, also a nested one, put in clear; None if there is none."""
    at, size, seen, found = 0, 0, set(), False
    while size < FAR and (head := _HEAD.search(data, at)):
        more = _unpack(data[head.start() :])
        at = head.start() + 1
        if more is not None:
            data, size, found = data[: head.start()] + more, size + len(more), True
            if (mark := hashlib.blake2b(data).digest()) in seen:
                break
            seen.add(mark)
            at = head.start()
    return data if found else None


def _clear(run: str, whole: bool = False) -> list[_Reading]:
    """Readings of a base64 run; if it is `whole`, from its first character alone."""
    body = run.rstrip("=").translate(_STANDARD)
    out: list[_Reading] = []
    for skipped in range(1 if whole else 4):
        data = _decoded(body[skipped:])
        # What was compressed is taken as it is: other bytes stand for themselves, and all come from the rest of the run.
        head = _HEAD.match(data) if whole else _HEAD.search(data)
        more = _unpacked(data[head.start() // 3 * 3 :]) if head else None
        out += _texts(data, skipped) if more is None else (_Reading(r.text, None, skipped + head.start() // 3 * 4) for r in _all_texts(more))
        if out and not skipped and not _CONTROL.search(out[0].text):
            break  # text from end to end
    return out


def _all_texts(data: bytes) -> Iterator[_Reading]:
    found = list(_texts(data, 0))
    if len(data) > 3 and not found:
        found = [_Reading(data.decode("latin-1"), None)]
    yield from found


def _wrapped(text: str) -> Iterator[tuple[list[tuple[int, int]], _Reading]]:
    """(spans of the lines, reading) of wrapped base64 runs, in order. All lines of a run but the first and the last are equally
    long; where that gives no text, all lines that follow each other are tried together."""
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() < done or m[0].endswith("="):
            continue
        lines = [m.span()]
        while not text[lines[-1][1] - 1] == "=" and (more := _NEXT.match(text, lines[-1][1])):
            lines.append(more.span(1))
        done = lines[-1][1]
        n, i, free = len(lines), 0, 0  # lines from `free` on aren't part of a run yet
        runs = []
        while i < n:
            size, j = lines[i][1] - lines[i][0], i + 1
            while j < n and lines[j][1] - lines[j][0] == size:
                j += 1
            last = j + 1 if j < n and lines[j][1] - lines[j][0] < size else j
            tries = [(x, y) for x in (i - 1, i, i + 1) for y in dict.fromkeys((last, j)) if x >= free and y - x > 1]
            for x, y in tries:
                if found := _clear("".join(text[a:b] for a, b in lines[x:y]), whole=True):
                    runs.append((lines[x:y], found[0]))
                    j = free = y
                    break
            i = j
        if not runs and n > 2 and (found := _clear("".join(text[a:b] for a, b in lines), whole=True)):
            runs.append((lines, found[0]))
        yield from runs


def _plain_escape(run: str) -> list[tuple[str, int, int]] | None:
    """(character, start, end) within a run of escapes of one kind, or a chain."""
    if (step := 2 if run[:5] == "%2525" else 5 if run[6:7] == "u" and run[1] == "u" else 3 if run[4:5] == "x" and run[1] == "x" else 0):
        n = len(run)
        return [(run[0], 0, n - CHAIN * step), *((run[i], i, i + 1) for i in range(n - CHAIN * step, n))]
    if run[0] == "%":
        data = bytes.fromhex(run.replace("%", ""))
        out, i = [], 0
        while i < len(data):
            n = 1 if data[i] < 0x80 else 2 if data[i] >> 5 == 6 else 3 if data[i] >> 4 == 14 else 4
            try:
                out.append((data[i : i + n].decode(), 3 * i, 3 * min(len(data), i + n)))
                i += n
            except UnicodeDecodeError:
                out.append((chr(data[i]), 3 * i, 3 * i + 3))
                i += 1
        return out
    if run[:2] == "\\x":
        return [(chr(int(run[2:], 16)), 0, len(run))]
    if run[:2] == "\\U" or run[2:3] == "{":
        code = int(run[2:].strip("{}"), 16)
        return [(chr(code), 0, len(run))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            out.append((chr(0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00), 6 * i, 6 * i + 12))
            i += 2
            continue
        out.append(("�" if 0xD800 <= u < 0xE000 else chr(u), 6 * i, 6 * i + 6))
        i += 1
    return out


class _Layer:
    """A text, and for each of its characters the span [start, end) of the original (None: the text is the original)."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self._starts, self._ends = text, starts, ends

    @property
    def starts(self) -> np.ndarray:
        if self._starts is None:
            n = np.arange(len(self.text) + 1, dtype=np.int64)
            self._starts, self._ends = n[:-1], n[1:]
        return self._starts

    @property
    def ends(self) -> np.ndarray:
        return self.starts if self._ends is None else self._ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def put(self, changes: list[tuple[int, int, str, list[tuple[int, int]] | None]]) -> _Layer:
        """Puts texts in place of [a, b); the last member has the part of [a, b) behind each new character, None is all of it."""
        texts, starts, ends, at = [], [self.starts[:0]], [], 0
        for a, b, new, behind in changes:
            texts += [self.text[at:a], new]
            if behind is None:
                first, last = (np.full(len(new), x, np.int64) for x in self.span(a, b))
            else:
                first, last = np.array([self.span(a + x, a + y) for x, y in behind], np.int64).reshape(-1, 2).T
            starts += [self.starts[at:a], first]
            ends += [self.ends[at:a], last]
            at = b
        return _Layer("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))

    def escapes(self) -> _Layer | None:
        changes = []
        for m in _ESCAPE.finditer(self.text):
            plain = _plain_escape(m[0])
            if plain:
                changes.append((m.start(), m.end(), "".join(c for c, _, _ in plain), [(x, y) for _, x, y in plain]))
        return self.put(changes) if changes else None

    def encoded(self) -> Iterator[_Layer]:
        """A layer for each reading: the first ones of all runs, the second ones (of runs with fewer the last), and so on."""
        runs = [(m.span(), found) for m in _BASE64.finditer(self.text) if (found := _clear(m[0]))]
        for i in range(max((len(found) for _, found in runs), default=0)):
            chosen = [(span, found[min(i, len(found) - 1)]) for span, found in runs]
            yield self.put([(a + r.skipped, b, r.text, self._behind([(a, b)], r)) for (a, b), r in chosen])

    def unwrapped(self) -> _Layer | None:
        changes = [(lines[0][0], lines[-1][1], r.text, self._behind(lines, r)) for lines, r in _wrapped(self.text)]
        return self.put(changes) if changes else None

    @staticmethod
    def _behind(lines: list[tuple[int, int]], r: _Reading) -> list[tuple[int, int]] | None:
        """The part of a run behind each character of its clear text, counted from the first character read."""
        if r.sizes is None:
            return None
        at = np.concatenate([np.arange(a, b) for a, b in lines])[r.skipped :] - lines[0][0] - r.skipped
        sizes = r.before + np.concatenate(([0], np.cumsum(r.sizes)))
        n = len(at)
        starts, ends = at[np.minimum(n - 1, sizes[:-1] // 3 * 4)], at[np.minimum(n, -(-sizes[1:] // 3) * 4) - 1] + 1
        return list(zip(starts.tolist(), ends.tolist(), strict=True))


def find(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, depth), ordered; depth 0 is the text itself, a deeper span is given at its least depth."""
    found = {x: 0 for x in scan(text)}
    todo, seen = deque([(_Layer(text), 0)]), set()
    while todo:
        layer, depth = todo.popleft()
        for new in chain((layer.escapes(),), layer.encoded(), (layer.unwrapped(),)):
            if new is None:
                continue
            if not seen:
                seen.add(_digest(text))
            if (mark := _digest(new.text)) in seen:
                continue
            seen.add(mark)
            todo.append((new, depth + 1))
            for a, kind, b in scan(new.text):
                start, end = new.span(a, b)
                found.setdefault((start, kind, end), depth + 1)
    return sorted((*x, depth) for x, depth in found.items())


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_SCHEMA = "doc_id long, findings array<struct<start:long,kind:int,end:long,depth:int>>"


def scan_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and findings of every whole text, ordered by start and kind; code points, end exclusive. A null text counts as
    empty and has none, null and repeated keys are kept, other columns are ignored, an empty table gives no rows. No shuffle."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("depth", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "kind", "end", "depth")
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in find(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "findings"])

    docs, (key, text) = plain(docs, key, text)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SCHEMA)


def joined(findings: Column) -> Column:
    """kind:start:end, comma-joined, each span once."""
    name = F.array(*map(F.lit, KINDS))
    parts = F.transform(findings, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(F.array_distinct(parts), ",")


def _is(kind: int):
    return lambda x: x == kind


def summary(scanned: DataFrame) -> DataFrame:
    """Counts of base findings by kind, their digest, and all spans."""
    base = F.filter("findings", lambda x: x["depth"] == 0)
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, _is(k)), False)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return scanned.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))

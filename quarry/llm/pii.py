"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Validated values are found in a text: payment card numbers (Luhn), IBANs (modulo 97), calendar dates, IPv4 addresses, US social security
numbers, phone numbers and mail addresses. The free part of each is a number below the count of values of its format; a
Feistel network keyed with the secret and the format permutes those numbers, so that a pseudonym has the same format, equal
values get equal pseudonyms in every document, different ones different ones, and who has the key can undo it. Check
digits are computed anew, so a pseudonym is valid again. Separators, lengths, letter case, a mail address's top-level domain, an IPv4
address's reserved range and a phone number's country code stay; a date has one pseudonym in all notations.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fields, kept_columns, plain

ROUNDS = 8


class Permutation:
    """A keyed permutation of the numbers below any bound: a Feistel network over the least two-part square that
    holds the bound, walked until the result is below it again."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, label: str, bound: int, r: int, x: int, side: int) -> int:
        seen = hashlib.blake2b(f"{label}|{bound}|{r}|{x}".encode(), key=self.key, digest_size=side.bit_length() // 8 + 9).digest()
        return int.from_bytes(seen, "big") % side

    def _walk(self, label: str, bound: int, x: int, back: bool) -> int:
        if not 0 <= x < bound:
            raise ValueError("not below the bound")
        if bound < 2:
            return x
        a = _root(bound)  # left part below a, right part below b
        b = -(-bound // a)
        while True:
            left, right = divmod(x, b)
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if r % 2:
                    right = (right + sign * self._round(label, bound, r, left, b)) % b
                else:
                    left = (left + sign * self._round(label, bound, r, right, a)) % a
            x = left * b + right
            if x < bound:
                return x

    def apply(self, label: str, bound: int, x: int) -> int:
        return self._walk(label, bound, x, False)

    def undo(self, label: str, bound: int, x: int) -> int:
        return self._walk(label, bound, x, True)


def _root(n: int) -> int:
    from math import isqrt

    a = isqrt(n)
    return a if a * a == n else a + 1


def _luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


_OCTETS = {1: range(10), 2: range(10, 100), 3: range(100, 256)}
_ANY = range(256)
#: Address ranges that aren't public, as the values that each octet has in them.
_RESERVED = (
    ((10,), _ANY, _ANY, _ANY), ((127,), _ANY, _ANY, _ANY), ((0,), _ANY, _ANY, _ANY), ((172,), range(16, 32), _ANY, _ANY), ((192,), (168,), _ANY, _ANY),
    ((169,), (254,), _ANY, _ANY), ((100,), range(64, 128), _ANY, _ANY), (range(224, 240), _ANY, _ANY, _ANY), (range(240, 256), _ANY, _ANY, _ANY),
)


def _reserved(octets: tuple[int, ...]) -> tuple[int, tuple | None]:
    """The number of the range that an address lies in, and the range; -1 and None for a public one."""
    for i, r in enumerate(_RESERVED):
        if octets[0] in r[0] and octets[1] in r[1]:
            return i, r
    return -1, None


def _put(pattern: str, chars: str) -> str:
    """`chars` in place of the letters and digits of `pattern`, in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


#: Alphabets whose letters stay in them, as first and last character. Combining marks belong to a word and stay as they are.
_ALPHABETS = [range(ord(a), ord(b) + 1) for a, b in ("09", "az", "AZ", "\xdf\xf6", "\xf8\xff", "\xc0\xd6", "\xd8\xde", "\u0100\u017f", "αω", "ΑΡ", "ΣΩ", "ая", "АЯ")]
_LETTERS = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in _ALPHABETS) + "\u0300-\u036f"
_MAIL = rf"(?<![{_LETTERS}._%+-])[{_LETTERS}._%+-]+@[{_LETTERS}-]+(?:\.[{_LETTERS}-]+)*\.[A-Za-z]{{2,}}(?![{_LETTERS}-])"


def _alphabet(c: str) -> range | None:
    return next((r for r in _ALPHABETS if ord(c) in r), None)



_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_LOCAL = r"[0-9]{3,4}[ .-][0-9]{3,4}"
#: After a plus sign a country code and digits in any grouping, whose end _plus_end() finds.
_PLUS = rf"(?<![A-Za-z0-9+])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)[ .-]?|[0-9]{{2,4}}[ .-]){_LOCAL}(?![0-9])|\+[0-9](?:\)?[ ./-]?\(?[0-9]){{6,14}}(?![0-9]))"
#: An area in brackets, or three, three and four digits that hyphens or dots hold together, whatever stands beside them.
_FIRM = rf"(?<![A-Za-z0-9+])(?:\([0-9]{{2,4}}\)[ .-]?{_LOCAL}(?![0-9])|(?<![0-9][.-])[0-9]{{3}}(?P<mark>[.-])[0-9]{{3}}(?P=mark)[0-9]{{4}}(?![.-]?[0-9]))"
#: Bare groups that no other digits adjoin; three, three and four digits with spaces, one number after the other.
_PHONE = rf"(?<![A-Za-z0-9+])(?<![0-9][ .-])(?:[0-9]{{2,4}}[ .-]{_LOCAL}(?![ .-]?[0-9])|(?=(?:[0-9]{{3}} [0-9]{{3}} [0-9]{{4}} )+[0-9]{{3}} [0-9]{{3}} [0-9]{{4}}(?![ .-]?[0-9]))[0-9]{{3}} [0-9]{{3}} [0-9]{{4}})"
_CARD = r"(?<![A-Za-z0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
_NUMBERS = (("iban", _IBAN), ("card", _CARD), ("ip", _IP))
_ALL = re.compile("|".join(f"(?P<{n}>{p})" for n, p in (("mail", _MAIL), *_NUMBERS)), re.ASCII)
_NO_MAIL = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _NUMBERS), re.ASCII)
_DIGIT = re.compile("[0-9]")
_GROUP, _CHAIN, _MARK = re.compile("[0-9]+"), re.compile("[0-9]+(?:-[0-9]+)*"), re.compile("[ -]")
_COUNTRY = re.compile(r"\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")  # country codes differ in length
_IPS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_DATES, _SSNS, _FIRMS, _PHONES, _PLUSES, _MAILS = (re.compile(p, re.ASCII) for p in (_DATE, _SSN, _FIRM, _PHONE, _PLUS, _MAIL))
_CARD_FORMS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}  # digits of a card's usual groups
_IBAN_SIZES = dict(re.findall("([A-Z]{2})([0-9]{2})", """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18
    FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19
    MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29
    VA22 VG24 XK20 YE30"""))  # fmt: skip
KINDS = ("mail", "iban", "card", "ip", "ssn", "date", "phone")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Masker:
    """Finds and replaces personal data; `undo` gives the originals back. A pseudonym may be valid together with digits beside it where the
    original was not: restore() takes the spans of mask() instead of a search, and is exact there too."""

    def __init__(self, key: bytes, undo: bool = False):
        p = Permutation(key)
        self.permute = p.undo if undo else p.apply

    def _mail(self, s: str) -> str | None:
        local, _, domain = s.partition("@")
        host, dot, top = domain.rpartition(".")
        free = local + "@" + host
        # Mixed radix: a digit or letter is a place in its alphabet. The mail's form is its label, so permutations differ by form.
        kinds = [_alphabet(c) for c in free]
        bound = x = 0
        for c, kind in zip(free, kinds, strict=True):
            if kind:
                bound, x = (bound or 1) * len(kind), x * len(kind) + kind.index(ord(c))
        if not bound:
            return None
        form = "".join(chr(kind[0]) if kind else c for c, kind in zip(free, kinds, strict=True))
        x, out = self.permute(f"mail {form} {top.lower()}", bound, x), []
        for c, kind in zip(reversed(free), reversed(kinds), strict=True):
            if kind:
                x, d = divmod(x, len(kind))
                c = chr(kind[d])
            out.append(c)
        return "".join(reversed(out)) + dot + top

    def _iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body, bound, x = flat[4:], 1, 0
        for c in body:
            base, value = (10, int(c)) if c.isdigit() else (26, ord(c) - 65)
            bound, x = bound * base, x * base + value
        form = re.sub("[A-Z]", "A", re.sub("[0-9]", "0", body))
        x, out = self.permute(f"iban {flat[:2]} {form}", bound, x), []
        for c in reversed(body):
            x, d = divmod(x, 10 if c.isdigit() else 26)
            out.append(str(d) if c.isdigit() else chr(65 + d))
        body = "".join(reversed(out))
        return _put(s, f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}")

    def _card(self, s: str) -> str | None:
        flat = re.sub("[ -]", "", s)
        if str(_luhn(flat[:-1])) != flat[-1]:
            return None
        body = str(self.permute(f"card {len(flat)}", 10 ** (len(flat) - 1), int(flat[:-1]))).zfill(len(flat) - 1)
        return _put(s, body + str(_luhn(body)))

    def _ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        # Each octet keeps its length, and a reserved range its fixed octets; a public address stays out of those ranges.
        fixed, ranges = _reserved(tuple(map(int, parts)))
        sets = [_OCTETS[len(p)] for p in parts]
        if ranges:  # the part of an octet's values that the range leaves free
            sets = [[v for v in own if v in free] for own, free in zip(sets, ranges, strict=True)]
        bound = x = 0
        for own, p in zip(sets, parts, strict=True):
            bound, x = (bound or 1) * len(own), x * len(own) + own.index(int(p))
        label = f"ip {fixed} {' '.join(str(len(p)) for p in parts)}"
        while True:
            x, out = self.permute(label, bound, x), []
            rest = x
            for own in reversed(sets):
                rest, v = divmod(rest, len(own))
                out.append(own[v])
            if _reserved(tuple(reversed(out)))[0] == fixed:
                return ".".join(map(str, reversed(out)))

    def _ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1  # 898 areas
        x = self.permute("ssn", 898 * 99 * 9999, x)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _date(self, s: str) -> str | None:
        first = s[2] not in "-/."
        mark = s[4] if first else s[2]
        a, b, c = s.split(mark)
        for order in ("ymd",) if first else ("dmy", "mdy") if mark == "." else ("mdy", "dmy"):
            y, m, d = (a, b, c) if order == "ymd" else (c, a, b) if order == "mdy" else (c, b, a)
            try:
                day = datetime.date(int(y), int(m), int(d)).toordinal()
            except ValueError:
                continue
            if not _FIRST_DAY <= day <= _LAST_DAY:
                return None
            # Days up to the 12th, which may read as months too, and later ones are permuted among themselves: so the pseudonym is
            # read in the same order again, and one date has one pseudonym in every notation.
            return self._day(day, order, mark, early=int(d) <= 12)
        return None

    def _day(self, day: int, order: str, mark: str, early: bool) -> str:
        label, bound = f"date {early}", _LAST_DAY - _FIRST_DAY + 1
        while True:
            day = _FIRST_DAY + self.permute(label, bound, day - _FIRST_DAY)
            x = datetime.date.fromordinal(day)
            if (x.day <= 12) == early:
                break
        parts = {"y": f"{x.year:04d}", "m": f"{x.month:02d}", "d": f"{x.day:02d}"}
        return mark.join(parts[k] for k in order)

    def _phone(self, s: str) -> str | None:
        digits = re.sub("[^0-9]", "", s)
        if not 7 <= len(digits) <= 15:
            return None
        # The country code stays; all other digits are permuted together, alike with and without a code.
        code = re.match(r"\+([0-9]{1,3})(?![0-9])", s) or _COUNTRY.match(s)
        keep = len(code[1]) if code else 0
        free = digits[keep:]
        new = str(self.permute(f"phone {len(free)}", 10 ** len(free), int(free))).zfill(len(free))
        return _put(s, digits[:keep] + new)

    def _iban_sized(self, text: str, start: int, end: int) -> tuple[int, str] | None:
        """(end, pseudonym) of the IBAN at `start` that has its country's length."""
        size = _IBAN_SIZES.get(text[start : start + 2])
        return self._iban_within(text, start, end + 1, int(size)) if size else None

    def _iban_within(self, text: str, start: int, end: int, size: int | None = None) -> tuple[int, str] | None:
        """The same for the longest valid IBAN that ends at a border before `end`, or the one of `size` characters."""
        for b in range(end - 1, start + 14, -1):
            if text[b - 1] != " " and not text[b : b + 1].isalnum() and (not size or b - start - text.count(" ", start, b) == size):
                new = self._iban(text[start:b])
                if new is not None:
                    return b, new
        return None

    def _cards_at(self, text: str, start: int, end: int) -> Iterator[tuple[int, bool]]:
        """Ends up to `end` of valid card numbers that begin at `start`, and whether their groups are usual ones; those first, then the longest."""
        at, sizes, ends = start, [], []
        while m := _GROUP.match(text, at):
            sizes.append(m.end() - at)
            if m.end() > end or sum(sizes) > 19:
                break
            if sum(sizes) >= 13 and not text[m.end() : m.end() + 1].isalpha():
                ends.append((tuple(sizes) in _CARD_FORMS, m.end()))
            at = m.end() + 1
            if text[m.end() : at] not in (" ", "-"):
                break
        for usual, b in sorted(ends, reverse=True):
            flat = re.sub("[ -]", "", text[start:b])
            if str(_luhn(flat[:-1])) == flat[-1] and not _DATES.search(text, start, b):
                yield b, usual

    def _card_within(self, text: str, start: int, end: int) -> tuple[int, str] | None:
        """(end, pseudonym) of a card number that begins at `start` and ends at a border up to `end`. One of unusual groups gives way to one of
        usual groups that begins within it; one with a calendar date in it isn't taken."""
        for b, usual in self._cards_at(text, start, end):
            later = (m.end() for m in _MARK.finditer(text, start, b)) if not usual else ()
            if any(u for a in later if text[a - 1] == " " for _, u in self._cards_at(text, a, len(text))):
                return None
            return b, self._card(text[start:b])
        return None

    def _plus_end(self, text: str, start: int, end: int) -> int:
        """Where a number that begins with a plus sign ends: at a border of its groups, outside of brackets. Ten digits follow the codes 1 and 7; a first run of eight
        digits or more is the whole number; else as many groups as make 13 digits at most."""
        borders = [m.end() for m in _GROUP.finditer(text, start, end) if text.count("(", start, m.end()) == text.count(")", start, m.end())] or [end]
        sizes = [sum(c.isdigit() for c in text[start:b]) for b in borders]
        if text[start + 1] in "17" and 11 in sizes:
            return borders[sizes.index(11)]
        fit = [b for b, n in zip(borders, sizes, strict=True) if 7 <= n <= 13]
        return borders[0] if sizes[0] >= 8 or not fit else fit[-1]

    def mask(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what they replaced, in code points of the text given, in order. What has a form of its own comes first (dates, numbers with a
        plus sign, social security and firmly grouped phone numbers), but in mail addresses, then all others between those, bare phone numbers last: so digits beside a value
        neither hide it nor become a part of it."""
        found: list[tuple[int, int, str, str]] = []
        mail = "@" in text
        if not mail and not _DIGIT.search(text):
            return text, []
        mails = [m.span() for m in _MAILS.finditer(text)] if mail else []

        def gaps() -> list[tuple[int, int]]:
            found.sort()
            ends, starts = [0, *(f[1] for f in found)], [*(f[0] for f in found), len(text)]
            return [(a, b) for a, b in zip(ends, starts, strict=True) if a < b]

        def put(kind: str, start: int, end: int) -> bool:
            i = bisect_left(mails, (end,)) - 1  # the last mail address that begins before the end
            new = None if i >= 0 and mails[i][1] > start else getattr(self, f"_{kind}")(text[start:end])
            if new is not None:
                found.append((start, end, kind, new))
            return new is not None

        for m in _DATES.finditer(text):
            put("date", *m.span())
        for a, b in gaps():
            at = a
            while m := _PLUSES.search(text, at, b):
                end = self._plus_end(text, m.start(), m.end())
                at = end if put("phone", m.start(), end) else m.start() + 1
        for kind, firm in (("ssn", _SSNS), ("phone", _FIRMS)):
            for a, b in gaps():
                for m in firm.finditer(text, a, b):
                    put(kind, *m.span())
        pattern = _ALL if mail else _NO_MAIL
        for a, b in gaps():
            at = a
            while m := pattern.search(text, at, b):
                kind, start, end = m.lastgroup, m.start(), m.end()
                new = self._iban_sized(text, start, end) if kind == "iban" else None
                if new is None:
                    new = end, getattr(self, f"_{kind}")(m[0])
                if new[1] is None and kind in ("iban", "card"):
                    new = (self._iban_within if kind == "iban" else self._card_within)(text, start, end) or new
                if new[1] is None and kind == "card":  # after a space the search begins anew by itself, after a hyphen it doesn't
                    for g in _GROUP.finditer(text, start + 1, min(b, _CHAIN.match(text, start).end())):
                        if text[g.start() - 1] == "-" and (later := self._card_within(text, g.start(), b)):
                            start, new = g.start(), later
                            break
                # What fails its check takes nothing with it: the search goes on behind its start.
                end, new = new
                if new is not None:
                    found.append((start, end, kind, new))
                at = end if new is not None or kind == "mail" else start + 1
        mails, known = [], -1  # those that are mail are found by now
        while known < len(found):  # a number that is found no longer hides the one beside it
            known = len(found)
            for a, b in gaps():
                for m in _PHONES.finditer(text[a:b]):
                    put("phone", a + m.start(), a + m.end())
        out, at = [], 0
        found.sort()
        for a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


def restore(text: str, spans: list[tuple[str, int, int]], key: bytes) -> str:
    """The original of a text that Masker(key).mask gave with these spans."""
    back, out, at, last = Masker(key, undo=True), [], 0, 0
    for kind, a, b in spans:
        out.append(text[at : at + a - last])
        at += a - last
        end = _IPS.match(text, at).end() if kind == "ip" else at + b - a  # all others keep their length
        out.append(getattr(back, f"_{kind}")(text[at:end]))
        at, last = end, b
    return "".join([*out, text[at:]])


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """All columns of docs with pseudonyms in the text, and pii_spans (kind, start, end of the values in the original text, code points,
    end exclusive). A null text stays null and has no spans, an empty one stays empty; an empty table gives no rows, repeated rows stay. Every
    other column is passed on as it is; one named pii_spans, in any case, gives way. Whole texts, one narrow pass."""
    shown = docs.columns
    stay = kept_columns(docs, ["pii_spans"])
    docs, (text,) = plain(docs, text)
    own = [f"c{i}" for i in stay if f"c{i}" != text]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = Masker(key)
        for batch in batches:
            texts, spans = [], []
            for t in batch.column(0):
                t = t.as_py()
                new, found = (None, []) if t is None else masker.mask(t)
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:], pa.array(spans, span)], [text, *own, "pii_spans"])

    schema = [f"{text} string", *([fields(docs, own)] if own else []), "pii_spans array<struct<kind:string,start:bigint,end:bigint>>"]
    done = docs.select(text, *own).mapInArrow(run, ", ".join(schema)).select(*[f"c{i}" for i in stay], "pii_spans")
    return done.toDF(*[shown[i] for i in stay], "pii_spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

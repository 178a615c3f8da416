"""Quality rules: base counts of a text, and the likelihood ratio of its hashed n-grams under two multinomials.

The raw multinomial counts the hashed character n-grams (of UTF-8 bytes, NGRAMS long) of every document. The target
multinomial counts those of trusted documents: at most SAMPLE rows labelled good, those with the smallest hash of
their id. A document's score is the mean over its n-grams of log p(target) - log p(raw), so length doesn't matter. The
threshold is fixed before any document is judged: of the labelled sample's scores, the cut with the best sum of the
good rows kept and the bad rows rejected, which keeps KEEP of the good ones at least. Each document is then kept or not by that
threshold alone; nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, fields, kept_columns, mix, plain, same_spans, slices, span_hashes, sums, text_bytes, word_spans

NGRAMS = (1, 2)
BUCKETS = 1 << 16
SAMPLE = 4000  # most labelled rows of each kind
KEEP = 0.99
#: The contract's base rules. Fixed values.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, and the least mean ratio that is kept."""

    ratio: np.ndarray
    threshold: float


def _ngrams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets) of the n-grams inside each row, for each n of NGRAMS."""
    for n in NGRAMS:
        room = max(0, len(raw) - n + 1)
        h = np.zeros(room, np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= raw[j : j + room]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(16)
        last = np.maximum(offsets[:-1], offsets[1:] - n + 1)  # an n-gram lies within its row
        inside = np.zeros(room + 1, np.int8)
        if room:
            np.add.at(inside, np.minimum(offsets[:-1], room), 1)
            np.add.at(inside, np.minimum(last, room), -1)
            h = h[np.cumsum(inside[:room], dtype=np.int8) > 0]
        yield h, np.concatenate(([0], np.cumsum(np.minimum(last, room) - np.minimum(offsets[:-1], room))))


def _score(raw: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for buckets, ends in _ngrams(raw, offsets):
        total += sums(ratio[buckets], ends, np.float64)
        n += np.diff(ends)
    return total / np.maximum(n, 1)


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts of each row."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(raw, offsets)
    words = np.bincount(rows, minlength=n)
    ink = np.cumsum(np.concatenate(([0], ~SPACE[raw] & ((raw & 0xC0) != 0x80))))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    signs = np.cumsum(np.concatenate(([0], symbol[raw])))
    # Lines: between line feeds and the ends of rows. Of equal lines of a row, all but the first count.
    feeds = np.flatnonzero(raw == 10)
    a = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
    row = np.repeat(np.arange(n), np.bincount(np.searchsorted(offsets, feeds, "right") - 1, minlength=n) + 1)
    b = np.concatenate((a[1:], offsets[-1:]))
    b = np.where(np.concatenate((row[1:] == row[:-1], [False])), b - 1, b)
    full = ink[b] > ink[a]
    a, b, row = a[full], b[full], row[full]
    dup_lines = np.bincount(row, minlength=n) - np.bincount(row[_firsts(raw, a, b, row)], minlength=n)
    # Windows of words, by the hashes of their words in order.
    repeats = np.zeros(n, np.int64)
    count = len(starts) - REPEAT_WINDOW + 1
    if count > 0:
        h = span_hashes(raw, starts, ends)
        w = np.zeros(count, np.uint64)
        for j in range(REPEAT_WINDOW):
            w = w * np.uint64(0xD6E8FEB86659FD93) + h[j : j + count]
        inside = np.flatnonzero(rows[:count] == rows[REPEAT_WINDOW - 1 :])
        key = mix(w[inside] ^ mix(rows[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        x, y = inside[order[1:][same]], inside[order[:-1][same]]
        twin = np.zeros(len(k), bool)
        twin[1:] = same
        twin[:-1] |= same
        at = inside[order[twin]]
        if not _equal_windows(raw, starts, ends, rows, x, y):  # a clash of hashes: the words themselves decide
            at = _repeated(raw, starts, ends, rows, inside)
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + REPEAT_WINDOW, -1)
        repeats = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {
        "n_words": words,
        "word_chars": ink[offsets[1:]] - ink[offsets[:-1]],
        "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
    }


def _firsts(raw: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the spans that equal no earlier one of their row: by hashes, and all with equal hashes are compared."""
    key = mix(span_hashes(raw, a, b) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    head = np.ones(len(key), bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    first = order[head]
    of = first[np.cumsum(head) - 1]  # the first span of each one's group
    later, of = order[~head], of[~head]
    size = b - a
    like = (row[later] == row[of]) & (size[later] == size[of])
    if like.all() and same_spans(raw, a[later], a[of], size[later]).all():
        return first
    text, seen = raw.tobytes(), {}
    for i, (r, x, y) in enumerate(zip(row.tolist(), a.tolist(), b.tolist(), strict=True)):
        seen.setdefault((r, text[x:y]), i)
    return np.fromiter(seen.values(), np.int64)


def _equal_windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the windows that begin with words x and y have the same words in the same rows."""
    if not (rows[x] == rows[y]).all():
        return False
    # Windows overlap: each pair of words at the same place is compared once.
    pairs = np.unique(np.concatenate([(x + j) << 32 | (y + j) for j in range(REPEAT_WINDOW)])) if len(x) else np.zeros(0, np.int64)
    i, j = pairs >> 32, pairs & 0xFFFFFFFF
    size = ends - starts
    return bool((size[i] == size[j]).all() and same_spans(raw, starts[i], starts[j], size[i]).all())


def _repeated(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> np.ndarray:
    text, known = raw.tobytes(), {}
    ids = [known.setdefault(text[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    keys = [(r, *ids[i : i + REPEAT_WINDOW]) for i, r in zip(inside.tolist(), rows[inside].tolist(), strict=True)]
    count: dict[tuple, int] = {}
    for k in keys:
        count[k] = count.get(k, 0) + 1
    return inside[[count[k] > 1 for k in keys]]


def labelled_sample(labels: DataFrame, most: int = SAMPLE) -> tuple[list[int], list[int]]:
    """Ids of at most `most` good and `most` bad rows: quality 1 and not toxic, quality 0. Of all labels those with the smallest hash of
    their id, so the choice depends on no order. Null ids and labels are left out."""
    chosen = []
    for good in (F.col("quality").eqNullSafe(1) & ~F.col("toxic").eqNullSafe(1), F.col("quality").eqNullSafe(0)):
        rows = labels.filter(good & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        chosen.append([r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()])
    return chosen[0], chosen[1]


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, keep: float = KEEP, key: str = "doc_id", text: str = "text") -> Model:
    """Two passes over the documents: counts over all of them, then the scores of the labelled sample. The driver gets
    BUCKETS rows of sums and at most 2 * `sample` scores. Without good rows every ratio is 0 and everything is kept."""
    docs, (key, text) = plain(docs, key, text)
    good, bad = labelled_sample(labels, sample)
    trusted = np.array(sorted(good), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_ = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            own = np.isin(np.array(batch.column(0).fill_null(-(1 << 63))), trusted)
            for a, b in slices(offsets):
                part, ends = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                mark = own[a:b]
                for buckets, at in _ngrams(part, ends):
                    sums_[0] += np.bincount(buckets, minlength=BUCKETS)
                    if mark.any():
                        sums_[1] += np.bincount(buckets[np.repeat(mark, np.diff(at))], minlength=BUCKETS)
        full = np.flatnonzero(sums_[0])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums_[0][full]), pa.array(sums_[1][full])], ["bucket", "raw", "target"])

    rows = docs.select(F.col(key).cast("long"), F.col(text))
    counts = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toPandas().to_numpy()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if len(counts):
        raw[counts[:, 0]], target[counts[:, 0]] = counts[:, 1], counts[:, 2]
    if not target.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    # Additive smoothing, a share of the raw distribution, so that an unseen n-gram isn't decided by the sample's size.
    p = raw / raw.sum()
    smooth = 0.01 * target.sum()
    q = (target + smooth * p) / (target.sum() + smooth)
    ratio = np.log(np.where(raw > 0, q, 1.0)) - np.log(np.where(raw > 0, p, 1.0))
    judged = docs.sparkSession.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in bad], "judged_id long, good int")
    of_sample = docs.select(F.col(key).cast("long").alias("judged_id"), F.col(text).alias("text")).join(F.broadcast(judged), "judged_id")
    found = scores(of_sample, ratio, ["good"]).toPandas()
    return Model(ratio, _threshold(found["score"].to_numpy(), found["good"].to_numpy(bool), keep))


def _threshold(score: np.ndarray, good: np.ndarray, keep: float) -> float:
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    caught = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    value = np.where(lost <= 1 - keep, caught - lost, -np.inf)
    value[1:-1][s[1:] == s[:-1]] = -np.inf  # a cut lies between different scores
    k = int(value.argmax())
    return -np.inf if k == 0 else float(s[k - 1] + s[min(k, len(s) - 1)]) / 2


def scores(rows: DataFrame, ratio: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns `keep` and the score of the column text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            out = [np.zeros(0)] + [_score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ratio) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(out))], [*batch.schema.names[1:], "score"])

    return rows.select("text", *keep).mapInArrow(run, f"{fields(rows, keep)}, score double")


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Base counts, base_failed, score and kept of every whole text; with `carry` after all columns of docs, else after
    doc_id. A null or empty text has no words and fails; null and repeated keys are kept, an empty table gives no rows; a column of docs
    that has the name of a result, in any case, gives way to it. One narrow pass."""
    ratio, threshold = model.ratio, model.threshold
    results = [*_BASE, "base_failed", "score", "kept"]
    shown = docs.columns
    own = [f"c{i}" for i in kept_columns(docs, results)] if carry else []
    docs, (key, text) = plain(docs, key, text)
    names = own if carry else ["doc_id"]
    rows = docs.select(F.col(text).alias("_input"), *(own if carry else [F.col(key).cast("long").alias("doc_id")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            found = {n: [np.zeros(0, np.int64)] for n in _BASE}
            score = [np.zeros(0)]
            for a, b in slices(offsets):
                part, ends = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for n, x in base_counts(part, ends).items():
                    found[n].append(x)
                score.append(_score(part, ends, ratio))
            base = {n: np.concatenate(x).astype(np.int64) for n, x in found.items()}
            score = np.concatenate(score)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            columns = [*batch.columns[1:], *(pa.array(base[n]) for n in _BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *results])

    head = fields(docs, own) if carry else "doc_id long"
    done = rows.mapInArrow(run, ", ".join([head] * bool(head) + [f"{n} long" for n in _BASE] + ["base_failed boolean", "score double", "kept boolean"]))
    return done.toDF(*[shown[int(c[1:])] for c in own], *results) if carry else done

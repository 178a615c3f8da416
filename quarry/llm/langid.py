"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every training row counts its n-grams (code points of the lower-cased text, n from 1 to 3) for its language; counts are summed in
each task, then over tasks, with one pass over the documents. The matrix of log probabilities (BUCKETS rows, a column for each
language) goes to every task, which scores batches of texts as sparse rows: gathered rows of the matrix, summed text by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fields, kept_columns, plain, sums

NGRAMS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTH = 0.5
UNKNOWN = "und"
LANGUAGES = 64  # counted in one pass, so that no task holds more than BUCKETS * LANGUAGES counts
GRID = 1 << 12  # cells of one unit of likeness, in which all rows that trained are counted
_CHARS = 1 << 19  # code points taken at once


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logp: np.ndarray  # BUCKETS x languages
    prior: np.ndarray
    rows: int = 0  # that trained


def held_out(key: Column) -> Column:
    """Rows that never train: crc32 of the id as text, modulo 4, is 2. A null id trains."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about _CHARS code points."""
    held, size, first = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= _CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets) of each text's n-grams, for each n. A text stands between two marks, so its ends count too."""
    coded = [b"\x02\0\0\0" + t.lower().encode("utf-32-le", "surrogatepass") + b"\x02\0\0\0" for t in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    c = np.frombuffer(b"".join(coded), np.uint32)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    for n in NGRAMS:
        room = len(c) - n + 1
        h = np.full(room, n, np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= c[j : j + room]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(16)
        if n > 1:  # none across two texts
            across = np.concatenate([offsets[1:-1] - j for j in range(1, n)]) if len(offsets) > 2 else np.zeros(0, np.int64)
            h = np.delete(h, across)
        yield h, np.concatenate(([0], np.cumsum(sizes - n + 1)))


def _trains(key: str, text: str, lang: str) -> Column:
    return F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from the texts and languages of all rows that aren't held out and have both. A pass over the documents counts LANGUAGES languages, and the
    driver gets one row of sums for each bucket and language of it. The model has BUCKETS numbers for each language, however many there are."""
    docs, (key, text, lang) = plain(docs, key, text, lang)
    rows = docs.filter(_trains(key, text, lang)).select(F.col(lang).cast("string").alias("lang"), F.col(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs_: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, texts in _batches(batch.column(1)):
                own = langs[first : first + len(texts)]
                names, place = np.unique(own.astype(str), return_inverse=True)
                for name, n in zip(names, np.bincount(place, minlength=len(names)), strict=True):
                    docs_[name] = docs_.get(name, 0) + int(n)
                for h, at in _ngrams(texts):
                    cell = np.repeat(place, np.diff(at)) * BUCKETS + h
                    found = np.bincount(cell, minlength=BUCKETS * len(names)).reshape(-1, BUCKETS)
                    for name, x in zip(names, found, strict=True):
                        total[name] = total[name] + x if name in total else x
        for name, x in total.items():
            full = np.flatnonzero(x)
            buckets = np.concatenate(([-1], full))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(buckets)), pa.array(buckets), pa.array(np.concatenate(([docs_[name]], x[full])))], ["lang", "bucket", "n"])

    languages = tuple(sorted(r[0] for r in rows.select("lang").distinct().collect()))
    logp, rows_of = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    for first in range(0, len(languages), LANGUAGES):
        block = languages[first : first + LANGUAGES]
        own = rows.filter(F.col("lang").isin(*block)) if len(languages) > LANGUAGES else rows
        found = own.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        at = found["lang"].map({x: i for i, x in enumerate(block)}).to_numpy(int)
        bucket, n = found["bucket"].to_numpy(int), found["n"].to_numpy(float)
        counts = np.zeros((BUCKETS, len(block)))
        head = bucket < 0
        rows_of[first + at[head]] = n[head]
        counts[bucket[~head], at[~head]] = n[~head]
        logp[:, first : first + len(block)] = np.log(counts + SMOOTH) - np.log(counts.sum(axis=0) + SMOOTH * BUCKETS)
    return Model(languages, logp, np.log(np.maximum(rows_of, 1)) - np.log(max(rows_of.sum(), 1)), int(rows_of.sum()))


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", carry: bool = False, likeness: bool = False) -> DataFrame:
    """held_out, lang_pred and score (posterior probability of lang_pred) of every whole text, with `likeness` also the mean log probability of
    an n-gram in lang_pred, which unlike the posterior doesn't grow surer with the length (null for `und`); with `carry` after all columns of docs, else
    after doc_id. A null text, one without a letter, and any text where nothing was learned get `und` and score 0. The first of equal
    languages by name wins. Null and repeated keys are kept, an empty table gives no rows; a column of docs with the name of a result, in any
    case, gives way to it."""
    results = ["held_out", "lang_pred", "score"] + ["likeness"] * likeness
    shown = docs.columns
    own = [f"c{i}" for i in kept_columns(docs, results)] if carry else []
    docs, (key, text) = plain(docs, key, text)
    names = own if carry else ["doc_id"]
    rows = docs.select(F.col(text).alias("_input"), held_out(F.col(key)).alias("_held"), *(own if carry else [F.col(key).cast("long").alias("doc_id")]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp, prior, languages = sent.value.logp, sent.value.prior, sent.value.languages
        for batch in batches:
            guesses, scores, means = [], [], []
            for _, texts in _batches(batch.column(0)):
                if languages:
                    total, n = np.tile(prior, (len(texts), 1)), np.zeros(len(texts))
                    for h, at in _ngrams(texts):
                        n += np.diff(at)
                        total += np.stack([sums(logp[:, k][h], at, np.float64) for k in range(len(languages))], axis=1)
                    best = total.argmax(axis=1)
                    mean = (total.max(axis=1) - prior[best]) / n
                    sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, t in enumerate(texts):
                    known = bool(languages) and any(map(str.isalpha, t))
                    guesses.append(languages[best[i]] if known else UNKNOWN)
                    scores.append(float(sure[i]) if known else 0.0)
                    means.append(float(mean[i]) if known else None)
            columns = [*batch.columns[2:], batch.column(1), pa.array(guesses, pa.string()), pa.array(scores, pa.float64()), pa.array(means, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns[: len(names) + len(results)], [*names, *results])

    head = fields(docs, own) if carry else "doc_id long"
    done = rows.mapInArrow(run, ", ".join([head] * bool(head) + ["held_out boolean", "lang_pred string", "score double"] + ["likeness double"] * likeness))
    return done.toDF(*[shown[int(c[1:])] for c in own], *results) if carry else done


def least_likeness(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> float:
    """The likeness that a text in a learned language has at least: as far below the lowest hundredth of the rows that trained as that is below
    their median. All of them are counted by cells of 1 / GRID; a mean log probability of n-grams has few of those, and the driver gets their counts alone."""
    docs, (key, text, lang) = plain(docs, key, text, lang)
    seen = predict(docs.filter(_trains(key, text, lang)), model, key=key, text=text, likeness=True).filter("likeness IS NOT NULL")
    counts = seen.groupBy(F.floor(F.col("likeness") * GRID).alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    if not counts:
        return 0.0
    cells, ends = np.array([r.cell for r in counts]) / GRID, np.cumsum([r.n for r in counts])

    def quantile(p: float) -> float:
        place = p * (int(ends[-1]) - 1)
        low, high = (cells[np.searchsorted(ends, x, "right")] for x in (np.floor(place), np.ceil(place)))
        return float(low + (place - np.floor(place)) * (high - low))

    low, middle = quantile(0.01), quantile(0.5)
    return low - (middle - low)

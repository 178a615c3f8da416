"""Importance resampling towards a target distribution: documents whose hashed word n-grams look like the target's are drawn more often.

Features of all documents and of all target texts are counted into buckets (one row of counts from each task), which gives each bucket an
integer gain. A document's weight is the floored mean of its features' gains, read from an array; a keyed random term makes the score. The draw is exact and needs no
sort of the table: scores are integers, so a histogram of them, summed from the top, gives the score at which the draw ends and the first
rank of every score above it; within a score rows are numbered by key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, plain, scratch, slices, sums, text_bytes

#: Bytes of words are 0-9, a-z (after A-Z are lower-cased) and all from 0x80 on; others part words.
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_MOST = 1 << 18  # words whose buckets a task remembers
_PIECE = 1 << 20  # bytes of a text that are split at once
HOT = 1 << 20  # rows of one score that are numbered in one task
_SLICES = 256


class _Buckets(dict):
    """Bucket of each feature, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < _MOST:
            self[feature] = found
        return found


def _features(text: bytes, most: int) -> Iterator[list[bytes]]:
    """Runs of 1 to `most` consecutive words of a translated text, joined by a space, a piece of the text at a time."""
    at, held = 0, []
    while at < len(text):
        end = text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        at = end
        found = list(words)
        before, held = held, ([*held, *words])[-(most - 1) :] if most > 1 else []
        for n in range(2, most + 1):
            line = [*before[-(n - 1) :], *words]
            found += [b" ".join(line[i : i + n]) for i in range(len(line) - n + 1)]
        yield found


def _scored(column: pa.Array, ngrams: int, known: _Buckets) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets of all features, their offsets by row) of slices of a batch; a long text comes in several, each with its row."""
    raw, offsets = text_bytes(column)
    for a, b in slices(offsets):
        text = raw[offsets[a] : offsets[b]].tobytes().translate(_WORD)
        if b - a == 1:
            for found in _features(text, ngrams):
                yield a, np.fromiter(map(known.__getitem__, found), np.int64, len(found)), np.array([0, len(found)])
            continue
        found, ends = [], [0]
        for i in range(a, b):
            for part in _features(text[offsets[i] - offsets[a] : offsets[i + 1] - offsets[a]], ngrams):
                found += part
            ends.append(len(found))
        yield a, np.fromiter(map(known.__getitem__, found), np.int64, len(found)), np.array(ends)


def bucket_counts(texts: DataFrame, buckets: int, ngrams: int = 1, *, text: str = "text") -> np.ndarray:
    """How many features of all whole texts fall into each bucket. Each task sends one row for each of its buckets, the driver gets one for each."""
    own, (text,) = plain(texts, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in _scored(batch.column(0), ngrams, known):
                total += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in own.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over its share of all, each smoothed by one."""
    k, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str, seed: int) -> Column:
    """floor of 1000 times a Gumbel term that depends on seed and key alone; the text of the key is `seed:` for a null one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, ngrams: int = 1, seed: int = 2024, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    own, (key, text) = plain(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(len(sent.value))
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, found, at in _scored(batch.column(2), ngrams, known):
                n[first : first + len(at) - 1] += np.diff(at)
                total[first : first + len(at) - 1] += sums(sent.value[found], at)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            words = _words_of(n, ngrams)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(weight), pa.array(weight + batch.column(1).to_numpy())], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = own.select(F.col(key).cast("long").alias("doc_id"), noise(key, seed).alias("noise"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _words_of(features: np.ndarray, ngrams: int) -> np.ndarray:
    """Words of texts with so many runs of 1 to ngrams words."""
    fewest = ngrams * (ngrams + 1) // 2  # runs of ngrams words
    full = (features + fewest - ngrams) // ngrams
    short = np.cumsum([0, *range(1, ngrams + 1)])  # w words, fewer than ngrams, have 1 + 2 + ... + w runs
    return np.where(features >= fewest, full, np.searchsorted(short, features, "right") - 1)


def draw(scored: DataFrame, percent: int, least_words: int, *, hot: int = HOT) -> DataFrame:
    """The columns of scored and rank: of the N rows with at least `least_words` words the floor(percent * N / 100) with the highest scores, ties to
    the smaller doc_id (null last), have their places from 1 on; the others have null.

    The driver gets one number for each different score of a row with enough words: scores are integers between bounds that buckets' counts and the
    noise's 32 bits set (some 10^5 values at any size). A score with more than `hot` rows is numbered in several parts, by ranges of doc_id."""
    fit = F.col("n_words") >= least_words
    counts = scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("score", ascending=False)
    room = int(counts["n"].sum()) * percent // 100
    before = (counts["n"].cumsum() - counts["n"]).to_numpy()
    places = {int(s): (int(b), int(n)) for s, b, n in zip(counts["score"], before, counts["n"], strict=True) if b < room}
    if not places:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cutoff = min(places)
    drawn = scored.filter(fit & (F.col("score") >= cutoff))
    # Parts of scores: whole ones but for the hot, which are cut at quantiles of their keys.
    cuts = dict.fromkeys((s for s, (_, n) in places.items() if n > hot), ())
    if cuts:
        at = F.percentile_approx("doc_id", F.array(*(F.lit((i + 1) / _SLICES) for i in range(_SLICES - 1))), F.lit(10000))
        cuts = {r.score: tuple(sorted({*(r.cuts or ())})) for r in drawn.filter(F.col("score").isin(*cuts)).groupBy("score").agg(at.alias("cuts")).collect()}
    spark = scored.sparkSession
    edges = spark.createDataFrame([(s, list(c)) for s, c in cuts.items()], "score long, cuts array<long>")
    part = F.when(F.col("doc_id").isNull(), F.size("cuts") + 1).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("doc_id"))))
    parted = drawn.join(F.broadcast(edges), "score", "left").withColumn("part", F.when(F.col("cuts").isNotNull(), part).otherwise(0)).drop("cuts")
    firsts = []
    if cuts:
        sizes: dict[int, int] = {}
        for r in parted.filter(F.col("score").isin(*cuts)).groupBy("score", "part").count().orderBy(F.desc("score"), "part").collect():
            firsts.append((r.score, r.part, places[r.score][0] + sizes.get(r.score, 0)))
            sizes[r.score] = sizes.get(r.score, 0) + r["count"]
    firsts += [(s, 0, b) for s, (b, _) in places.items() if s not in cuts]
    starts = spark.createDataFrame(firsts, "score long, part int, first long")
    within = F.row_number().over(Window.partitionBy("score", "part").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features"))
    place = F.col("first") + within
    ranked = parted.join(F.broadcast(starts), ["score", "part"]).withColumn("rank", F.when(place <= room, place)).select(*scored.columns, "rank")
    rest = scored.filter(~F.coalesce(fit & (F.col("score") >= cutoff), F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, *, ngrams: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if undrawn) of every document.

    Words are runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII. A null or empty text has no features and weight 0; without target
    texts the target is uniform over the buckets. Repeated rows are drawn each for itself, a null key is last among equal scores. An empty table gives no rows;
    other columns are ignored, whatever they are called. Two passes over the texts; scored rows are written once."""
    gain = gains(bucket_counts(docs, buckets, ngrams, text=text), bucket_counts(target, buckets, ngrams, text=text))
    out = scratch(docs.sparkSession, "scored")
    weigh(docs, gain, ngrams, seed, key=key, text=text).write.parquet(out)
    return draw(docs.sparkSession.read.parquet(out), percent, least_words)

"""Clustering, resampling and MinHash against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import plain_components

from quarry.llm import clustering, minhash, queries, resampling

# ---- centroids


def plain_lloyd(rows, clusters, rounds, size, scale, seed):
    kept = [(k, tuple(math.floor(scale * x) for x in v)) for k, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda k: hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    c = [v for _, v in sorted((name(k), v) for k, v in kept)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    found = [(k, *nearest(v)) for k, v in kept]
    of = Counter()
    for _, d, j in found:
        of[j] += d
    return Counter((k, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for k, d, j in found)


def vectors(n=300, size=4, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, 0.25, 3.0]) + rng.random() for _ in range(size)]) for i in range(n)]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [1.0] * 5)]
    return rows + odd + [rows[3], rows[3], (5, rows[7][1]), (None, rows[9][1]), (None, [0.0] * 4), (907, [-0.0, 1e-300, 5e-324, -1e-300])]


@pytest.mark.parametrize("clusters", [1, 7, 1000])
@pytest.mark.parametrize("rounds", [0, 3])
def test_clusters_equal_plain_lloyd(spark, clusters, rounds):
    rows = vectors()
    table = spark.createDataFrame([(v, k, "x") for k, v in rows], "embedding array<double>, vec_id long, cluster string").repartition(5)
    found, centroids = clustering.cluster(table, clusters, rounds, size=4, scale=10, seed=3)
    assert Counter(tuple(r) for r in found.collect()) == plain_lloyd(rows, clusters, rounds, 4, 10, 3)
    assert len(centroids.rows) == min(clusters, 306)


def test_clusters_of_nothing_and_of_long_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, centroids = clustering.cluster(empty)
    assert found.count() == 0 and not centroids.rows and found.columns[:3] == ["key", "cluster", "distance"]
    far = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds"):
        clustering.cluster(far)
    edge = clustering.largest(2)
    assert 2 * (2 * edge) ** 2 < 1 << 63 and clustering.distances(np.array([[edge, -edge]]), np.array([[-edge, edge]]))[0, 0] == 2 * (2 * edge) ** 2


def test_empty_centroids_stay_and_ties_go_to_the_smaller(spark):
    rows = [(i, [1.0, 1.0]) for i in range(6)] + [(9, [2.0, 2.0])]
    found, c = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 7, 2, size=2, scale=1)
    assert {r.cluster for r in found.collect() if r.key < 9} == {min(j for j, x in enumerate(c.rows) if x == (1, 1))} and c.rows.count((1, 1)) == 6


def test_cluster_query_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op11_centroid_clusters(spark, sf)
    want = con.execute(queries.oracle_sql()["op11_centroid_clusters"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall()) and names == got.columns


# ---- resampling


def plain_features(text, most):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, percent, ngrams, buckets, least, seed):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, ngrams)[1])
    s, t = count(x for _, x in rows), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for k, x in rows:
        n, f = plain_features(x, ngrams)
        w = sum(gain(zlib.crc32(y.encode()) % buckets) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[3], r[2]))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = i + 1
    return Counter(map(tuple, out))


TARGET = ["The cat sat", None, "", "Ça va tout de même " * 9, "x1 x2 X1 don't"]


@pytest.mark.parametrize("ngrams", [1, 3])
@pytest.mark.parametrize("percent", [0, 10, 55, 100])
def test_draws_equal_plain_ones(spark, docs, rows, ngrams, percent):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    own = docs.withColumns({c: F.lit(c) for c in ("rank", "weight", "_K", "c1")})
    got = resampling.resample(own, target, percent, ngrams=ngrams, buckets=97, least_words=3, seed=5)
    assert Counter(map(tuple, got.collect())) == plain_resample([r[:2] for r in rows], TARGET, percent, ngrams, 97, 3, 5)


@pytest.mark.parametrize("ngrams", [1, 2, 4])
def test_features_do_not_depend_on_pieces(monkeypatch, ngrams):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Ab", "c", "déf", "9", "-"]) for _ in range(rng.randint(0, 300))) for _ in range(20)]
    monkeypatch.setattr(resampling, "_PIECE", 7)
    for t in texts:
        n, want = plain_features(t, ngrams)
        got = Counter(f.decode() for p in resampling._features(t.encode().translate(resampling._WORD), ngrams) for f in p)
        assert got == Counter(want) and resampling._words_of(np.array([len(want)]), ngrams)[0] == n


def test_hot_scores_are_numbered_in_parts(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 500) if i % 9 else None, 30, 30, i % 4, 7 if i % 3 else i % 5) for i in range(900)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(4)
    got = sorted((tuple(r) for r in resampling.draw(scored, 70, 20, hot=50).collect() if r.rank), key=lambda r: r[5])
    want = sorted(rows, key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[3]))[:630]
    assert [r[5] for r in got] == list(range(1, 631)) and [r[:5] for r in got] == want


def test_resample_nothing(spark, empty, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, none).count() == 0
    assert resampling.resample(docs, none).count() == docs.count()


# ---- MinHash


def plain_sets(rows, size):
    out = []
    for k, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append((k, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    return out


def plain_classes(sets, percent):
    ids = range(len(sets))
    linked = [(i, j) for i in ids for j in range(i) if sets[i][1] and sets[j][1] and 100 * len(sets[i][1] & sets[j][1]) >= percent * len(sets[i][1] | sets[j][1])]
    part = plain_components(list(ids), linked)
    least = {}
    for i in ids:
        k = sets[i][0]
        if k is not None:
            least[part[i]] = min(k, least.get(part[i], k))
    return Counter((sets[i][0], len(sets[i][1]), least.get(part[i])) for i in ids)


def edited(rng, words, base, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in base)


@pytest.fixture(scope="module")
def families():
    """Originals with copies that are near them but not always near each other, chains, small sets, thresholds met exactly."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    texts = []
    for size, share in ((300, 0.03), (300, 0.06), (40, 0.05), (1200, 0.05)):
        base = [rng.choice(words) for _ in range(size)]
        texts += [" ".join(base)] + [edited(rng, words, base, share) for _ in range(25)]
    line = [rng.choice(words) for _ in range(200)]
    for _ in range(12):  # a chain
        line = line[12:] + [rng.choice(words) for _ in range(12)]
        texts.append(" ".join(line))
    texts += ["a b c d e f", "a b c d e", "a b c d e f g", "A  B\tc d e", "z", "z y", "y z", "z", None, "", " \n", "one", "ONE"]
    rng.shuffle(texts)
    return [(i + 10, t) for i, t in enumerate(texts)] + [(10, texts[5]), (3, "a b c d e"), (None, texts[0]), (None, "quite alone here"), (None, None)]


@pytest.mark.parametrize("size", [1, 2, 5])
@pytest.mark.parametrize("percent", [80, 95, 100])
def test_near_duplicates_equal_all_pairs(spark, families, size, percent):
    docs = spark.createDataFrame([(t, k, 1, "a") for k, t in families], "text string, doc_id long, node int, keys string").repartition(4)
    got = minhash.near_duplicates(docs, words=size, percent=percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_classes(plain_sets(families, size), percent)


def test_near_duplicates_on_awkward_rows(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(minhash, "STAR", 2)
    got = minhash.near_duplicates(docs, words=2)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_classes(plain_sets([r[:2] for r in rows], 2), 80)
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [1 << 21, 2000])
def test_open_buckets_lose_no_link(spark, families, monkeypatch, block):
    """Many buckets of unlike members, whole or in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = spark.createDataFrame(families, "doc_id long, text string")
    got = minhash.near_duplicates(docs, words=2, bands=48, rows=2)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_classes(plain_sets(families, 2), 80)


def test_groups_compare_each_pair_once_and_send_a_forest():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [np.sort(np.concatenate((base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 63, 6, dtype=np.uint64)))) for _ in range(40)]
    sketch = minhash.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 160)
    bits, keys = minhash.sketch_bits(sketch), minhash.band_keys(sketch, 32, 5)
    rows = [(i % 2, i, i % 7, s.tobytes(), b.tobytes(), k.tobytes()) for i, (s, b, k) in enumerate(zip(sets, bits, keys, strict=True))]
    near = lambda i, j: 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)
    for crossed in (False, True):
        own = [(r[0] if crossed else 0, *r[1:]) for r in rows]
        bucket = int(keys[0, 0].view(np.int64))
        found = list(minhash._Group(bucket, own, 80, 31).edges())
        assert all(near(i, j) and i % 7 != j % 7 and (not crossed or i % 2 != j % 2) for i, j in found) and len(found) < 7
        want = plain_components(list(range(7)), [(i % 7, j % 7) for i in range(40) for j in range(i) if near(i, j) and (not crossed or i % 2 != j % 2)])
        assert plain_components(list(range(7)), [(i % 7, j % 7) for i, j in found]) == want


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for size, shared in ((5, 4), (60, 48), (900, 720)):
        hits = []
        for _ in range(60):
            h = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            a, b = h[: (size + shared) // 2], np.concatenate((h[:shared], h[(size + shared) // 2 :]))
            s = minhash.sketches(np.concatenate((np.sort(a), np.sort(b))), np.array([0, len(a), len(a) + len(b)]), 160)
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - shared / size) < 0.05


def test_long_texts_in_pieces_have_the_same_words():
    text = ("Word " * 7 + "é" * 5000 + "\n") * 700
    (_, one, at), = minhash.word_hashes(pa.array([text]))
    (_, two, ends), = minhash.word_hashes(pa.array([text[:1000] , text[1000:]])) if len(text) < 1 << 19 else ((0, one, at),)
    words = text.lower().split()
    assert len(one) == len(words) == at[-1] and len(np.unique(one)) == len(set(words)) == 2 and len(two) == ends[-1]


def test_least_likeness_counts_every_row_that_trained(spark):
    from dataclasses import replace

    from quarry.llm import langid

    rows = [(i, " ".join(f"word{(i * j) % 97}" for j in range(1, 3 + i % 9)), "en" if i % 2 else "de") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.fit(docs)
    seen = [r.likeness for r in langid.predict(docs, model, likeness=True).filter("NOT held_out").collect()]
    low, middle = np.quantile(seen, [0.01, 0.5])
    for known in (model, replace(model, rows=10**9)):  # however many rows the model has seen
        assert langid.least_likeness(docs, known) == pytest.approx(low - (middle - low), abs=3 / langid.GRID)

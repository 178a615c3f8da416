"""Stored sparse index, stored vector collection, bucketed tables and stateful streams against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.operators.bucketed import BucketedTable
from quarry.operators.sparse_index import SparseIndex
from quarry.operators.vector_index import VectorIndex, recall
from quarry.session import cut_lineage, scratch
from quarry.streaming.limits import rate_limit_batch
from quarry.streaming.stateful import append_once, rate_limit_events, run_to_end

# ---- sparse


def plain_sparse(queries, postings, k):
    of = defaultdict(dict)
    for c, t, w in postings:
        if None not in (c, t, w):
            of[c][t] = max(w, of[c].get(t, w))
    out = Counter()
    asked = defaultdict(list)
    for q, t, w in queries:
        if t is not None and w is not None:
            asked[q].append((t, w))
    for q, terms in asked.items():
        scores = {c: sum(w * x[t] for t, w in terms if t in x) for c, x in of.items() if any(t in x for t, _ in terms)}
        for i, (c, s) in enumerate(sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k]):
            out[q, c, s, i + 1] += 1
    return out


def sparse_rows(rng, n, low):
    words = [f"w{i}" for i in range(60)]
    rows = [(c, t, float(rng.randint(low, 9))) for c in range(n) for t in rng.sample(words, rng.randint(0, 20))]
    rows += [(c, "every", float(c % 7)) for c in range(n)]  # a token that all rows have
    return rows + [(None, "w1", 1.0), (3, None, 1.0), (4, "w2", None), (5, "w3", 2.0), (5, "w3", 1.0)]


@pytest.mark.parametrize("low", [0, -5])
@pytest.mark.parametrize("skip", [None, True, False])
def test_sparse_index_equals_plain_search(spark, low, skip):
    rng = random.Random(3)
    rows = sparse_rows(rng, 300, low)
    asked = [(q, t, float(rng.randint(low, 5))) for q in range(20) for t in rng.sample([f"w{i}" for i in range(64)], rng.randint(1, 6))] + [(99, None, 1.0), (98, "w1", None), (97, "nowhere", 1.0), (96, "every", 1.0)]
    index = SparseIndex.build(spark.createDataFrame(rows, "chunk_id long, token string, weight double"), scratch(spark, "t"), buckets=5, shard=50, block=4)
    queries = spark.createDataFrame(asked, "query_id int, token string, weight double")
    got = Counter((r.query_id, r.chunk_id, r.score, r.rank) for r in index.search(queries, 7, skip=skip).collect())
    assert got == plain_sparse(asked, rows, 7)
    assert Counter((r.query_id, r.chunk_id, r.score, r.rank) for r in index.search(queries, 7, block=3, skip=skip).collect()) == got


def test_sparse_index_reads_the_tokens_buckets_alone(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "chunk_id string, token string, weight double")
    index = SparseIndex.build(rows, scratch(spark, "t"), buckets=16)
    h = spark.range(1).select(F.xxhash64(F.lit("x"))).first()[0]
    plan = index.of_tokens(np.array([h]))._jdf.queryExecution().executedPlan().toString()
    assert f"bucket#" in plan and f"IN ({h % 16})" in plan.replace("INSET", "IN") or f"= {h % 16})" in plan
    found = index.search(spark.createDataFrame([(1, "x", 3.0)], "query_id int, token string, weight double"), 5).collect()
    assert [(r.chunk_id, r.score, r.rank) for r in found] == [("a", 3.0, 1)]
    assert {tuple(r) for r in index.postings().collect()} == {("a", "x", 1.0), ("b", "y", 2.0)}


def test_skipped_blocks_are_few_where_one_is_enough(spark):
    rows = spark.createDataFrame([(i, "common", 1.0 + (i % 100 == 0) * 50) for i in range(2000)], "chunk_id long, token string, weight double")
    index = SparseIndex.build(rows, scratch(spark, "t"), shard=1 << 20, block=16)
    from quarry.operators.sparse_index import _Asked

    batch = _Asked([(1, [{"h": spark.range(1).select(F.xxhash64(F.lit("common"))).first()[0], "w": 2.0}])])
    need = index._needs(index.of_tokens(batch.tokens), batch, 10, "int")
    blocks = index.blocks()
    assert 1.0 < need[0] <= 51.0 and blocks.filter(F.col("top") >= float(need[0])).count() < blocks.count() / 5


def test_sparse_index_of_nothing(spark):
    index = SparseIndex.build(spark.createDataFrame([], "chunk_id long, token string, weight double"), scratch(spark, "t"))
    assert index.search(spark.createDataFrame([(1, "x", 1.0)], "query_id int, token string, weight double"), 3).count() == 0
    assert index.search(spark.createDataFrame([], "query_id int, token string, weight double"), 3).count() == 0


# ---- vectors


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(20, 12))
    rows = [(i, (heads[i % 20] + rng.normal(scale=0.3, size=12)).tolist()) for i in range(1500)]
    return [*rows, (2000, None), (2001, [1.0]), (2002, [0.0] * 12), (2003, rows[7][1]), (2004, [float("nan")] * 12), (None, rows[8][1])]


def test_vector_index(spark, cloud):
    rows = spark.createDataFrame(cloud, "chunk_id long, embedding array<double>").repartition(4)
    index = VectorIndex.build(rows, scratch(spark, "v"), lists=20)
    assert index.meta.size == 12 and index.rows().count() == len(cloud) and {r.key for r in index.rows().filter("list < 0").collect()} == {2000, 2001, 2004}
    queries = rows.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    finite = rows.filter("chunk_id IS NOT NULL AND chunk_id <> 2004")
    exact = retrieval.dense_search(queries, finite, 20, digits=12)
    whole = VectorIndex.build(finite, scratch(spark, "v"), lists=20)
    same = {tuple(r) for r in whole.search(queries, 20, digits=12).select("query_id", "chunk_id", "score", "rank").collect()}
    assert same == {tuple(r) for r in exact.select("query_id", "chunk_id", "score", "rank").collect()}
    found = recall(whole.search(queries, 20, probes=4), exact).first()
    assert found.n_queries == queries.filter("vector IS NOT NULL").count() and found.recall >= 0.9
    plan = whole.search(queries.limit(1), 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_vector_index_of_few_and_no_rows(spark):
    few = VectorIndex.build(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "chunk_id string, embedding array<float>"), scratch(spark, "v"))
    got = few.search(spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0])], "query_id int, vector array<double>"), 5).collect()
    assert [(r.query_id, r.chunk_id, round(r.score, 6)) for r in got] == [(1, "a", round(0.5**0.5, 6)), (1, "b", 0.0)]
    none = VectorIndex.build(spark.createDataFrame([], "chunk_id long, embedding array<float>"), scratch(spark, "v"))
    assert none.search(spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>"), 5).count() == 0


# ---- bucketed tables


def test_bucketed_changes_equal_plain_ones_and_touch_their_buckets(spark):
    rng, keys = random.Random(1), list(range(400))
    t = BucketedTable(spark, scratch(spark, "b"), "t", "id", 32)
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, v string")
    state, states = {k: "first" for k in keys}, []
    t.upsert(frame(state))
    states.append(dict(state))
    for i in range(4):
        some = rng.sample(range(450), 3)
        if i % 2:
            t.delete(frame(dict.fromkeys(some, "")))
            state = {k: v for k, v in state.items() if k not in some}
        else:
            t.upsert(frame(dict.fromkeys(some, f"change {i}")))
            state |= dict.fromkeys(some, f"change {i}")
        states.append(dict(state))
        old, new = t.manifest(i + 1), t.manifest(i + 2)
        assert 1 <= sum(old.get(b) != p for b, p in new.items()) <= 3
    for v, want in enumerate(states, 1):
        assert dict(map(tuple, t.read(v).collect())) == want
    assert t.find(5).count() == (5 in state) and len(t.find(5).inputFiles()) <= 1
    t.vacuum(2)
    assert t.versions() == [4, 5] and dict(map(tuple, t.read().collect())) == state and dict(map(tuple, t.read(4).collect())) == states[3]
    with pytest.raises(KeyError):
        t.read(1)


def test_bucketed_tables_that_are_empty_or_have_null_keys(spark):
    t = BucketedTable(spark, scratch(spark, "b"), "t", "id", 4)
    with pytest.raises(KeyError):
        t.read()
    t.write(spark.createDataFrame([], "id long, m map<string,string>"))
    assert t.read().count() == 0 and t.read().columns == ["id", "m"]
    t.upsert(spark.createDataFrame([(None, {"a": "1"}), (2, {"a": "1"})], "id long, m map<string,string>"))
    t.merge_payload(spark.createDataFrame([(2, {"b": "2"})], "id long, m map<string,string>"), "m")
    assert {(r.id, tuple(sorted(r.m.items()))) for r in t.read().collect()} == {(None, (("a", "1"),)), (2, (("a", "1"), ("b", "2")))}
    t.delete(spark.createDataFrame([(2,)], "id long"))
    assert [r.id for r in t.read().collect()] == [None]
    with pytest.raises(ValueError, match="_bucket"):
        t.write(spark.createDataFrame([(1, 1)], "id long, _bucket int"))


def test_a_manifest_is_never_written_twice(spark):
    t = BucketedTable(spark, scratch(spark, "b"), "t", "id", 4)
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    t.write(rows)
    late = BucketedTable(spark, t.root.rsplit("/", 1)[0], "t", "id", 4)
    late.versions = lambda: []  # a writer that has not seen the first version
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        late.write(rows)
    assert t.versions() == [1] and t.read().count() == 1


# ---- streams


@pytest.fixture(scope="module")
def event_rows():
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 3600), f"k{min(rng.randint(0, 9), 4)}") for i in range(600)]
    rows.sort(key=lambda r: r[1])
    return rows


def as_events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, s long, ip string").select("event_id", F.timestamp_seconds("s").alias("ts"), "ip")


def test_stateful_limit_equals_batch(spark, event_rows):
    folder, out = scratch(spark, "in"), scratch(spark, "out")
    for i in range(0, 600, 150):
        as_events(spark, event_rows[i : i + 150]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("event_id long, ts timestamp, ip string").option("maxFilesPerTrigger", 1).parquet(folder)
    run_to_end(rate_limit_events(stream, 3, 60.0, tie="event_id"), scratch(spark, "at"), append_once(out))
    want = rate_limit_batch(as_events(spark, event_rows), 3, 60.0, tie="event_id")
    assert {(r.event_id, r.accepted) for r in spark.read.parquet(out).collect()} == {(r.event_id, r.accepted) for r in want.collect()}
    assert {r.accepted for r in want.collect()} == {True, False}


def test_events_without_a_time_are_not_accepted(spark):
    folder, out = scratch(spark, "in"), scratch(spark, "out")
    spark.sql("SELECT 1L AS event_id, CAST(NULL AS TIMESTAMP) AS ts, 'a' AS ip UNION ALL SELECT 2L, timestamp_seconds(5), 'a'").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("event_id long, ts timestamp, ip string").parquet(folder)
    run_to_end(rate_limit_events(stream, 1, 60.0), scratch(spark, "at"), append_once(out))
    assert {(r.event_id, r.accepted) for r in spark.read.parquet(out).collect()} == {(1, False), (2, True)}


def test_batch_events_without_a_time_are_not_accepted(spark):
    rows = spark.sql("SELECT 1L AS event_id, CAST(NULL AS TIMESTAMP) AS ts, 'a' AS ip UNION ALL SELECT 2L, timestamp_seconds(5), 'a' UNION ALL SELECT 3L, timestamp_seconds(6), 'a'")
    for kind in ("log", "fixed"):
        assert {(r.event_id, r.accepted) for r in rate_limit_batch(rows, 1, 60.0, kind=kind).collect()} == {(1, False), (2, True), (3, False)}


def test_a_restart_takes_no_batch_twice(spark, event_rows):
    folder, out, at = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "at")
    for i in range(0, 600, 200):
        as_events(spark, event_rows[i : i + 200]).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema("event_id long, ts timestamp, ip string").option("maxFilesPerTrigger", 1).parquet(folder)
    seen, write = [], append_once(out)

    def breaks(batch, number):
        seen.append(number)
        write(batch, number)
        if len(seen) == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run_to_end(stream(), at, breaks)
    run_to_end(stream(), at, lambda b, n: (seen.append(n), write(b, n)))
    run_to_end(stream(), at, lambda b, n: (seen.append(n), write(b, n)))
    assert seen == [0, 1, 1, 2] and Counter(r.event_id for r in spark.read.parquet(out).collect()) == Counter(r[0] for r in event_rows)


# ---- trigrams


def plain_trigrams(t):
    low = (t or "").lower()
    return {low[i : i + 3] for i in range(len(low) - 2)}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 1.0])
def test_trigram_join_equals_all_pairs(spark, threshold):
    from quarry.operators.trigram import trigram_join

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(80)] + ["Straße", "STRASSE", None, "", "ab", "abc", "ABC", "abcabcabc", "日本語日本語", "日本語"]
    rows = list(enumerate(texts))
    left, right = spark.createDataFrame(rows[:50], "key int, text string"), spark.createDataFrame(rows[30:], "key int, text string")
    grams = {k: plain_trigrams(t) for k, t in rows}

    def like(a, b):
        both = grams[a] | grams[b]
        return len(grams[a] & grams[b]) / len(both) if both else 0.0

    got = {(r.left_key, r.right_key): r.similarity for r in trigram_join(left, right, threshold).collect()}
    assert got == {(a, b): like(a, b) for a, _ in rows[:50] for b, _ in rows[30:] if like(a, b) >= threshold}
    pairs = trigram_join(left, None, threshold)
    assert {(r.left_key, r.right_key) for r in pairs.collect()} == {(a, b) for a, _ in rows[:50] for b, _ in rows[:50] if a < b and like(a, b) >= threshold}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        trigram_join(left, right, 0)


@pytest.mark.parametrize("block", [2, 4096])
def test_late_interaction_deals_no_pairs(spark, block):
    from quarry.operators import token_index
    from quarry.operators.retrieval import maxsim_search

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=(1 + i % 3, 4)).tolist()) for i in range(120)] + [(500, None), (501, [])], "chunk_id long, tokens array<array<double>>")
    asked = spark.createDataFrame([(i, rng.normal(size=(2, 4)).tolist()) for i in range(7)], "query_id long, query_tokens array<array<double>>")
    index = token_index.build(rows, scratch(spark, "tokens"), lists=5)
    shown = lambda d: [(r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in d.orderBy("query_id", "rank").collect()]
    assert shown(token_index.search(index, asked, rows, 6, probes=5, block=block)) == shown(maxsim_search(asked, rows, 6))
    some = token_index.search(index, asked, rows, 200, probes=1, block=block)
    assert "Join" not in some._jdf.queryExecution().toString()
    lists = {}
    for r in index.rows().collect():
        lists.setdefault(r.key, set()).add(r.list)
    near = {r.query_id: {int(np.argmax(index.centroids @ np.array(t))) for t in r.query_tokens} for r in asked.collect()}
    assert {(q, c) for q, _, c, _ in shown(some)} == {(q, c) for q, own in near.items() for c, of in lists.items() if of & own}


# ---- pages


@pytest.fixture(scope="module")
def service(spark):
    from quarry.sources.paged import register

    register(spark)
    at = scratch(spark, "service")
    spark.range(0, 1050).selectExpr("id AS k", "IF(id % 7 = 0, NULL, concat('n', id)) AS name", "id / 4.0D AS x").repartitionByRange(3, "k").sortWithinPartitions("k").write.json(at)
    return {"transport": "quarry.sources.paged:JsonLines", "path": at, "columns": "k long, name string, x double", "by": "k", "page_size": "100"}


def test_paged_scan_and_pushed_filters(spark, service):
    whole = spark.read.format("paged").options(**service).load()
    assert whole.rdd.getNumPartitions() == 11
    assert sorted(r.k for r in whole.collect()) == list(range(1050)) and whole.filter("name IS NULL").count() == 150
    some = whole.filter("k >= 200 AND k < 420 AND x > 60")
    assert sorted(r.k for r in some.collect()) == list(range(241, 420)) and some.rdd.getNumPartitions() == 3
    assert whole.filter("k = 5000").count() == 0


def test_paged_stream_goes_on_from_its_offsets(spark, service):
    from quarry.sources.paged import run_pages

    out, at, seen = scratch(spark, "out"), scratch(spark, "at"), []
    write = append_once(out)
    stream = lambda partial: spark.readStream.format("paged").options(**service, partial=partial, pages_per_batch="4").load()

    def breaks(batch, number):
        seen.append(number)
        write(batch, number)
        if len(seen) == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run_pages(stream("false"), at, breaks)
    run_pages(stream("false"), at, lambda b, n: (seen.append(n), write(b, n)))
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(1000)) and seen == [0, 1, 1, 2]  # the last page isn't full
    run_pages(stream("true"), at, write)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(1050))


def test_pages_are_read_from_their_blocks_alone(spark, service, monkeypatch):
    from quarry.sources import paged

    at = scratch(spark, "service")
    spark.range(0, 5000).selectExpr("id AS k", "IF(id % 7 = 0, NULL, concat('n', id)) AS name", "id / 4.0D AS x").repartitionByRange(2, "k").sortWithinPartitions("k").write.json(at)
    options = service | {"path": at}
    plain = paged.JsonLines(options)
    want = {n: plain.page(n, 100, []) for n in (0, 10, 24, 25, 49, 50)}
    assert plain.count([]) == 5000 and want[50] == [] and all(len(want[n]) == 100 for n in (0, 10, 24, 25, 49))
    paged.index_lines(spark, at, "k")
    paged._table.cache_clear()
    paged._counted.cache_clear()
    read, seen = paged._read, []
    monkeypatch.setattr(paged, "_blocks_of", None)  # no file is read whole
    monkeypatch.setattr(paged, "_read", lambda path, block, conditions: (seen.append(block["rows"]), read(path, block, conditions))[1])
    indexed = paged.JsonLines(options)
    assert {n: indexed.page(n, 100, []) for n in want} == want and indexed.count([]) == 5000
    assert sum(seen) < 9 * paged.BLOCK
    seen.clear()
    some = [("k", ">=", 1200), ("k", "<", 1300)]
    assert indexed.count(some) == 100 and [r[0] for r in indexed.page(1, 60, some)] == list(range(1260, 1300)) and len(seen) < 5
    assert indexed.count([("k", "=", 5000)]) == 0


def test_many_pages_share_partitions_and_batches_grow(spark, service):
    from quarry.sources.paged import PARTITIONS, run_pages

    whole = spark.read.format("paged").options(**service | {"page_size": "1"}).load()
    assert whole.rdd.getNumPartitions() <= PARTITIONS and sorted(r.k for r in whole.collect()) == list(range(1050))
    out, at, seen = scratch(spark, "out"), scratch(spark, "at"), []
    write = append_once(out)
    stream = spark.readStream.format("paged").options(**service | {"page_size": "10"}, partial="true", pages_per_batch="1", growth="2").load()
    run_pages(stream, at, lambda b, n: (seen.append(n), write(b, n)))
    assert seen == list(range(7)) and sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(1050))


class Flaky:
    calls = 0
    schema, filters = "k long", {}

    def __init__(self, options):
        pass

    def count(self, conditions):
        return 1

    def page(self, number, size, conditions):
        Flaky.calls += 1
        if Flaky.calls < 3:
            raise TimeoutError
        return [(1,)]


def test_pages_are_asked_for_again():
    from quarry.sources.paged import fetch

    options = {"transport": f"{__name__}:Flaky", "wait": "0"}
    assert fetch(options, 0, []) == [(1,)] and Flaky.calls == 3
    Flaky.calls = 0
    with pytest.raises(TimeoutError):
        fetch(options | {"retries": "1"}, 0, [])


# ---- what the searches share


def test_term_vectors_count_the_texts_of_a_key_together(spark, monkeypatch):
    rng = random.Random(5)
    words = ["a", "b", "é", "zz", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(k, " , ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in (*range(40), *([7] * 30), 3, 3)] + [(50, None), (51, ""), (52, "12 !"), (None, "A a"), (None, "b")]
    want = Counter()
    for k in {k for k, _ in rows}:
        counts = Counter(w for own, t in rows if own == k for w in (t or "").lower().replace(",", " ").split() if w.isalpha())
        want.update((k, t, float(n)) for t, n in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:9])
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    for bytes_ in (1, 200, 4 << 20):
        monkeypatch.setattr(retrieval, "_TEXT", bytes_)
        assert Counter(map(tuple, retrieval.term_frequencies(df, top=9).collect())) == want


def test_best_rows_with_ties_roundings_and_nan():
    rng = np.random.default_rng(1)
    for digits in (None, 1):
        best, every = retrieval._Best(6, 4, 0.2, digits), [[] for _ in range(6)]
        for a in range(0, 600, 20):
            scores, keys = np.round(rng.random((6, 20)), 2), np.arange(a, a + 20)[::-1]
            scores[:, 3] = np.nan  # a row of NaN takes no other row away
            best.block(scores, keys)
            for q in range(6):
                every[q] += [(-(s if digits is None else np.round(s, digits)), key) for s, key in zip(scores[q], keys, strict=True) if not np.isnan(s)]
        got = best.batch(list("abcdef"), "string", "bigint").to_pylist()
        want = {(i, key, -s) for i, own in zip("abcdef", every, strict=True) for s, key in sorted(e for e in own if -e[0] >= 0.2)[:4]}
        assert {(r["query_id"], r["chunk_id"], r["score"]) for r in got} == want


def test_long_queries_deal_no_postings_and_leave_out_light_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"w{j}", float(1 + (2000 - i) // 100 * 10)) for i in range(2000) for j in range(20)], "chunk_id long, token string, weight double")
    index = SparseIndex.build(rows, scratch(spark, "t"))
    asked = spark.createDataFrame([(1, f"w{j}", 1.0) for j in range(20)], "query_id int, token string, weight double")
    found = index.search(asked, 5)
    assert "hashpartitioning(shard" not in found._jdf.queryExecution().executedPlan().toString()
    rowsum = spark.sparkContext.accumulator(0)

    class Counted(retrieval._Best):
        def block(self, scores, keys, at=None):
            rowsum.add(len(keys))
            super().block(scores, keys, at)

    monkeypatch.setattr(retrieval, "_Best", Counted)
    assert [r.chunk_id for r in index.search(asked, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert 0 < rowsum.value < 1500


def test_several_blocks_of_queries_count_words_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(retrieval, "cut_lineage", lambda df: made.append(df) or cut_lineage(df))
    docs = spark.createDataFrame([(i, f"a b w{'xyz'[i % 3]}") for i in range(30)], "chunk_id long, text string")
    asked = retrieval.term_frequencies(docs.select(F.col("chunk_id").alias("query_id"), "text"), key="query_id")
    one, several = (sorted(map(tuple, retrieval.sparse_search(asked, retrieval.term_vectors(docs), 4, block=b).select("query_id", "chunk_id", "score", "rank").collect())) for b in (4096, 7))
    assert one == several and len(one) == 120 and len(made) == 1


def test_a_vector_without_a_direction_takes_no_other_row_away(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)] + [(9, [float("inf"), 1.0])], "chunk_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    index = VectorIndex.build(rows, scratch(spark, "t"), lists=20)
    assert [r.chunk_id for r in index.search(asked, 3, digits=9).orderBy("rank").collect()] == [0, 1, 2]


def test_an_engine_keeps_its_terms_by_row(spark):
    from quarry.catalog.hybrid import LetterEmbedder
    from quarry.plans.engine import Engine

    texts = ["Ab zz é", None, "", "ÀB b İi"]
    chunks = spark.createDataFrame([(i, "p", t, "s") for i, t in enumerate(texts)], "chunk_id long, paper_id string, content string, section_title string")
    engine = Engine.build(chunks, LetterEmbedder())
    assert {r.chunk_id: dict(zip(r.tokens, r.weights)) for r in engine.postings.collect()}[0] == {"ab": 1.0, "zz": 1.0, "é": 1.0} and engine.postings.count() == 2
    want = [[(t or "").lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
    assert LetterEmbedder().embed(texts).tolist() == want

"""The pipeline's stages against plain versions, and run() against its stages."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tests.llm.test_new_operators import plain_sets
from tests.llm.test_operators import library, plain_base, plain_components

from quarry.llm import queries
from quarry.llm.common import BATCH_BYTES


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
        out.append(docs.collect())
        if f is not corpus_pipeline.STAGES[-1][1]:
            docs = spark.createDataFrame(out[-1], spark.read.parquet(f"{sf}/documents.parquet").schema)
    return out


def test_quality_stage_drops_what_fails_the_base(stages, spark, sf):
    before, after = stages[0], stages[1]
    failed = set()
    for r in before:
        n, _, _, _, repeats = plain_base(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            failed.add(r.doc_id)
    kept = {r.doc_id for r in after}
    assert not kept & failed
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, x in labels.items() if x.quality == 1 and not x.toxic and i not in failed]
    assert sum(i in kept for i in good) / len(good) >= 0.95


def test_language_stage_keeps_what_has_a_language(stages):
    assert len(stages[2]) >= 0.98 * len(stages[1]) and all(any(map(str.isalpha, r.text)) for r in stages[2])


def test_language_stage_drops_other_languages_and_gibberish(stages, spark, sf):
    rng = random.Random(3)
    odd = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 200))) for _ in range(30)]
    odd += ["Москва является столицей России и крупнейшим городом страны, в котором живут миллионы людей. " * 3, "中华人民共和国是一个位于东亚的国家,首都北京。 " * 9]
    odd += ["Polska jest krajem położonym w Europie Środkowej, nad Morzem Bałtyckim, w dorzeczu Wisły i Odry, a jej stolicą jest Warszawa. " * 2]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    mixed = spark.createDataFrame([*stages[1], *((10**6 + i, t, None, "odd", len(t)) for i, t in enumerate(odd))], schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, mixed, sf).collect()}
    assert not any(i >= 10**6 for i in kept) and len(kept) >= 0.98 * len(stages[1])


def test_duplicate_stage_keeps_one_of_each_class(stages):
    """All pairs of whole texts, by sets of five-word shingles: a similarity of 0.8 or more links them."""
    sets = {k: x for k, x in plain_sets([(r.doc_id, r.text) for r in stages[2]], 5)}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert linked and {r.doc_id for r in stages[3]} == set(plain_components(sets, linked).values())


def test_duplicate_stage_catches_edited_copies_and_nothing_else(spark, sf):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    base = [[rng.choice(words) for _ in range(300)] for _ in range(20)]
    rows = [(i, " ".join(b), "en", "s", 0) for i, b in enumerate(base)]
    rows += [(100 + i, " ".join([*b[:150], "edited", *b[151:]]), "en", "s", 0) for i, b in enumerate(base)]  # 290 to 302 shingles in common
    rows += [(200 + i, " ".join(b[:200] + [rng.choice(words) for _ in range(100)]), "en", "s", 0) for i, b in enumerate(base)]  # about half of them
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), sf).collect()}
    assert kept == {*range(20), *range(200, 220)}


def test_pii_stage_changes_texts_alone(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert {r.doc_id for r in stages[4]} == set(before)
    assert all(r.lang == before[r.doc_id].lang and r.n_chars == len(r.text) for r in stages[4])
    assert any(r.text != before[r.doc_id].text for r in stages[4])


def test_packing_stage_holds_every_id(stages):
    encode = library("word_bpe_49k.json")
    ids = {r.doc_id: np.array([*encode(r.text), 1], "<u4") for r in stages[4]}
    seen = dict.fromkeys(ids, 0)
    for p in stages[5]:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        seen[p.doc_id] += p.length
    assert seen == {i: len(x) for i, x in ids.items()}


def test_run(spark, sf, stages):
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert {i for i, *_ in got} == {r.doc_id for r in stages[4]}


def test_every_query_is_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14)) and P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[name for name, _ in corpus_pipeline.STAGES])
def test_texts_reach_python_in_batches_bounded_in_bytes(spark, sf, stage):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        texts = spark.range(64, numPartitions=1).selectExpr(f"repeat('x', {1 << 18}) AS text")
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) < 2 * BATCH_BYTES and sum(r.n for r in sizes) >= 64 << 18
    finally:
        spark.conf.unset(name)

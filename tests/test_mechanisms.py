"""Stems and covers, late interaction by an index, counters of runs, JSON payloads and table functions against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import table_functions
from quarry.functions.stemming import STOP_WORDS, stem
from quarry.operators import chunking, fulltext, retrieval, storage, token_index
from quarry.plans import engine, runs
from quarry.session import scratch

# Words and stems as the paper gives them for its steps.
PAPER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll",
}


def test_stems():
    assert {w: stem(w) for w in PAPER} == PAPER
    for w in ("", "a", "is", "naïve", "x1s", "日本", "running2"):
        assert stem(w) == w


def plain_covers(words, need, span):
    """All shortest runs, by trying every start and end."""
    places = [(i + 1, t) for i, t in enumerate(words) if t in need]
    found = []
    for a, _ in places:
        for b, _ in places:
            if b >= a and {t for p, t in places if a <= p <= b} == need:
                found.append((a, b))
    least = [(a, b) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]
    return sum(min(1.0, span / (b - a + 1)) for a, b in least) if need and found else None


@pytest.mark.parametrize("stemmed", [True, False])
def test_fulltext_equals_plain_search(spark, stemmed):
    rng = random.Random(6)
    words = ["run", "running", "runs", "model", "models", "the", "of", "data", "Straße", "x1", "hopeful", "hope"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (62, "Data, DATA; run!")]
    asked = [(i, " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(25)] + [(50, "the of"), (51, ""), (52, None), (53, "nowhere data")]
    split = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
    cut = stem if stemmed else (lambda w: w)
    want = {}
    for q, t in asked:
        need = {cut(w) for w in split(t) if w not in STOP_WORDS}
        scores = {k: plain_covers([None if w in STOP_WORDS else cut(w) for w in split(x)], need, 8) for k, x in rows}
        best = sorted(((s, k) for k, s in scores.items() if s is not None), key=lambda p: (-round(p[0], 9), p[1]))[:5]
        want |= {(q, k): (i + 1, round(s, 9)) for i, (s, k) in enumerate(best)}
    found = fulltext.search(
        spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(rows, "chunk_id int, text string"), 5, span=8, **({} if stemmed else {"stem": fulltext.plain_terms})
    )
    assert {(r.query_id, r.chunk_id): (r.rank, round(r.score, 9)) for r in found.collect()} == want


# ---- late interaction


def test_token_index(spark):
    rng = random.Random(2)
    heads = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    token = lambda h: [x + rng.gauss(0, 0.1) for x in heads[h]]
    rows = [(i, [token(rng.randrange(12)) for _ in range(rng.randint(1, 5))]) for i in range(300)] + [(300, []), (301, None)]
    table = spark.createDataFrame(rows, "chunk_id int, tokens array<array<double>>").repartition(3)
    queries = table.filter("chunk_id % 30 = 0 AND chunk_id < 300").select(F.col("chunk_id").alias("query_id"), F.col("tokens").alias("query_tokens"))
    index = token_index.build(table, scratch(spark, "tokens"), lists=12)
    exact = {(r.query_id, r.chunk_id): round(r.score, 9) for r in retrieval.maxsim_search(queries, table, 10).collect()}
    whole = {(r.query_id, r.chunk_id): round(r.score, 9) for r in token_index.search(index, queries, table, 10, probes=12).collect()}
    assert whole == exact  # all lists: every row is a candidate
    some = {(r.query_id, r.chunk_id): round(r.score, 9) for r in token_index.search(index, queries, table, 10, probes=2).collect()}
    assert len(some.items() & exact.items()) >= 0.9 * len(exact)


# ---- runs


def test_run_log_counts_once_and_goes_on_after_a_failure(spark):
    log, reads = runs.RunLog(spark), spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = log.watch("given", spark.range(100).mapInArrow(touch, "id long"), even=F.col("id") % 2 == 0)
    some = log.watch("some", rows.filter("id >= 90"))
    assert log.write("saved", some, lambda df: df.write.format("noop").mode("overwrite").save())
    assert reads.value == 100
    assert not log.write("bad", spark.range(3).select(F.raise_error(F.lit("no"))), lambda df: df.collect())
    assert log.write("last", spark.range(0), lambda df: df.write.format("noop").mode("overwrite").save())
    got = {r.stage: (r.counts, r.error is None) for r in log.table().collect()}
    assert got == {"given": ({"rows": 100, "even": 50}, True), "some": ({"rows": 10}, True), "saved": ({"rows": 10}, True), "bad": ({}, False), "last": ({"rows": 0}, True)}
    with pytest.raises(ValueError, match="already"):
        log.watch("given", rows)


def test_funnel_equals_the_engines(spark):
    names = ["large language model", "graph network", "nothing", "LLM for graphs", "RLHF", "contrastive learning"]
    rows = [(str(i), f"a title about {names[i % 6]}", f"an abstract on {names[i // 6 % 6]}", ["cs.CL"] if i % 4 else ["math.AG"], "2024-01-01") for i in range(72)]
    papers = spark.createDataFrame(rows, "paper_id string, title string, abstract string, categories array<string>, published_date string").withColumn("published_date", F.to_date("published_date"))
    keywords = spark.createDataFrame([("graphs", "graph network")], "category string, keyword string")
    labels = spark.createDataFrame([(str(i), i % 3 != 0) for i in range(72)], "paper_id string, suitable boolean")
    parts = engine.collect(papers, keywords, labels)
    log, out = runs.RunLog(spark), scratch(spark, "funnel")
    assert runs.funnel(papers, keywords, labels, lambda df: df.write.parquet(out), log)
    got = {r.stage: r.n for r in spark.read.parquet(out).groupBy("stage").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {"kept": parts["kept"].count(), "keyword_filtered": parts["keyword_filtered"].count(), "unsuitable": parts["unsuitable"].count()}
    assert {k: got.get(k, 0) for k in want} == want
    counts = {r.stage: r.counts for r in log.table().collect()}
    assert counts["recalled"]["rows"] == parts["recalled"].count() and counts["ruled"]["clear"] == parts["clear"].count() and counts["ruled"]["edge"] == parts["edge"].count()


# ---- payloads


def payload(spark, rows):
    return spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("metadata"))


def test_variant_payloads(spark):
    rows = payload(spark, [(1, '{"a":1,"in":{"x":1,"y":[1,2]}}'), (2, None), (3, '{"a":"s"}'), (4, "{}"), (5, '{"a":99.5}')])
    change = payload(spark, [(1, '{"a":{"b":2},"n":null}'), (2, '{"z":1}'), (3, None), (9, '{"q":1}')])
    shown = lambda df: {r.id: r.j for r in df.select("id", F.to_json("metadata").alias("j")).collect()}
    assert shown(storage.merge_variant(rows, change, "id")) == {1: '{"a":{"b":2},"in":{"x":1,"y":[1,2]},"n":null}', 2: '{"z":1}', 3: '{"a":"s"}', 4: "{}", 5: '{"a":99.5}'}
    inner = payload(spark, [(1, '{"x":7,"w":true}'), (4, '{"x":1}'), (5, None)])
    assert shown(storage.merge_nested(rows, inner, "id", "metadata", "in")) == {1: '{"a":1,"in":{"w":true,"x":7,"y":[1,2]}}', 2: None, 3: '{"a":"s"}', 4: '{"in":{"x":1}}', 5: '{"a":99.5}'}
    assert [r.id for r in storage.where_path(rows, "$.a", "double", lambda v: v >= 1).orderBy("id").collect()] == [1, 5]
    assert [r.id for r in storage.where_path(rows, "$.in.y[1]", "int", lambda v: v == 2).collect()] == [1]


# ---- table functions


def test_chunks_from_sql_equal_the_operators(spark):
    rng = random.Random(3)
    para = lambda i: (f"p{i}", " ".join(["word."] * rng.randint(1, 60)), i)
    docs = [(f"d{k}", f"T{k}", "An abstract of some words.", [("s1", "Intro", 1, 1, [para(i) for i in range(rng.randint(0, 12))])], None) for k in range(20)] + [("bad", "t", "a", [("s1", "x", 1, 1, None)], None)]
    schema = "paper_id string, title string, abstract string, sections array<struct<section_id:string,title:string,level:int,order:int,paragraphs:array<struct<paragraph_id:string,content:string,order:int>>>>, equations array<struct<text_description:string>>"
    table = spark.createDataFrame(docs, schema).repartition(3)
    config = chunking.ChunkConfig(max_tokens=40, overlap_tokens=5, min_tokens=3)
    table_functions.register(spark, config)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(spark.sql("SELECT * FROM chunk(TABLE({d}))", d=table)) == rows(chunking.chunk_documents(table, config))
    long = table.select("paper_id", F.explode("sections").alias("s")).select("paper_id", F.posexplode("s.paragraphs").alias("place", "p")).select("paper_id", "place", "p.content")
    packed = spark.sql("SELECT * FROM chunk_rows(TABLE({r}) PARTITION BY paper_id ORDER BY place)", r=long)
    want = chunking.chunk_documents(table, config).filter("chunk_type = 'text'").join(long.groupBy("paper_id").agg(F.sum(F.size(F.split("content", " "))).alias("n")), "paper_id").filter("n > 40")
    got = packed.join(want.select("paper_id").distinct(), "paper_id", "left_semi")
    assert sorted((r.paper_id, r.content) for r in got.collect()) == sorted((r.paper_id, r.content) for r in want.collect())
    texts = spark.createDataFrame([(1, "One. Two? Three"), (2, None), (3, " "), (None, "Four!")], "key int, text string")
    assert sorted(((r.key or "", r.place, r.sentence) for r in spark.sql("SELECT * FROM split_sentences(TABLE({t}))", t=texts).collect())) == [("", 1, "Four!"), ("1", 1, "One."), ("1", 2, "Two?"), ("1", 3, "Three")]


def test_tokens_of_a_vocabulary(spark, sf):
    """Counts equal the library's, ends stay within their budget and are ends of the text; chunks stay within theirs and lose no word."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.catalog import mechanisms
    from quarry.plans import plugins

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), plugins.BpeTokenizer(path)
    texts = ["", " ", "a", "hello  world", "日本語のテキスト 😀👍🏽 emoji", "x " * 3000, "don't\n\n\tstop", "é" * 50, "a" * 5000]
    for t in texts:
        n = len(plain.encode(t, add_special_tokens=False).ids)
        assert own.count(t) == n
        for k in (0, 1, 2, 7, n, n + 1):
            head, tail = own.head(t, k), own.tail(t, k)
            assert t.startswith(head) and t.endswith(tail) and own.count(head) <= k and own.count(tail) <= k
            assert k < n or head == tail == t
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, t string")
    got = {r.i: (r.n_tokens, r.head) for r in plugins.token_columns(rows, own, "t", 5).collect()}
    assert got == {i: (own.count(t), own.head(t, 5)) if t is not None else (0, None) for i, t in enumerate([*texts, None])}
    texts = {str(r.doc_id): r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {}
    for r in mechanisms.chunk_bpe(spark, sf).collect():
        assert r.error is None and r.token_count == own.count(r.content)
        held.setdefault(r.paper_id, []).append(r)
    for key, chunks in held.items():
        assert [r.chunk_index for r in sorted(chunks, key=lambda r: r.chunk_index)] == list(range(len(chunks)))
        # Budgets count the packed units, paragraphs or sentences, without what joins them; an overlap that stands before a large unit may go over.
        assert all(min(sum(map(own.count, re.split(p, r.content))) for p in (r"\n\n", r"(?<=[.!?])\s+")) <= 256 + 32 for r in chunks)
        words, said = set(texts[key].split()), " ".join(r.content for r in chunks).split()
        if own.count(texts[key]) > 300:
            assert len(words & set(said)) >= 0.5 * len(words)


def test_tokens_of_long_texts_are_counted_once(monkeypatch):
    """Counts, heads and tails are those of the whole text's tokens, also once no more stretches are held; what repeats isn't encoded again."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.plans import plugins

    def ends(text, n):
        found = plain.encode(text, add_special_tokens=False).offsets
        heads = (text[: min(found[m - 1][1], found[m][0])] for m in range(n, 0, -1))
        tails = (text[max(found[-m][0], found[-m - 1][1]) :] for m in range(n, 0, -1))
        fits = lambda t: len(plain.encode(t, add_special_tokens=False)) <= n
        return (text, text) if len(found) <= n else (next(filter(fits, heads), ""), next(filter(fits, tails), ""))

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), plugins.BpeTokenizer(path)
    draw = random.Random(7)
    signs = [*"ab'r vt  \n\n\t1,.;?é日😀\x1c\x85_!-", "'re", "'ll", " 's", "don't", ", ", "é.", "<|endoftext|>"]
    for keep in (0, 20, 300_000):
        monkeypatch.setattr(plugins.BpeTokenizer, "_KEEP", keep)
        for _ in range(300):
            text = "".join(draw.choices(signs, k=draw.randint(0, 80)))
            assert own.count(text) == len(plain.encode(text, add_special_tokens=False))
            for n in (0, 1, 3, 30):
                assert (own.head(text, n), own.tail(text, n)) == ends(text, n)
    given = []
    size, spans = plugins.BpeTokenizer._size, plugins.BpeTokenizer._spans
    monkeypatch.setattr(plugins.BpeTokenizer, "_size", lambda self, t: given.append(len(t)) or size(self, t))
    monkeypatch.setattr(plugins.BpeTokenizer, "_spans", lambda self, t: given.append(len(t)) or spans(self, t))
    text = "some plain words, again and again\n" * 500
    assert own.count(text) == len(plain.encode(text, add_special_tokens=False)) and (own.head(text, 9), own.tail(text, 9)) == ends(text, 9)
    assert sum(given) < len(text) // 10


def test_a_task_holds_few_documents_at_once():
    """Chunkers and parsers give their rows in small parts, however many documents an Arrow batch has."""
    import pandas as pd
    import pyarrow as pa

    from quarry.operators import parsing

    class Held:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

        mapInPandas = mapInArrow

    docs = [{"paper_id": f"p{i}", "title": "", "abstract": "one two three" if i % 7 else None, "sections": None, "equations": None} for i in range(1000)]
    schema = pa.schema([("paper_id", pa.string()), ("title", pa.string()), ("abstract", pa.string()), ("sections", pa.list_(pa.string())), ("equations", pa.list_(pa.string()))])
    parts = list(chunking.chunk_documents(Held(), chunking.ChunkConfig(min_tokens=1))(iter([pa.RecordBatch.from_pylist(docs, schema=schema)])))
    assert max(p.num_rows for p in parts) <= 32 and [r["paper_id"] for p in parts for r in p.to_pylist()] == [d["paper_id"] for d in docs if d["abstract"]]
    sources = pd.DataFrame({"paper_id": [f"p{i}" for i in range(600)], "source": ["\\begin{document}x\\end{document}"] * 600})
    frames = list(parsing.parse_documents(Held())(iter([sources])))
    assert max(map(len, frames)) <= 256 and [i for f in frames for i in f["paper_id"]] == sources["paper_id"].tolist()

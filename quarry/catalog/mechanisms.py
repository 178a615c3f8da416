"""Full text by covers and stems, late interaction by an index, table functions, counters of runs, JSON payloads, files and model plug-ins."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quarry.catalog import query
from quarry.catalog.hybrid import LetterEmbedder, built
from quarry.catalog.search import _TF, docs, postings, vector_queries, vectors
from quarry.functions import table_functions
from quarry.functions import vectors as V
from quarry.functions.stemming import STOP_WORDS
from quarry.operators import benchmark, chunking, fulltext, parsing, retrieval, storage, token_index
from quarry.operators.vector_index import recall
from quarry.plans import enrich, plugins
from quarry.plans.runs import RunLog
from quarry.session import cut_lineage, scratch, stored, table
from quarry.sources import tables as sources

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORD = r"[\p{L}\p{N}]+"
_COVERS = rf"""WITH dw AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents)),
qt AS (SELECT query_id, term FROM (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM benchmark) WHERE term NOT IN ({_STOP})),
n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
m AS (SELECT query_id, doc_id, any_value(n) AS n FROM (SELECT DISTINCT doc_id, term FROM dw) JOIN qt USING (term) JOIN n USING (query_id) GROUP BY ALL HAVING count(*) = any_value(n)),
h AS (SELECT m.query_id, m.doc_id, m.n, dw.pos, dw.term FROM m JOIN qt USING (query_id) JOIN dw ON dw.doc_id = m.doc_id AND dw.term = qt.term),
l AS (SELECT a.query_id, a.doc_id, a.n, a.pos, b.term, max(b.pos) AS last FROM h a JOIN h b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.pos <= a.pos GROUP BY ALL),
c AS (SELECT query_id, doc_id, pos, min(last) AS first FROM l GROUP BY query_id, doc_id, pos HAVING count(*) = any_value(n)),
k AS (SELECT query_id, doc_id, first, min(pos) AS pos FROM c GROUP BY ALL),
s AS (SELECT query_id, doc_id AS chunk_id, round(sum(least(1.0, 16.0 / (pos - first + 1))), 9) AS score FROM k GROUP BY ALL)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20"""


def _benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(_COVERS)
def fulltext_covers(spark, sf_dir):
    """Whole benchmark texts as queries: all their words, ranked by the runs of words that hold them."""
    found = fulltext.search(_benchmark(spark, sf_dir), docs(spark, sf_dir), 40, stem=fulltext.plain_terms)
    return retrieval.top_k(found.select("query_id", "chunk_id", F.round("score", 9).alias("score")), 20)


@query()
def fulltext_stems(spark, sf_dir):
    """The same by stems."""
    return fulltext.search(_benchmark(spark, sf_dir), docs(spark, sf_dir), 20).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


# ---- late interaction


def _tokens(v):
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v, i * 16 + 1, F.lit(16)))


def _late(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("tokens", _tokens(F.col("embedding")))
    return rows, vector_queries(spark, sf_dir).select("query_id", _tokens(F.col("vector")).alias("query_tokens"))


@query()
def maxsim_indexed(spark, sf_dir):
    """Candidates by the lists of their tokens, scored exactly."""
    rows, asked = _late(spark, sf_dir)
    index = stored(spark, sf_dir, "token-index", lambda path: token_index.build(rows, path))
    found = token_index.search(index, asked, rows, 10, probes=max(2, index.meta.lists // 4))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(DISTINCT vec_id) AS n_queries, least(10, (SELECT count(*) FROM embeddings)) * count(DISTINCT vec_id) AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def maxsim_index_recall(spark, sf_dir):
    """Whether nine tenths of the exact results are among the candidates."""
    rows, asked = _late(spark, sf_dir)
    return recall(maxsim_indexed(spark, sf_dir), retrieval.maxsim_search(asked, rows, 10)).select("n_queries", "wanted", (F.col("recall") >= 0.9).alias("reached"))


# ---- table functions

_RUNS = r"""WITH RECURSIVE q AS (SELECT doc_id, array_to_string(w[j * 60 + 1:j * 60 + 60], ' ') AS p, i, j FROM (SELECT doc_id, w, i, unnest(range(0, (len(w) + 59) // 60)) AS j FROM
  (SELECT doc_id, regexp_extract_all(s, '[^ \t]+') AS w, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)))),
u AS (SELECT doc_id, p, len(string_split(p, ' ')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i FROM q),
w(doc_id, i, held, chunk) AS (SELECT doc_id, i, n, 0 FROM u WHERE i = 1 UNION ALL SELECT u.doc_id, u.i, CASE WHEN held + n > 90 THEN n ELSE held + n END,
  CASE WHEN held + n > 90 THEN chunk + 1 ELSE chunk END FROM w JOIN u ON u.doc_id = w.doc_id AND u.i = w.i + 1),
g AS (SELECT doc_id, chunk, count(*) AS k, sum(n) AS t, string_agg(p, chr(10) || chr(10) ORDER BY i) AS c, chunk = max(chunk) OVER (PARTITION BY doc_id) AS last FROM w JOIN u USING (doc_id, i) GROUP BY doc_id, chunk)
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(chunk AS INTEGER) AS chunk_index, CAST(k AS INTEGER) AS n_paragraphs, CAST(t AS INTEGER) AS token_count, md5(c) AS content FROM g WHERE NOT last OR t >= 25"""
_CONFIG = chunking.ChunkConfig(max_tokens=90, overlap_tokens=0, min_tokens=25, with_abstract=False)


def _paragraphs(spark, sf_dir):
    """paper_id and runs: of each line of the whole text its words, 60 to a run."""
    line = F.transform(F.split("text", "\n"), lambda s: F.filter(F.split(s, r"[ \t]+"), lambda w: w != ""))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 60).cast("int")), lambda j: F.array_join(F.slice(w, j * 60 + 1, F.lit(60)), " "))
    runs = F.flatten(F.transform(F.filter(line, lambda w: F.size(w) > 0), cut))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "source", runs.alias("runs"))


def _parsed(spark, sf_dir):
    from quarry.catalog.markup import _section_docs

    own = _paragraphs(spark, sf_dir).withColumn("doc_id", F.col("paper_id"))
    return _section_docs(own, F.coalesce("runs", F.array().cast("array<string>")))


def _hashed(chunks, n):
    return chunks.select("paper_id", "chunk_index", n, "token_count", F.md5(F.col("content").cast("binary")).alias("content"))


@query(_RUNS)
def chunk_paragraphs(spark, sf_dir):
    """Whole texts: each line in runs of 60 words, packed into chunks of at most 90."""
    return _hashed(chunking.chunk_documents(_parsed(spark, sf_dir), _CONFIG), F.size("paragraph_ids").alias("n_paragraphs"))


@query(_RUNS)
def sql_chunk(spark, sf_dir):
    """The same from SQL."""
    table_functions.register(spark, _CONFIG)
    chunks = spark.sql("SELECT * FROM chunk(TABLE({d}))", d=_parsed(spark, sf_dir))
    return _hashed(chunks, F.size("paragraph_ids").alias("n_paragraphs"))


@query(_RUNS)
def sql_chunk_rows(spark, sf_dir):
    """The same from a table of paragraphs, dealt by document and in order."""
    table_functions.register(spark, _CONFIG)
    rows = _paragraphs(spark, sf_dir).select("paper_id", F.posexplode("runs").alias("place", "content"))
    return _hashed(spark.sql("SELECT * FROM chunk_rows(TABLE({r}) PARTITION BY paper_id ORDER BY place)", r=rows), "n_paragraphs")


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), lambda x: x <> '') AS s FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS key, CAST(generate_subscripts(s, 1) AS INTEGER) AS place, md5(unnest(s)) AS sentence FROM s""")
def sql_sentences(spark, sf_dir):
    table_functions.register(spark)
    found = spark.sql("SELECT * FROM split_sentences(TABLE({t}))", t=table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))
    return found.select("key", "place", F.md5("sentence").alias("sentence"))


# ---- runs


@query("""WITH a AS (SELECT * FROM documents WHERE text IS NOT NULL), b AS (SELECT * FROM a WHERE lang = 'en'), c AS (SELECT b.* FROM b JOIN labels USING (doc_id) WHERE quality = 1)
SELECT 'given' AS stage, count(*) AS n, count(*) FILTER (lang IS NULL) AS part, false AS failed FROM documents UNION ALL SELECT 'texts', count(*), count(*) FILTER (length(text) > 1000), false FROM a
UNION ALL SELECT 'english', count(*), 0, false FROM b UNION ALL SELECT 'good', count(*), 0, false FROM c UNION ALL SELECT 'broken', 0, 0, true UNION ALL SELECT 'after', count(*), 0, false FROM c""")
def run_counters(spark, sf_dir):
    """A funnel whose stages are counted in the one job that writes its end, a stage that fails, and one after it."""
    log, out = RunLog(spark), scratch(spark, "run")
    given = log.watch("given", table(spark, sf_dir, "documents"), part=F.col("lang").isNull())
    texts = log.watch("texts", given.filter("text IS NOT NULL"), part=F.length("text") > 1000)
    english = log.watch("english", texts.filter("lang = 'en'"))
    good = english.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id")
    log.write("good", good, lambda df: df.write.parquet(out))
    log.write("broken", spark.read.parquet(out).withColumn("x", F.raise_error(F.lit("no such service"))), lambda df: df.write.format("noop").mode("overwrite").save())
    log.write("after", spark.read.parquet(out), lambda df: df.write.format("noop").mode("overwrite").save())
    n = lambda name: F.coalesce(F.try_element_at("counts", F.lit(name)), F.lit(0))
    return log.table().select("stage", n("rows").alias("n"), n("part").alias("part"), F.col("error").isNotNull().alias("failed"))


# ---- JSON payloads


def _payloads(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_variant_object(F.map_concat(F.parse_json("props").cast("map<string,variant>"), F.create_map(F.lit("by"), F.to_variant_object(F.struct("user_id", "event_type"))))).alias("metadata"))


_J = """p AS (SELECT event_id, user_id, event_type, json_merge_patch(props, json_object('by', json_object('user_id', user_id, 'event_type', event_type))) AS m FROM events),
f AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN json_object('k', 'over', 'more', json_object('id', event_id)) END AS c, m FROM p),
t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_merge_patch(m, c) ELSE m END AS m FROM f)"""


@query(f"WITH {_J} SELECT event_id, json_extract_string(m, '$.k') AS k, CAST(json_extract_string(m, '$.more.id') AS BIGINT) AS more, CAST(json_extract_string(m, '$.by.user_id') AS BIGINT) AS user_id FROM t")
def variant_merge(spark, sf_dir):
    """Payloads with nested objects; a third of them get a field replaced by another type and one added."""
    rows = _payloads(spark, sf_dir)
    change = rows.filter("event_id % 3 = 0").select("event_id", F.to_variant_object(F.struct(F.lit("over").alias("k"), F.struct(F.col("event_id").alias("id")).alias("more"))).alias("metadata"))
    got = storage.merge_variant(rows, change, "event_id")
    at = lambda path, kind: F.try_variant_get("metadata", F.lit(path), kind)
    return got.select("event_id", at("$.k", "string").alias("k"), at("$.more.id", "long").alias("more"), at("$.by.user_id", "long").alias("user_id"))


@query("""WITH p AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k, CASE WHEN event_id % 5 = 0 THEN 'seen' ELSE event_type END AS event_type, CAST(user_id AS BIGINT) AS user_id, event_id % 5 = 0 AS added FROM p WHERE k > 50""")
def variant_nested_merge_and_filter(spark, sf_dir):
    """Fields of an inner object are merged, and rows are chosen by a value at a path."""
    rows = _payloads(spark, sf_dir)
    change = rows.filter("event_id % 5 = 0").select("event_id", F.to_variant_object(F.struct(F.lit("seen").alias("event_type"), F.lit(True).alias("added"))).alias("metadata"))
    got = storage.where_path(storage.merge_nested(rows, change, "event_id", "metadata", "by"), "$.k", "long", lambda k: k > 50)
    at = lambda path, kind: F.try_variant_get("metadata", F.lit(path), kind)
    return got.select("event_id", at("$.k", "long").alias("k"), at("$.by.event_type", "string").alias("event_type"), at("$.by.user_id", "long").alias("user_id"), F.coalesce(at("$.by.added", "boolean"), F.lit(False)).alias("added"))


# ---- excerpts, enrichment, pairs, conversions, files


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS ls FROM documents),
e AS (SELECT doc_id, list_reduce(ls, lambda a, x: CASE WHEN ends_with(a, chr(1)) THEN a WHEN length(trim(a || ' ' || x, ' ')) <= 500 THEN trim(a || ' ' || x, ' ')
  WHEN 500 - length(a) > 50 THEN trim(a || ' ' || regexp_replace(x[1:500 - length(a)], '\s+\S*$', '') || '...', ' ') || chr(1) ELSE a || chr(1) END, '') AS t FROM l)
SELECT doc_id, md5(coalesce(replace(t, chr(1), ''), '')) AS excerpt FROM e""")
def section_excerpts(spark, sf_dir):
    """Excerpts of a section whose paragraphs are the lines of the whole text."""
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.cast("string").alias("paragraph_id"), p.alias("content"), i.alias("order")))
    none = F.array().cast("array<struct<paragraph_id:string,content:string,order:int>>")
    sections = F.array(F.struct(F.lit("Other").alias("title"), none.alias("paragraphs")), F.struct(F.lit("The Introduction").alias("title"), lines.alias("paragraphs")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(benchmark.section_excerpt(sections, "introduction").cast("binary")).alias("excerpt"))


class CountingGenerator:
    """Replies with counts of the prompt's signs, so that SQL can reply too; prompts that end in a full stop fail."""

    def generate(self, prompt: str) -> str:
        if prompt.endswith("."):
            raise TimeoutError
        body = json.dumps({"keywords": [f"c{len(prompt)}", f"e{prompt.count('e')}"], "summary": f"{prompt.count('a')} of {len(prompt)}", "contribution_type": "method" if len(prompt) % 2 else "odd"})
        return f"```json\n{body}\n```" if len(prompt) % 3 else body


_ENRICHED = """WITH p AS (SELECT doc_id, text, CASE WHEN length(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) >= 50 THEN 'Give keywords, a summary and a contribution type as JSON.' || chr(10) || text[1:3000] END AS p FROM documents),
r AS (SELECT doc_id, CASE WHEN NOT ends_with(p, '.') THEN p END AS p FROM p)
SELECT doc_id, 'c' || length(p) || ',e' || (length(p) - length(replace(p, 'e', ''))) AS keywords, (length(p) - length(replace(p, 'a', ''))) || ' of ' || length(p) AS summary, CASE WHEN length(p) % 2 = 1 THEN 'method' END AS contribution_type FROM r"""


@query(_ENRICHED)
def enriched_documents(spark, sf_dir):
    """Short texts are rejected, long ones cut for the model, failed calls leave their rows."""
    done = enrich.enrich_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), CountingGenerator(), "text")
    e = F.col("enrichment")
    return done.select("doc_id", F.array_join(e["keywords"], ",").alias("keywords"), e["summary"].alias("summary"), e["contribution_type"].alias("contribution_type"))


@query(r"""WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS q FROM benchmark),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w, (SELECT count(*) FROM benchmark) AS n FROM documents)
SELECT doc_id, item_id, round(len(list_filter(q, lambda x: list_contains(w, x))) / len(q), 9) AS score FROM d JOIN q ON item_id = doc_id % n""")
def pair_scores(spark, sf_dir):
    """Pairs of a text and a query, scored by a plug-in."""
    b = table(spark, sf_dir, "benchmark")
    n = b.count()
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), (F.col("doc_id") % max(n, 1)).alias("item_id")).join(b.select("item_id", F.col("text").alias("query")), "item_id")
    return plugins.score_column(pairs, plugins.LexicalScorer(), "query", "content").select("doc_id", "item_id", F.round("rerank_score", 9).alias("score"))


@query(_TF + "SELECT doc_id AS chunk_id, token, weight, count(*) OVER (PARTITION BY doc_id) AS nnz FROM p")
def sparse_round_trip(spark, sf_dir):
    """Sparse vectors as maps, as JSON, as arrays and back."""
    held = postings(spark, sf_dir).groupBy("chunk_id").agg(F.collect_list("token").alias("i"), F.collect_list("weight").alias("v"))  # 128 of a row at most
    maps = held.select("chunk_id", V.sparse_to_json(V.sparse_from_arrays(F.col("i"), F.col("v"))).alias("j")).select("chunk_id", V.sparse_from_json(F.col("j")).alias("m"))
    return maps.select("chunk_id", V.sparse_nnz(F.col("m")).cast("long").alias("nnz"), F.explode("m").alias("token", "weight"))


class VowelEmbedder:
    """Counts of the vowels: a second vector of the same rows."""

    name, dims = "vowels", 5

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[(t or "").lower().count(c) for c in "aeiou"] for t in texts], np.float64).reshape(len(texts), 5)


_VOWELS = """WITH v AS (SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: CAST(length(lower(text)) - length(replace(lower(text), c, '')) AS DOUBLE)) AS e FROM documents),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS m FROM v),
s AS (SELECT q.doc_id AS query_id, x.doc_id AS chunk_id, CASE WHEN q.m * x.m > 0 THEN list_dot_product(q.e, x.e) / (q.m * x.m) ELSE 0 END AS score FROM n q, n x WHERE q.doc_id % 100 = 0)
SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""


@query(_VOWELS)
def engine_second_vector(spark, sf_dir):
    """A table of vectors of two models; a search names the one that it asks."""
    e = built(spark, sf_dir)
    more = plugins.embed_column(e.chunks.select("chunk_id", "content"), VowelEmbedder(), "content").select("chunk_id", F.lit("vowels").alias("vector_name"), "embedding")
    both = replace(e, vectors=e.vectors.unionByName(more), embedder=VowelEmbedder())
    asked = both.chunks.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("query"))
    found = both.search(asked, "dense", 60, vector_name="vowels")
    return retrieval.top_k(found.select("query_id", "chunk_id", F.round("score", 9).alias("score")), 10)


@query("""SELECT doc_id, CASE WHEN doc_id // 50 % 4 <> 3 THEN list_sum(list_transform(['a', 'e', 'i', 'o', 'u', 'b', 'c', 'd', 'f', 'g', 'h', 'j', 'k', 'l', 'm', 'n', 'p', 'q', 'r', 's', 't', 'v', 'w', 'x', 'y', 'z'],
lambda c: CAST(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), c, '')) AS DOUBLE))) END AS letters FROM documents""")
def embedded_letters(spark, sf_dir):
    """Vectors of all documents; a model that fails for some leaves those rows without."""
    d = table(spark, sf_dir, "documents")

    class Fails(LetterEmbedder):
        def embed(self, texts):
            if any((t or "").startswith("\x01") for t in texts):
                raise OSError("lost")
            return super().embed(texts)

    marked = d.withColumn("text", F.when(F.floor(F.col("doc_id") / 50) % 4 == 3, F.concat(F.lit("\x01"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    done = plugins.embed_column(marked, Fails(), "text", batch=1)
    return done.select("doc_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("letters"))


@query("SELECT CAST(doc_id AS VARCHAR) AS paper_id, source AS title, CAST(length(text) AS INTEGER) AS n, md5(coalesce(text, '')) AS text FROM documents")
def parsed_round_trip(spark, sf_dir):
    """Parsed documents written as JSON and read again."""
    from quarry.operators.parsing import DOCUMENT_SCHEMA

    d = table(spark, sf_dir, "documents")
    paragraph = F.array(F.struct(F.lit("p1").alias("paragraph_id"), F.col("text").alias("content"), F.lit(1).alias("order")))
    section = F.array(F.struct(F.lit("s1").alias("section_id"), F.col("lang").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("order"), paragraph.alias("paragraphs")))
    rows = d.select(F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("title"), section.alias("sections"))
    full = spark.createDataFrame([], DOCUMENT_SCHEMA).unionByName(rows, allowMissingColumns=True)
    out = scratch(spark, "parsed")
    full.write.json(out, ignoreNullFields=False)
    read = spark.read.schema(DOCUMENT_SCHEMA).json(out)
    text = F.col("sections")[0]["paragraphs"][0]["content"]
    return read.select("paper_id", "title", F.length(text).alias("n"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text"))


@query("SELECT doc_id, lang, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS abstract FROM documents")
def review_files(spark, sf_dir):
    """Review dumps: abstracts of 500 characters at most and a mark, written and read again."""
    out = scratch(spark, "review")
    sources.write_review(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("abstract")), out)
    return spark.read.schema("doc_id long, lang string, abstract string").json(out)


# ---- tokens of a vocabulary


def _bpe() -> plugins.BpeTokenizer:
    import public_tokenizers

    return plugins.BpeTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def bpe_tokens(spark, sf_dir):
    """Tokens of whole texts by a public vocabulary, and their first and last 50."""
    done = plugins.token_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), _bpe(), "text", 50)
    return done.select("doc_id", "n_tokens", "head", "tail")


@query()
def chunk_bpe(spark, sf_dir):
    """Whole texts in chunks whose budgets count tokens of a public vocabulary."""
    config = chunking.ChunkConfig(max_tokens=256, overlap_tokens=32, min_tokens=25, with_abstract=False, tokenizer=_bpe())
    return chunking.chunk_documents(_parsed(spark, sf_dir), config).select("chunk_id", "paper_id", "chunk_index", "token_count", "content", "error")


# ---- archives and equations

_WORDS = r"trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"
_LEAD = "so many plain words stand in this part of a paper "


def _letters(spark, sf_dir):
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "doc_id", words.alias("words"))


@F.pandas_udf(BinaryType())
def _archive(ids: pd.Series, words: pd.Series) -> pd.Series:
    """Sources as authors send them: a tar or zip whose files name one another in a circle, one packed file, or a PDF."""

    def one(i, w):
        head, end = f"\\documentclass{{article}}\\title{{Paper {i}}}\\begin{{document}}", "\\end{document}"
        first, second = f"\\section{{One}} {_LEAD}\n\n", f"\\section{{Two}} {_LEAD}{w}\n\n"
        files = {"main.tex": head + "\\input{parts/a}\\include{lost}" + end, "parts/a.tex": first + "\\input{b}", "parts/b.tex": second + "\\input{a.tex}\\input{b}"}
        out = io.BytesIO()
        if i % 4 == 0:
            with tarfile.open(fileobj=out, mode="w:gz") as t:
                for name, text in files.items():
                    info = tarfile.TarInfo(name)
                    info.size = len(text)
                    t.addfile(info, io.BytesIO(text.encode()))
        elif i % 4 == 1:
            with zipfile.ZipFile(out, "w") as z:
                for name, text in files.items():
                    z.writestr(name, text)
        elif i % 4 == 2:
            out.write(gzip.compress((head + first + second + end).encode()))
        else:
            out.write(b"%PDF-1.7")
        return out.getvalue()

    return pd.Series([one(i, w) for i, w in zip(ids, words, strict=True)])


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 4 < 3 THEN 'Paper ' || doc_id END AS title, CASE WHEN doc_id % 4 = 3 THEN 'ValueError: a PDF, not an archive' END AS error,
CASE WHEN doc_id % 4 < 3 THEN 'One,Two' END AS sections, CASE WHEN doc_id % 4 < 3 THEN md5(trim('{_LEAD}') || '|' || trim('{_LEAD}' || {_WORDS})) END AS paragraphs FROM documents""")
def archives_parsed(spark, sf_dir):
    """Archives of whole texts: the parts that a main file names are put in, each once, circles and lost files vanish, what can't be read is reported."""
    rows = _letters(spark, sf_dir).select("paper_id", _archive("doc_id", "words").alias("source"))
    parsed = parsing.parse_documents(rows, parsing.parse_archive)
    names = F.array_join(F.transform("sections", lambda s: s["title"]), ",")
    content = F.array_join(F.flatten(F.transform("sections", lambda s: F.transform(s["paragraphs"], lambda p: p["content"]))), "|")
    return parsed.select("paper_id", "title", "error", names.alias("sections"), F.md5(content.cast("binary")).alias("paragraphs"))


_EQUATIONS = _VOWELS.replace("FROM documents", f"FROM (SELECT doc_id, {_WORDS} AS text FROM documents) WHERE text <> ''")


@query(_EQUATIONS)
def equation_topk(spark, sf_dir):
    """Equations taken from sources, with vectors of their own, searched by a hundredth of them."""
    source = F.concat(F.lit("\\begin{document}Before \\begin{equation}"), "words", F.lit("\\end{equation} after.\\end{document}"))
    parsed = parsing.parse_documents(_letters(spark, sf_dir).filter("words <> ''").select("paper_id", source.alias("source")))
    held = plugins.embed_column(parsing.equation_rows(parsed), VowelEmbedder(), "latex").select(F.col("paper_id").cast("long").alias("chunk_id"), "embedding")
    held = cut_lineage(held)
    asked = held.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_search(asked, held, 10, digits=9).select("query_id", "chunk_id", "score", "rank")

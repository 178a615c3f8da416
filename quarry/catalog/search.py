"""Vector, sparse and text search, fusion, neighbours. Queries of a search are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.functions.classify import classify, presets
from quarry.functions.text import words
from quarry.operators import rag, retrieval
from quarry.operators.benchmark import hard_negatives as negatives_of
from quarry.operators.benchmark import similar_papers
from quarry.operators.sparse_index import SparseIndex
from quarry.operators.trigram import trigram_join
from quarry.operators.vector_index import VectorIndex, recall
from quarry.session import cut_lineage, stored, table


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("paper_id"), "embedding")


def vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("paper_id"))


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), "text", "lang")


def postings(spark, sf_dir):
    return retrieval.term_frequencies(docs(spark, sf_dir))


def term_vectors(spark, sf_dir):
    return retrieval.term_vectors(docs(spark, sf_dir))


def term_queries(spark, sf_dir):
    own = docs(spark, sf_dir).filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return retrieval.term_frequencies(own, key="query_id")


_COS = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS m FROM v),
s AS (SELECT q.vec_id AS query_id, q.label AS own, d.vec_id AS chunk_id, d.label AS paper_id,
  CASE WHEN q.m * d.m > 0 THEN list_dot_product(q.e, d.e) / (q.m * d.m) ELSE 0 END AS score
  FROM n q, n d WHERE q.vec_id % 100 = 0)"""
_TF = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents),
c AS (SELECT doc_id, token, CAST(count(*) AS DOUBLE) AS weight FROM w GROUP BY ALL),
p AS (SELECT doc_id, token, weight FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) <= 128),
sp AS (SELECT q.doc_id AS query_id, p.doc_id AS chunk_id, sum(q.weight * p.weight) AS score FROM p JOIN p q USING (token)
  WHERE q.doc_id % 100 = 0 GROUP BY ALL)"""


@query(_COS + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def dense_topk(spark, sf_dir):
    found = retrieval.dense_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 20)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_COS + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE score > 0.2 QUALIFY rank <= 10")
def dense_topk_threshold(spark, sf_dir):
    found = retrieval.dense_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 10, threshold=0.2)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_COS + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE paper_id = 3 QUALIFY rank <= 20")
def dense_topk_filtered(spark, sf_dir):
    found = retrieval.dense_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir).filter("paper_id = 3"), 20)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_COS + "SELECT chunk_id, round(score, 6) AS score FROM s WHERE query_id = 0 ORDER BY score DESC, chunk_id LIMIT 20")
def dense_topk_single(spark, sf_dir):
    """One query, whose vector comes from the table by a join of one row."""
    rows = vectors(spark, sf_dir)
    one = rows.filter("chunk_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    return retrieval.dense_search_expr(F.col("_q"), rows.join(F.broadcast(one), F.lit(True)), 20).select("chunk_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
t AS (SELECT vec_id, i, e[i * 16 + 1 : i * 16 + 16] AS x FROM v, range(4) r(i)),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS m FROM t),
b AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, q.i, max(CASE WHEN q.m * d.m > 0 THEN list_dot_product(q.x, d.x) / (q.m * d.m) ELSE 0 END) AS best
  FROM n q, n d WHERE q.vec_id % 100 = 0 GROUP BY ALL),
s AS (SELECT query_id, chunk_id, sum(greatest(best, 0)) AS score FROM b GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def maxsim_topk(spark, sf_dir):
    def tokens(v):
        return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v, i * 16 + 1, F.lit(16)))

    rows = vectors(spark, sf_dir).withColumn("tokens", tokens(F.col("embedding")))
    asked = vector_queries(spark, sf_dir).select("query_id", tokens(F.col("vector")).alias("query_tokens"))
    return retrieval.maxsim_search(asked, rows, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_TF + "SELECT doc_id AS chunk_id, token, weight FROM p")
def sparse_top128(spark, sf_dir):
    return postings(spark, sf_dir)


@query(_TF + "SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sp QUALIFY rank <= 20")
def sparse_dot_topk(spark, sf_dir):
    return retrieval.sparse_search(term_queries(spark, sf_dir), term_vectors(spark, sf_dir), 20).select("query_id", "chunk_id", "score", "rank")


def sparse_index(spark, sf_dir) -> SparseIndex:
    """The stored index of all documents' terms."""
    return stored(spark, sf_dir, "sparse-index", lambda path: SparseIndex.build(term_vectors(spark, sf_dir), path))


@query(_TF + "SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sp QUALIFY rank <= 20")
def sparse_stored_topk(spark, sf_dir):
    """Whole documents as queries against the stored index."""
    return sparse_index(spark, sf_dir).search(term_queries(spark, sf_dir), 20).select("query_id", "chunk_id", "score", "rank")


@query(_TF + r""", f AS (SELECT token, count(*) AS df FROM p GROUP BY token), bw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM benchmark),
bq AS (SELECT query_id, token, 1.0 / (i + 1) AS weight FROM (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY df, token) AS i FROM bw JOIN f USING (token)) WHERE i <= 3),
bs AS (SELECT query_id, doc_id AS chunk_id, sum(bq.weight * p.weight) AS score FROM bq JOIN p USING (token) GROUP BY ALL)
SELECT query_id, chunk_id, round(CAST(score AS DOUBLE), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, chunk_id) AS INTEGER) AS rank FROM bs QUALIFY rank <= 20""")
def sparse_stored_short(spark, sf_dir):
    """Short queries, the three rarest words of each whole benchmark text: blocks that can't matter stay unread."""
    index = sparse_index(spark, sf_dir)
    words_ = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda t: t != ""))).alias("token"))
    rare = words_.join(index.tokens().select("token", "n_rows"), "token").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("n_rows", "token"))).filter("i <= 3")
    found = index.search(rare.select("query_id", "token", (1.0 / (F.col("i") + 1)).alias("weight")), 40, skip=True)
    return retrieval.top_k(found.select("query_id", "chunk_id", F.round("score", 9).alias("score")), 20)


@query(_TF + "SELECT token, count(*) AS n_rows, max(weight) AS top FROM p GROUP BY token")
def sparse_index_tokens(spark, sf_dir):
    return sparse_index(spark, sf_dir).tokens().select("token", "n_rows", "top")


@query(_TF + "SELECT doc_id AS chunk_id, token, weight FROM p")
def sparse_index_postings(spark, sf_dir):
    """What was indexed, read back."""
    return sparse_index(spark, sf_dir).postings()


def vector_index(spark, sf_dir) -> VectorIndex:
    return stored(spark, sf_dir, "vector-index", lambda path: VectorIndex.build(vectors(spark, sf_dir), path))


@query(_COS + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def vector_index_exact(spark, sf_dir):
    """All lists of the stored collection are read: the same as the exact search."""
    return vector_index(spark, sf_dir).search(vector_queries(spark, sf_dir), 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def vector_index_probed(spark, sf_dir):
    """As many of the nearest lists as the collection's own calibration asks for."""
    index = vector_index(spark, sf_dir)
    found = index.search(vector_queries(spark, sf_dir), 20, probes=index.calibrated(20, 0.95))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(DISTINCT vec_id) AS n_queries, least(20, (SELECT count(*) FROM embeddings)) * count(DISTINCT vec_id) AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, sf_dir):
    """Whether nine tenths of the exact results are found in the lists that are probed."""
    exact = retrieval.dense_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 20)
    return recall(vector_index_probed(spark, sf_dir), exact).select("n_queries", "wanted", (F.col("recall") >= 0.9).alias("reached"))


@query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys FROM embeddings")
def vector_index_rows(spark, sf_dir):
    """Every row is in one list."""
    return vector_index(spark, sf_dir).rows().agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("key").alias("n_keys"))


@query(_TF + """, z AS (SELECT q.doc_id AS query_id, d.doc_id AS chunk_id, coalesce(sp.score, 0.0) AS score FROM (SELECT DISTINCT doc_id FROM p WHERE doc_id % 100 = 0) q
  CROSS JOIN documents d LEFT JOIN sp ON sp.query_id = q.doc_id AND sp.chunk_id = d.doc_id)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM z QUALIFY rank <= 20""")
def sparse_dot_keep_zero(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return retrieval.sparse_search(term_queries(spark, sf_dir), term_vectors(spark, sf_dir), 20, keep_zero=rows).select("query_id", "chunk_id", "score", "rank")


_FEATURES = r"""q AS (SELECT item_id AS query_id, text AS query, lower(trim(text)) AS t FROM benchmark),
f AS (SELECT query_id, query, t, regexp_extract_all(t, '\S+') AS w FROM q),
g AS (SELECT query_id, query, len(w) AS wc, len(list_filter(w[1:3], lambda x: x IN ('how','what','why','when','where','which','who','can','does','is','are'))) > 0 OR t LIKE '%?' AS asked,
  len(list_filter({terms}, lambda x: contains(t, x))) AS tc, len(list_filter({patterns}, lambda x: regexp_matches(t, x))) AS cc FROM f),
k AS (SELECT *, tc / greatest(wc, 1) AS r FROM g),
cl AS (SELECT query_id, query, wc, tc, cc, CASE
  WHEN wc <= 8 AND NOT asked AND tc >= 1 THEN 'keyword'
  WHEN cc >= 1 OR (r < 0.1 AND wc >= 10) OR (tc <= 1 AND wc >= 10 AND NOT asked) OR (tc = 0 AND wc >= 6) THEN 'conceptual' ELSE 'natural' END AS query_type,
  CASE WHEN wc <= 8 AND NOT asked AND tc >= 1 THEN least(0.9, 0.5 + r * 0.5 + CASE WHEN wc <= 5 THEN 0.1 ELSE 0 END)
  WHEN cc >= 1 THEN CASE WHEN tc <= 2 THEN least(0.9, 0.6 + cc * 0.15) ELSE 0.55 END
  WHEN r < 0.1 AND wc >= 10 THEN 0.7 WHEN tc <= 1 AND wc >= 10 AND NOT asked THEN 0.6 WHEN tc = 0 AND wc >= 6 THEN 0.6
  WHEN asked THEN CASE WHEN tc >= 2 THEN 0.8 ELSE 0.7 END ELSE 0.5 END AS confidence FROM k)"""


def _features_sql() -> str:
    from quarry.functions import lexicon as L

    terms = "[" + ", ".join(f"'{t}'" for t in L.TECHNICAL) + "]"
    patterns = "[" + ", ".join(f"'{p}'" for p in L.CONCEPTUAL) + "]"
    return _FEATURES.replace("{terms}", terms).replace("{patterns}", patterns)


@query("WITH " + _features_sql() + " SELECT query_id, CAST(wc AS INTEGER) AS word_count, CAST(tc AS INTEGER) AS technical_term_count, CAST(cc AS INTEGER) AS conceptual_pattern_count, query_type, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM cl")
def query_classify(spark, sf_dir):
    done = classify(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    return done.select("query_id", "word_count", "technical_term_count", "conceptual_pattern_count", "query_type", F.round("confidence", 6).alias("confidence"))


@query("WITH " + _features_sql() + """, p AS (SELECT * FROM (VALUES ('default', 0.4::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE), ('conceptual', 0.6, 0.2, 0.2), ('keyword', 0.3, 0.5, 0.2), ('balanced', 0.5, 0.25, 0.25),
('dense_only', 1.0, 0.0, 0.0)) t(preset, dense_weight, sparse_weight, colbert_weight))
SELECT p.*, count(query_id) AS n_queries FROM p LEFT JOIN cl ON preset = CASE query_type WHEN 'natural' THEN 'balanced' ELSE query_type END GROUP BY ALL""")
def rrf_presets(spark, sf_dir):
    """Each preset, and how many of the benchmark's queries are of the type that it is for."""
    done = classify(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    own = done.select("query_id", F.when(F.col("query_type") == "natural", "balanced").otherwise(F.col("query_type")).alias("preset"))
    return presets(spark).join(own, "preset", "left").groupBy("preset", "dense_weight", "sparse_weight", "colbert_weight").agg(F.count("query_id").alias("n_queries"))


_FULLTEXT = r"""WITH dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS token FROM dt) GROUP BY token),
qw AS (SELECT query_id, list(token ORDER BY df DESC, token)[1:3] AS q FROM (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM benchmark) JOIN df USING (token) GROUP BY query_id),
need AS (SELECT query_id, unnest(q) AS token, len(q) AS need FROM qw),
tf AS (SELECT doc_id, token, any_value(l) AS l, count(*) AS n FROM (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM dt) GROUP BY doc_id, token),
h AS (SELECT query_id, doc_id AS chunk_id, count(*) AS found, any_value(need) AS need, sum(n) / any_value(l) AS score FROM tf JOIN need USING (token) GROUP BY query_id, doc_id),
ft AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h WHERE found = need QUALIFY rank <= 20)"""


def _fulltext(spark, sf_dir):
    """Queries: of each whole benchmark text the three words that most documents have."""
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words_ = b.select("query_id", F.explode(F.array_distinct(split("text"))).alias("token"))
    known = docs(spark, sf_dir).select(F.explode(F.array_distinct(split("text"))).alias("token")).join(words_.select("token").distinct(), "token", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("df"), "token"))
    chosen = words_.join(known.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token").withColumn("i", place).filter("i <= 3")
    asked = cut_lineage(chosen.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), " ").alias("query")).join(b, "query_id"))
    return asked, retrieval.fulltext_search(asked, docs(spark, sf_dir), 20)


@query(_FULLTEXT + " SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ft")
def fulltext_and(spark, sf_dir):
    return _fulltext(spark, sf_dir)[1].select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_FULLTEXT + r""", r AS (SELECT ft.*, list_distinct(regexp_extract_all(lower(b.text), '\S+')) AS q, regexp_extract_all(lower(d.text), '\S+') AS w, count(*) OVER (PARTITION BY query_id) AS n
  FROM ft JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id),
s AS (SELECT query_id, chunk_id, rank, CASE WHEN n > 5 THEN len(list_filter(q, lambda x: list_contains(w, x))) / len(q) END AS rr FROM r)
SELECT query_id, chunk_id, round(rr, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rr DESC NULLS LAST, rank) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rr DESC NULLS LAST, rank) <= 5""")
def rerank_lexical(spark, sf_dir):
    asked, found = _fulltext(spark, sf_dir)
    full = found.join(asked.select("query_id", F.col("text").alias("query")), "query_id").join(docs(spark, sf_dir).select("chunk_id", F.col("text").alias("content")), "chunk_id")
    done = rag.rerank(full, 5, score=retrieval.lexical_score(F.col("query"), F.col("content")))
    return done.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def _ranked(spark, sf_dir, k):
    rows = vectors(spark, sf_dir)
    return retrieval.dense_search(vector_queries(spark, sf_dir), rows, k).join(rows.select("chunk_id", "paper_id"), "chunk_id")


_R = ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"


@query(_COS + _R + """, b AS (SELECT query_id, paper_id, chunk_id, rank FROM r WHERE rank <= 50 QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) = 1)
SELECT query_id, paper_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM b""")
def paper_dedup_topk(spark, sf_dir):
    return retrieval.best_per_group(_ranked(spark, sf_dir, 50)).select("query_id", "paper_id", "chunk_id", "rank")


@query(_COS + _R + """, b AS (SELECT query_id, paper_id, min(rank) AS f FROM r WHERE rank <= 25 AND paper_id <> own GROUP BY query_id, paper_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f, paper_id) <= 5)
SELECT query_id, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY f) AS papers FROM b GROUP BY query_id""")
def hard_negatives(spark, sf_dir):
    found = negatives_of(_ranked(spark, sf_dir, 25), vector_queries(spark, sf_dir), 5)
    return found.select("query_id", F.array_join(F.col("groups").cast("array<string>"), ",").alias("papers"))


@query(_COS + _R + """, b AS (SELECT query_id, paper_id, min(rank) AS f FROM r WHERE rank <= 30 AND paper_id <> own AND score >= 0.1 GROUP BY query_id, paper_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f, paper_id) <= 3)
SELECT query_id, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY f) AS papers FROM b GROUP BY query_id""")
def similar_docs_threshold(spark, sf_dir):
    found = similar_papers(_ranked(spark, sf_dir, 30), vector_queries(spark, sf_dir), 3, 0.1)
    return found.select("query_id", F.array_join(F.col("groups").cast("array<string>"), ",").alias("papers"))


_WORDS = r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {table})"""
_GRAMS = """{a} AS (SELECT word, list_distinct(list_transform(range(1, length(word) - 1), lambda i: word[i:i + 2])) AS g FROM {b} WHERE length(word) >= 3), {a}1 AS (SELECT word, len(g) AS n, unnest(g) AS gram FROM {a})"""


def _vocabulary(spark, sf_dir, name):
    return table(spark, sf_dir, name).select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("word")).distinct()


@query(_WORDS.format(table="documents") + ", v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), " + _GRAMS.format(a="x", b="v") + ", " + _GRAMS.format(a="y", b="w") + """,
c AS (SELECT x1.word AS left_key, y1.word AS right_key, count(*) AS c, any_value(x1.n) AS n, any_value(y1.n) AS m FROM x1 JOIN y1 USING (gram) GROUP BY ALL)
SELECT left_key, right_key, round(c / (n + m - c), 6) AS similarity FROM c WHERE c / (n + m - c) >= 0.6""")
def trigram_words(spark, sf_dir):
    """Words of the benchmark and the words of all documents that are like them."""
    found = trigram_join(_vocabulary(spark, sf_dir, "benchmark"), _vocabulary(spark, sf_dir, "documents"), 0.6, key="word", text="word")
    return found.select("left_key", "right_key", F.round("similarity", 6).alias("similarity"))


@query(_WORDS.format(table="benchmark") + ", " + _GRAMS.format(a="x", b="w") + """,
c AS (SELECT a.word AS left_key, b.word AS right_key, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM x1 a JOIN x1 b ON a.gram = b.gram AND a.word < b.word GROUP BY ALL)
SELECT left_key, right_key, round(c / (n + m - c), 6) AS similarity FROM c WHERE c / (n + m - c) >= 0.5""")
def trigram_pairs(spark, sf_dir):
    """Pairs within one vocabulary."""
    return trigram_join(_vocabulary(spark, sf_dir, "benchmark"), None, 0.5, key="word", text="word").select("left_key", "right_key", F.round("similarity", 6).alias("similarity"))


@query("SELECT label AS vector_name, count(*) AS points FROM embeddings GROUP BY label")
def index_stats(spark, sf_dir):
    return retrieval.index_stats(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "vector_name"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), a AS (SELECT e FROM v WHERE vec_id = 0)
SELECT vec_id AS paper_id, round(list_dot_product(v.e, a.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(a.e, a.e)), 4) AS similarity FROM v, a
WHERE list_dot_product(v.e, a.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(a.e, a.e)) >= 0.1""")
def semantic_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding")
    anchor = rows.filter("paper_id = 0").select(F.col("embedding").alias("_a")).limit(1)
    kept = retrieval.semantic_filter(rows.join(F.broadcast(anchor), F.lit(True)), F.col("_a"), threshold=0.1)
    return kept.select("paper_id", F.round("similarity", 4).alias("similarity"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS n_words FROM documents""")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words(F.col("text"))).alias("n_words"))

"""Reads and writes of stored tables, curation and answer assembly, each over a whole table."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.catalog.corpus import _P, papers
from quarry.functions import lexicon as L
from quarry.functions import text
from quarry.functions.scoring import number_rows
from quarry.operators import benchmark, chunking, curation, evaluation, rag, storage
from quarry.plans import enrich, plugins
from quarry.plans.engine import reprocess
from quarry.session import scratch, table
from quarry.sources import tables as sources
from quarry.streaming import limits
from quarry.streaming.progress import progress


def orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("arxiv_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("citation_count"), F.col("o_orderdate").cast("date").alias("published_date"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("parsed").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("abstract"),
        F.when(F.col("o_orderkey") % 4 == 1, "a.pdf").alias("pdf_path"), F.when(F.col("o_orderkey") % 5 == 1, "a.tex").when(F.col("o_orderkey") % 5 == 2, "").alias("latex_path"),
    )


_O = """o AS (SELECT o_orderkey AS arxiv_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS citation_count, CAST(o_orderdate AS DATE) AS published_date,
  CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'parsed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS abstract,
  CASE WHEN o_orderkey % 4 = 1 THEN 'a.pdf' END AS pdf_path, CASE o_orderkey % 5 WHEN 1 THEN 'a.tex' WHEN 2 THEN '' END AS latex_path FROM orders)"""


def _placed(rows, *columns):
    """Rows in the order they come in, with that place from 0."""
    return number_rows(rows, "_i").select(*columns, (F.col("_i") - 1).cast("long").alias("pos"))


@query("SELECT p_partkey, p_name, (SELECT count(*) > 0 FROM part WHERE p_partkey = 17) AS there, (SELECT count(*) > 0 FROM part WHERE p_partkey = -5) AS not_there FROM part WHERE p_partkey = 17")
def point_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    there, gone = storage.exists(p, "p_partkey", 17), storage.exists(p, "p_partkey", -5)
    return storage.find(p, "p_partkey", 17).select("p_partkey", "p_name", F.lit(there).alias("there"), F.lit(gone).alias("not_there"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 7 <> 0 THEN -doc_id END NULLS LAST, doc_id) - 1 AS pos FROM documents WHERE source = 'src1'""")
def chunks_of_paper(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 7 != 0, -F.col("doc_id")).alias("chunk_index"))
    return _placed(storage.chunks_of(d, "src1"), F.col("chunk_id").alias("doc_id"))


@query(f"WITH {_O} SELECT arxiv_id, published_date, row_number() OVER (ORDER BY published_date, arxiv_id) - 1 AS pos FROM o WHERE status = 'parsed' AND abstract IS NOT NULL")
def papers_by_status(spark, sf_dir):
    found = storage.query_papers(orders(spark, sf_dir), ["arxiv_id", "published_date"], status="parsed", require_abstract=True, order_by="published_date", desc=False)
    return _placed(found, "arxiv_id", "published_date")


@query(f"WITH {_O} SELECT arxiv_id, row_number() OVER (ORDER BY citation_count DESC NULLS LAST, arxiv_id) - 1 AS pos FROM o WHERE status = 'pending' AND (pdf_path IS NOT NULL OR latex_path IS NOT NULL)")
def parse_ready(spark, sf_dir):
    return _placed(storage.parse_ready(orders(spark, sf_dir)), "arxiv_id")


@query(f"WITH {_O} SELECT arxiv_id, CASE WHEN coalesce(latex_path, '') = '' THEN 'failed' ELSE status END AS status FROM o")
def mark_unparsable(spark, sf_dir):
    return storage.mark_unparsable(orders(spark, sf_dir)).select("arxiv_id", "status")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0)")
def rows_without_vector(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    return storage.lacking(table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left"), "embedding").select("doc_id")


@query("""SELECT vec_id, label + CASE WHEN vec_id % 4 = 0 THEN 100 ELSE 0 END AS label, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END, 6) AS first FROM embeddings
UNION ALL SELECT vec_id + 1000000, NULL, round(CAST(embedding[1] AS DOUBLE), 6) FROM embeddings WHERE vec_id % 10 = 3""")
def vector_upsert(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    new = v.filter("vec_id % 4 = 0").select("vec_id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"), (F.col("label") + 100).cast("int").alias("label"))
    added = v.filter("vec_id % 10 = 3").select((F.col("vec_id") + 1000000).alias("vec_id"), "embedding", F.lit(None).cast("int").alias("label"))
    done = storage.upsert(v.withColumn("label", F.col("label").cast("int")), new.unionByName(added), "vec_id")
    return done.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'changed' ELSE lang END AS lang, source, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0""")
def payload_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    c = table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id", F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("lang"), F.lit("changed")).alias("metadata"))
    m = storage.merge_payload(d, c, "doc_id")
    return m.select("doc_id", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("lang", "source", "quality")])


@query("SELECT doc_id FROM documents d WHERE doc_id % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def unenriched_chunks(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit("x").alias("l"))
    flag = F.when((F.col("doc_id") % 3 == 0) & F.col("l").isNotNull(), F.create_map(F.lit("enriched"), F.lit("true"))).when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("enriched"), F.lit("false"))).otherwise(F.create_map(F.lit("other"), F.lit("true")))
    return storage.unenriched(d.join(l, "doc_id", "left").withColumn("metadata", flag)).select("doc_id")


@query("""WITH s AS (SELECT 'w' || (item_id % 3) AS category, 'word ' || item_id AS keyword FROM benchmark) SELECT category, keyword, '' AS action FROM s WHERE keyword <> 'word 2'
UNION ALL SELECT 'extra', 'brand new', '' UNION ALL SELECT 'extra', 'brand new', 'add' UNION ALL SELECT category, keyword, 'remove' FROM s WHERE keyword = 'word 2'""")
def keyword_store_changes(spark, sf_dir):
    store = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("w"), (F.col("item_id") % 3).cast("string")).alias("category"), F.concat(F.lit("word "), F.col("item_id").cast("string")).alias("keyword"))
    store, added = sources.add_keywords(store, ["Brand New", "word 1", " brand new ", ""], "extra")
    store, removed = sources.remove_keywords(store, ["WORD 2", "nowhere"])
    return store.withColumn("action", F.lit("")).unionByName(added.unionByName(removed))


@query("SELECT doc_id, source, 'new' AS version FROM documents WHERE source = 'src2' AND doc_id % 2 = 0 UNION ALL SELECT doc_id, source, 'old' FROM documents WHERE source <> 'src2'")
def reprocessed_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("paper_id"), F.lit("old").alias("version"))
    new = d.filter("paper_id = 'src2' AND CAST(chunk_id AS BIGINT) % 2 = 0").withColumn("version", F.lit("new"))
    return reprocess(d, new).select(F.col("chunk_id").cast("long").alias("doc_id"), F.col("paper_id").alias("source"), "version")


@query("""SELECT version, count(*) AS n, CAST(sum(a) AS BIGINT) AS balance FROM (SELECT 1 AS version, c_custkey, CAST(round(c_acctbal) AS BIGINT) AS a FROM customer
UNION ALL SELECT 2, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE CAST(round(c_acctbal) AS BIGINT) END FROM customer UNION ALL SELECT 3, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE CAST(round(c_acctbal) AS BIGINT) END FROM customer WHERE c_custkey % 3 <> 0) GROUP BY version""")
def snapshot_versions(spark, sf_dir):
    keep = storage.Snapshots(spark, scratch(spark, "snapshots"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal").cast("long").alias("a"))
    keep.write("customer", c)
    keep.upsert("customer", c.filter("c_custkey % 5 = 0").withColumn("a", F.lit(1).cast("long")), "c_custkey")
    keep.delete("customer", c.filter("c_custkey % 3 = 0"), "c_custkey")
    each = [keep.read("customer", v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"), F.sum("a").alias("balance")) for v in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {_P} SELECT p.paper_id, coalesce(l.quality * 50, c) AS citation_count, (SELECT count(*) FROM p q JOIN labels m ON m.doc_id = q.paper_id WHERE m.quality * 50 IS DISTINCT FROM q.c) AS updated FROM p LEFT JOIN labels l ON l.doc_id = p.paper_id")
def merged_citations(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") * 50).cast("int").alias("citation_count"))
    merged, n = curation.merge_citations(papers(spark, sf_dir), counts)
    return merged.select("paper_id", "citation_count").join(F.broadcast(n), F.lit(True))


@query("SELECT paper_id, citation_count FROM (SELECT doc_id || 'v' || (doc_id % 3 + 1) AS paper_id, coalesce(CAST(l.quality * 9 AS INTEGER), 0) AS citation_count FROM documents d LEFT JOIN labels l USING (doc_id))")
def versioned_citations(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("v"), (F.col("doc_id") % 3 + 1).cast("string")).alias("paper_id"))
    c = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("v9")).alias("paper_id"), (F.col("quality") * 9).cast("int").alias("citation_count"))
    return curation.with_citations(p, c)


@query("SELECT v.vec_id, coalesce(split_part(d.text, chr(10), 1), CAST(v.vec_id AS VARCHAR)) AS title, round(CAST(embedding[2] AS DOUBLE), 3) AS similarity FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id")
def titled_results(spark, sf_dir):
    results = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("embedding")[1].cast("double").alias("score"), F.lit("text").alias("content"))
    named = rag.with_titles(results, papers(spark, sf_dir))
    return rag.sources(named).select(F.col("paper_id").alias("vec_id"), "title", "similarity")


@query("SELECT doc_id, left(text, 500) AS excerpt, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS preview FROM documents")
def source_excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit(0.5).alias("score"))
    return rag.sources(d).select("doc_id", "excerpt", "preview")


@query("SELECT source AS paper_id, (SELECT count(*) FROM documents) AS chunks, row_number() OVER (ORDER BY source) - 1 AS pos FROM (SELECT DISTINCT source FROM documents)")
def paper_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"))
    n = d.agg(F.count(F.lit(1)).alias("chunks"))
    return _placed(storage.paper_ids(d), "paper_id").join(F.broadcast(n), F.lit(True))


@query("""SELECT doc_id, 'sys' || chr(10) || chr(10) || 'Context:' || chr(10) || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Previous conversation:' || chr(10) || lang || chr(10) ELSE '' END || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM documents""")
def answer_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", rag.prompt(F.col("text"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "sys").alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || lang || chr(10) || chr(10) ELSE '' END || 'Abstract: ' || source || chr(10) || chr(10) || 'Conclusion: end' AS context FROM documents")
def paper_contexts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", benchmark.paper_context(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source"), F.lit(""), F.lit("end")).alias("context"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT a.vec_id, CASE WHEN a.vec_id % 9 = 0 THEN NULL ELSE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) END AS s FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s > 0.7 THEN 'easy' WHEN s > 0.4 THEN 'medium' ELSE 'hard' END AS difficulty FROM p""")
def difficulty_by_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    own = F.when(F.col("vec_id") % 9 != 0, F.col("embedding"))
    return v.join(other, "vec_id").select("vec_id", benchmark.vector_difficulty(own, F.col("other"), F.lit("unknown")).alias("difficulty"))


def _literal(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


@query(
    "WITH q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_literal(q)}, {_literal(','.join(p))}, {_literal(c)})" for i, (q, p, c) in enumerate(L.EVALUATION)) + r""") t(query_id, query, relevant_papers, category)),
w AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')) AS word FROM q),
d AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS word FROM documents),
h AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM w JOIN d USING (word) GROUP BY query_id)
SELECT q.*, coalesce(n, 0) AS n_documents FROM q LEFT JOIN h USING (query_id)"""
)
def built_in_queries(spark, sf_dir):
    """The built-in queries, and how many documents have a word of each."""
    q = evaluation.built_in_queries(spark)
    words = q.select("query_id", F.explode(F.array_distinct(text.words(F.lower("query")))).alias("word"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.words(F.lower("text")))).alias("word"))
    hits = own.join(F.broadcast(words), "word").groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"))  # the built-in list is fixed
    return q.join(hits, "query_id", "left").select("query_id", "query", F.array_join("relevant_papers", ",").alias("relevant_papers"), "category", F.coalesce("n", F.lit(0)).alias("n_documents"))


@query("SELECT c_custkey, round(n * 100.0 / t, 6) AS percent, round(CASE WHEN s > 0 THEN n / s ELSE 0 END, 6) AS rate, round(CASE WHEN s > 0 AND n > 0 THEN (t - n) / (n / s) ELSE 0 END, 6) AS eta FROM (SELECT c_custkey, c_custkey % 50 AS n, 50 AS t, c_custkey % 7 AS s FROM customer)")
def batch_progress(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select("c_custkey", progress(k % 50, F.lit(50), (k % 7).cast("double")).alias("p"))
    return rows.select("c_custkey", *[F.round(f"p.{n}", 6).alias(n) for n in ("percent", "rate", "eta")])


@query("""SELECT CASE event_id % 6 WHEN 0 THEN '/health' WHEN 1 THEN '/search' WHEN 2 THEN '/' WHEN 3 THEN '/chat' WHEN 4 THEN '/docs' ELSE '/papers' END AS path, count(*) AS n FROM events WHERE event_id % 6 IN (1, 3, 5) GROUP BY 1""")
def limited_requests(spark, sf_dir):
    paths = F.array(*map(F.lit, ("/health", "/search", "/", "/chat", "/docs", "/papers")))
    e = table(spark, sf_dir, "events").select(paths[(F.col("event_id") % 6).cast("int")].alias("path"))
    return limits.limited_paths(e).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(d AS DATE) AS window_start FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 14 DAY) t(d) WHERE strftime(d, '%Y-%m') NOT IN (SELECT strftime(ts, '%Y-%m') FROM events WHERE user_id = 3)""")
def pending_date_windows(spark, sf_dir):
    windows = curation.date_windows(spark, datetime.date(2024, 1, 1), datetime.date(2024, 3, 31))
    months = table(spark, sf_dir, "events").filter("user_id = 3").select(F.date_format("ts", "yyyy-MM").alias("m")).distinct()
    done = windows.join(months, F.date_format("window_start", "yyyy-MM") == F.col("m"), "left_semi")
    return curation.pending_windows(windows, done).select("window_start")


@query("""WITH p AS (SELECT doc_id AS paper_id, doc_id % 4 AS k, lower(split_part(text, chr(10), 1) || ' ' || text) AS t, source FROM documents)
SELECT paper_id FROM p WHERE k <> 3 AND (contains(t, 'token') OR contains(t, 'the that')) AND (paper_id % 17 = 0 OR (DATE '2024-01-01' - CAST(paper_id % 900 AS INTEGER)) BETWEEN DATE '2022-06-01' AND DATE '2023-12-01')""")
def broad_recall(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("categories", F.when(F.col("paper_id") % 4 != 3, F.array(F.lit("cs.CL"), F.lit("x"))).otherwise(F.array(F.lit("math"))))
    found = curation.recall(p, ("token", "the that"), F.lit("2022-06-01").cast("date"), F.lit("2023-12-01").cast("date"))
    return found.select("paper_id")


@query("""SELECT DISTINCT lower(trim(k)) AS keyword FROM (SELECT unnest([source || ' ' || lang, ' ' || upper(source), 'ab']) AS k FROM documents WHERE doc_id % 2 = 0) WHERE length(trim(k)) > 2 AND lower(trim(k)) <> 'src3 en'""")
def learned_keyword_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0")
    labels = d.select(F.array(F.concat_ws(" ", "source", "lang"), F.concat(F.lit(" "), F.upper("source")), F.lit("ab")).alias("keywords"))
    return curation.learned_keywords(labels, known=spark.createDataFrame([("SRC3 EN",)], "keyword string"))


@query("SELECT doc_id AS paper_id, coalesce(l.quality = 1, true) AS is_relevant FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY doc_id LIMIT 500")
def verified_edges(spark, sf_dir):
    """The first 500 edge cases: a limit of the operator."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") == 1).alias("is_relevant"))
    return curation.verify_edges(papers(spark, sf_dir), labels).select("paper_id", "is_relevant")


@query("SELECT count(DISTINCT source) AS total_papers, count(*) AS total_chunks, CAST(sum(n_chars) AS BIGINT) AS total_tokens, min(n_chars) AS min_tokens, max(n_chars) AS max_tokens, round(avg(n_chars), 6) AS avg_tokens, count(*) FILTER (doc_id % 3 = 0) AS text_chunks, count(*) FILTER (doc_id % 3 = 1) AS abstract_chunks, count(*) FILTER (doc_id % 3 = 2) AS equation_chunks FROM documents")
def chunk_statistics(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("text", "abstract", "equation")))
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("token_count"), kinds[(F.col("doc_id") % 3).cast("int")].alias("chunk_type"))
    return chunking.chunk_stats(d).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query("SELECT count(*) AS total, count(*) FILTER (vec_id % 5 <> 0) AS embedded, count(*) FILTER (vec_id % 5 = 0) AS failed, round(count(*) FILTER (vec_id % 5 <> 0) / 2.5, 6) AS per_second FROM embeddings")
def embedding_statistics(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("embedding"))
    return enrich.embedding_stats(v, 2.5).withColumn("per_second", F.round("per_second", 6))


@query("""SELECT item_id AS query_id, lower(b.text) AS query, CASE item_id % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'natural_short' WHEN 2 THEN 'natural_long' ELSE 'conceptual' END AS style, d.source AS category, CAST(d.doc_id AS VARCHAR) AS relevant, CASE WHEN item_id % 2 = 0 THEN 'n1,n2' ELSE '' END AS negatives,
CAST(len(list_filter(string_split_regex(b.text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS word_count FROM benchmark b JOIN documents d ON d.doc_id = item_id""".replace("\\\\s", "\\s"))
def benchmark_rows(spark, sf_dir):
    styles = F.array(*map(F.lit, benchmark.STYLES))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"), styles[(F.col("item_id") % 4).cast("int")].alias("style"), F.col("item_id").cast("string").alias("paper_id"))
    negatives = b.filter("query_id % 2 = 0").select("query_id", F.array(F.lit("n1"), F.lit("n2")).alias("groups"))
    p = papers(spark, sf_dir).select(F.col("paper_id").cast("string").alias("paper_id"), "title", "abstract", F.col("source").alias("category"))
    made = benchmark.assemble(b, negatives, p)
    return made.select("query_id", "query", "style", "category", F.array_join("relevant_papers", ",").alias("relevant"), F.array_join("hard_negatives", ",").alias("negatives"), "word_count")


class _Titled:
    """Answers as a model would, with a label and quotes around; the query is lower-cased."""

    def expand(self, query: str) -> str:
        return f'Abstract: "{query.lower()} in short"'


@query("""SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'known ' || (item_id % 2) WHEN item_id % 3 = 1 THEN lower(text) || ' in short' ELSE text END AS expanded FROM benchmark""")
def cached_expansion(spark, sf_dir):
    kind = F.when(F.col("item_id") % 3 == 2, "keyword").otherwise("conceptual")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), kind.alias("query_type"))
    known = q.filter("query_id % 3 = 0").select(F.concat(F.lit("conceptual:"), "query").alias("cache_key"), F.concat(F.lit("known "), (F.col("query_id") % 2).cast("string")).alias("expanded")).dropDuplicates(["cache_key"])
    done, _ = plugins.expand_cached(q, plugins.CleaningExpander(_Titled()), known)
    return done.select("query_id", "expanded")


@query("""SELECT doc_id, 'https://arxiv.org/abs/' || doc_id || 'v2' AS abs_url, 'https://arxiv.org/pdf/' || doc_id || 'v2.pdf' AS pdf_url, 'https://arxiv.org/e-print/' || doc_id || 'v2' AS latex_url, CAST(doc_id AS VARCHAR) AS bare, 'cs_CL_' || doc_id || 'v2' AS file_name, strftime(DATE '2024-01-01' - CAST(doc_id % 900 AS INTEGER), '%Y-%m') AS month FROM documents""")
def identifiers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "arXiv:").when(F.col("doc_id") % 3 == 0, "ARXIV:").otherwise(""), F.col("doc_id").cast("string"), F.lit("v2"))
    i = text.normalise_id(raw)
    date = F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 900).cast("int"))
    return d.select("doc_id", text.links(i).alias("l"), text.strip_version(i).alias("bare"), text.safe_name(F.concat(F.lit("cs/CL:"), i)).alias("file_name"), text.month_key(date).alias("month")).select("doc_id", "l.*", "bare", "file_name", "month")

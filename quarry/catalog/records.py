"""Storage, evaluation, report and stream queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import benchmark, evaluation, report, storage
from quarry.operators.terms import with_matches
from quarry.session import table
from quarry.streaming import limits

# ---- storage


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, 'new ' || c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey + 1000000, c_name, NULL FROM customer WHERE c_custkey % 100 = 1""")
def upsert(spark, sf_dir):
    old = customers(spark, sf_dir)
    changed = old.filter("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    added = old.filter("c_custkey % 100 = 1").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", F.lit(None).cast("double").alias("c_acctbal"))
    return storage.upsert(old, changed.unionByName(added), "c_custkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 'x', 0.0 FROM customer WHERE c_custkey % 100 = 1")
def insert_new(spark, sf_dir):
    old = customers(spark, sf_dir)
    new = old.filter("c_custkey % 100 = 1").select(F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1000000)).alias("c_custkey"), F.lit("x").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return storage.insert_new(old, new, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'embedded' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_partial(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return storage.update(o, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000), {"o_orderstatus": F.lit("embedded")}).drop("o_totalprice")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_from_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(-1).alias("quality"))
    return storage.update_from(d, table(spark, sf_dir, "labels"), "doc_id", ["quality"])


@query("SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS n_orders FROM customer WHERE c_mktsegment <> 'BUILDING'")
def delete_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    gone = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    parents, children = storage.delete_cascade(c.withColumnRenamed("c_custkey", "key"), {"orders": table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")}, gone, "key")
    n = children["orders"].groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return parents.join(n, "key", "left").select(F.col("key").alias("c_custkey"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_with_total(spark, sf_dir):
    rows, total = storage.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 20)
    return rows.withColumn("total", F.lit(total).cast("long"))


@query("""SELECT s.status, coalesce(n, 0) AS count FROM (VALUES ('pending'), ('collected'), ('parsed'), ('embedded'), ('failed')) s(status) LEFT JOIN
(SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'unknown' END AS status, count(*) AS n FROM orders GROUP BY 1) o USING (status) UNION ALL SELECT 'total', count(*) FROM orders""")
def status_histogram(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("unknown").alias("status"))
    return storage.status_histogram(o)


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left_join_chunks(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_no_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"))
    return storage.without_chunks(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id")), status=None).withColumnRenamed("paper_id", "c_custkey")


@query("SELECT CAST(pos AS BIGINT) AS pos, p_partkey, p_name FROM (VALUES (0, 7), (1, 3), (2, 999999999), (3, 7), (4, 1)) w(pos, k) JOIN part ON p_partkey = k")
def ordered_multiget(spark, sf_dir):
    return storage.multiget(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [7, 3, 999999999, 7, 1], "p_partkey")


@query("SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark")
def union_ids(spark, sf_dir):
    return storage.union_ids(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), key="doc_id")


@query("SELECT count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing, round(count(l.doc_id) * 100.0 / count(*), 6) AS percent FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(spark, sf_dir):
    return storage.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").withColumn("percent", F.round("percent", 6))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5")
def query_papers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arxiv_id"), F.col("o_totalprice").alias("citation_count"), F.col("o_orderstatus").alias("status"))
    return storage.query_papers(o, status="F", offset=5, limit=25).select(F.col("arxiv_id").alias("o_orderkey"), F.col("citation_count").alias("o_totalprice"))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7 ")
def scroll_filtered(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return storage.scroll(both, {"o_custkey": 7, "l_linestatus": None}, key="o_orderkey").select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("v", F.struct("o_orderdate", "o_orderkey"))
    return storage.latest_per_key(o, "o_custkey", "v").select("o_custkey", "o_orderkey", "o_orderdate")


# ---- evaluation: qrels are the documents that hold a benchmark passage; the lists are full-text results


def qrels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    hits = with_matches(d, b.select("q"), F.col("text")).select("doc_id", F.explode("matched").alias("q")).join(b, "q").groupBy("item_id").agg(F.array_sort(F.collect_list("doc_id")).alias("relevant_papers"))
    return b.join(hits, "item_id", "left").select(F.col("item_id").alias("query_id"), F.coalesce("relevant_papers", F.array().cast("array<bigint>")).alias("relevant_papers"), F.array().cast("array<bigint>").alias("relevant_chunks"))


def results(spark, sf_dir):
    from quarry.catalog.search import fulltext_and

    return fulltext_and(spark, sf_dir).withColumn("paper_id", F.col("chunk_id"))


def _metrics_sql() -> str:
    from quarry.catalog.search import _FULLTEXT

    return _FULLTEXT + """, rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
j AS (SELECT b.item_id AS query_id, ft.rank, CASE WHEN rel.doc_id IS NOT NULL THEN 1 ELSE 0 END AS rel FROM benchmark b LEFT JOIN ft ON ft.query_id = b.item_id LEFT JOIN rel ON rel.query_id = b.item_id AND rel.doc_id = ft.chunk_id),
known AS (SELECT b.item_id AS query_id, count(rel.doc_id) AS k FROM benchmark b LEFT JOIN rel ON rel.query_id = b.item_id GROUP BY 1),
a AS (SELECT query_id, coalesce(1 / min(rank) FILTER (rel = 1), 0) AS mrr, count(rank) AS n, sum(rel) AS r,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rel = 1 AND rank <= 5), 0) AS d5, coalesce(sum(1 / log2(rank + 1)) FILTER (rel = 1 AND rank <= 10), 0) AS d10,
  coalesce(sum(rel) FILTER (rank <= 5), 0) AS h5, coalesce(sum(rel) FILTER (rank <= 10), 0) AS h10 FROM j GROUP BY 1),
idl AS (SELECT i, sum(1 / log2(i + 1)) OVER (ORDER BY i) AS s FROM range(1, 11) t(i)),
cm AS (SELECT a.query_id, mrr, CASE WHEN r > 0 THEN d5 / (SELECT s FROM idl WHERE i = least(r, 5)) ELSE 0 END AS ndcg5, CASE WHEN r > 0 THEN d10 / (SELECT s FROM idl WHERE i = least(r, 10)) ELSE 0 END AS ndcg10,
  h5 / CASE WHEN n >= 5 THEN 5 ELSE greatest(n, 1) END AS p5, h10 / CASE WHEN n >= 10 THEN 10 ELSE greatest(n, 1) END AS p10, CASE WHEN k > 0 THEN h10 / k ELSE 0 END AS recall10,
  CASE WHEN k > 0 THEN d10 / (SELECT s FROM idl WHERE i = least(k, 10)) ELSE 0 END AS pndcg, h5 / 5 AS pp5, n AS num_results FROM a JOIN known USING (query_id))"""


@query(_metrics_sql() + " SELECT query_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("mrr", "ndcg5", "ndcg10", "p5", "p10", "recall10")) + ", mrr > 0 AS hit10, num_results FROM cm")
def ir_metrics_chunk(spark, sf_dir):
    m = evaluation.chunk_metrics(results(spark, sf_dir), qrels(spark, sf_dir))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg5", "ndcg10", "p5", "p10", "recall10")], "hit10", "num_results")


@query(_metrics_sql() + """, m10 AS (SELECT query_id, coalesce(1 / min(rank) FILTER (rel = 1 AND rank <= 10), 0) AS m FROM j GROUP BY 1)
SELECT query_id, round(CAST(m AS DOUBLE), 6) AS mrr, round(CAST(pndcg AS DOUBLE), 6) AS ndcg, round(CAST(pp5 AS DOUBLE), 6) AS p5, m > 0 AS hit FROM cm JOIN m10 USING (query_id)""")
def ir_metrics_paper(spark, sf_dir):
    m = evaluation.paper_metrics(results(spark, sf_dir), qrels(spark, sf_dir))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "p5")], "hit")


_STYLE = "CASE query_id % 5 WHEN 0 THEN 'keyword' WHEN 1 THEN 'natural_short' WHEN 2 THEN 'natural_long' WHEN 3 THEN 'conceptual' ELSE 'unknown' END"
_DIFF = "CASE query_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END"


def _styled(spark, sf_dir):
    m = evaluation.chunk_metrics(results(spark, sf_dir), qrels(spark, sf_dir)).withColumn("mode", F.lit("fulltext"))
    styles = F.array(*map(F.lit, (*benchmark.STYLES, "")))
    return m.withColumn("style", styles[(F.col("query_id") % 5).cast("int")]).withColumn("difficulty", F.array(*map(F.lit, ("easy", "medium", "hard")))[(F.col("query_id") % 3).cast("int")])


@query(_metrics_sql() + f""", g AS (SELECT *, 'fulltext' AS mode, {_STYLE} AS style, {_DIFF} AS difficulty FROM cm)
SELECT CASE WHEN style IS NULL AND difficulty IS NULL THEN 'overall' WHEN difficulty IS NULL THEN 'style' ELSE 'difficulty' END AS level, mode, style, difficulty, round(CAST(avg(mrr) AS DOUBLE), 6) AS avg_mrr,
round(CAST(avg(ndcg10) AS DOUBLE), 6) AS avg_ndcg10, round(CAST(avg(p5) AS DOUBLE), 6) AS avg_p5, round(avg(CASE WHEN mrr > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, count(*) AS count
FROM g GROUP BY GROUPING SETS ((mode), (mode, style), (mode, difficulty))""")
def ir_metrics_grouping_sets(spark, sf_dir):
    a = evaluation.aggregate(_styled(spark, sf_dir))
    return a.select("level", "mode", "style", "difficulty", *[F.round(c, 6).alias(c) for c in ("avg_mrr", "avg_ndcg10", "avg_p5", "hit_rate")], "count")


@query(_metrics_sql() + f""", g AS (SELECT mrr, {_STYLE} AS style, {_DIFF} AS difficulty FROM cm)
SELECT style, difficulty, round(CAST(avg(mrr) AS DOUBLE), 6) AS avg_mrr, count(*) AS count FROM g GROUP BY CUBE (style, difficulty)""")
def style_difficulty_cube(spark, sf_dir):
    rows = _styled(spark, sf_dir).withColumn("style", F.coalesce(F.nullif("style", F.lit("")), F.lit("unknown")))
    return report.style_difficulty_cube(rows).withColumn("avg_mrr", F.round("avg_mrr", 6))


def _grid_sql() -> str:
    from quarry.catalog.search import _COS, _TF

    return f"""{_COS}, {_TF.removeprefix('WITH ')},
de AS (SELECT query_id, chunk_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20),
sk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sp QUALIFY rank <= 20),
g AS (SELECT DISTINCT round(a / t, 4) AS wd, round(b / t, 4) AS ws FROM (SELECT a, b, a + b + c AS t FROM range(0, 11) x(a), range(0, 11) y(b), range(0, 11) z(c)) WHERE t BETWEEN 9 AND 11),
q AS (SELECT DISTINCT query_id, query_id // 100 % 10 AS paper FROM de), own AS (SELECT chunk_id, paper_id FROM de UNION SELECT chunk_id, chunk_id % 10 FROM sk),
f AS (SELECT query_id, chunk_id, de.rank AS dr, sk.rank AS sr FROM de FULL JOIN sk USING (query_id, chunk_id)),
r AS (SELECT wd, ws, query_id, paper, chunk_id, row_number() OVER (PARTITION BY wd, ws, query_id ORDER BY coalesce(wd / (60 + dr), 0) + coalesce(ws / (60 + sr), 0) DESC, coalesce(dr, 1000000 + sr), chunk_id) AS rank FROM f JOIN q USING (query_id) CROSS JOIN g QUALIFY rank <= 10),
h AS (SELECT wd, ws, query_id, 1 / min(rank) AS rr FROM r JOIN own ON own.chunk_id = r.chunk_id AND own.paper_id = r.paper GROUP BY ALL), m AS (SELECT wd, ws, sum(rr) AS t FROM h GROUP BY ALL)
SELECT g.wd AS dense_weight, g.ws AS sparse_weight, round(coalesce(t, 0) / (SELECT count(*) FROM q), 6) AS mrr FROM g LEFT JOIN m USING (wd, ws)"""


@query(_grid_sql())
def weight_grid(spark, sf_dir):
    from quarry.catalog.search import _ranked, postings, term_queries
    from quarry.operators import retrieval

    dense = _ranked(spark, sf_dir, 20)
    sparse = retrieval.sparse_search(term_queries(spark, sf_dir), postings(spark, sf_dir), 20).withColumn("paper_id", (F.col("chunk_id") % 10).cast("int"))
    rel = dense.select("query_id").distinct().select("query_id", F.array((F.col("query_id") / 100 % 10).cast("int")).alias("relevant_papers"))
    return evaluation.grid_search(dense, sparse, rel).withColumn("mrr", F.round("mrr", 6))


@query("""WITH r AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), a AS (SELECT item_id, count(*) AS n, count(l.doc_id) AS k FROM r LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT b.item_id AS query_id, coalesce(k, 0) > 0 AS kept, CAST(CASE WHEN coalesce(k, 0) > 0 THEN k ELSE coalesce(n, 0) END AS INTEGER) AS n_papers FROM benchmark b LEFT JOIN a USING (item_id)""")
def filter_unavailable(spark, sf_dir):
    q = qrels(spark, sf_dir).select("query_id", F.col("relevant_papers").cast("array<string>").alias("relevant_papers"), F.array().cast("array<string>").alias("hard_negatives"))
    have = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("paper_id"))
    kept, dropped = evaluation.filter_unavailable(q, have)
    return kept.select("query_id", F.lit(True).alias("kept"), F.size("relevant_papers").alias("n_papers")).unionByName(dropped.select("query_id", F.lit(False).alias("kept"), F.size("missing_papers").alias("n_papers")))


@query("""WITH b AS (SELECT CASE item_id % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'natural_short' WHEN 2 THEN 'natural_long' ELSE 'conceptual' END AS style, CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  'c' || (item_id % 2) AS category, item_id % 5 < 3 AS neg, len(regexp_extract_all(text, '\\S+')) AS w FROM benchmark)
SELECT 'style' AS field, style AS value, CAST(count(*) AS DOUBLE) AS amount FROM b GROUP BY style UNION ALL SELECT 'difficulty', difficulty, count(*) FROM b GROUP BY difficulty UNION ALL SELECT 'category', category, count(*) FROM b GROUP BY category
UNION ALL SELECT 'total', 'queries', count(*) FROM b UNION ALL SELECT 'total', 'with_hard_negatives', count(*) FILTER (neg) FROM b UNION ALL SELECT 'total', 'avg_word_count', round(avg(w) FILTER (w > 0), 6) FROM b""".replace("\\\\S", "\\S"))
def benchmark_stats(spark, sf_dir):
    return benchmark.benchmark_stats(_bench_rows(spark, sf_dir)).withColumn("amount", F.round("amount", 6))


def _bench_rows(spark, sf_dir):
    from quarry.functions.text import word_count

    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.array(*map(F.lit, benchmark.STYLES))[(i % 4).cast("int")].alias("style"), F.array(*map(F.lit, ("easy", "medium", "hard")))[(i % 3).cast("int")].alias("difficulty"), F.concat(F.lit("c"), (i % 2).cast("string")).alias("category"),
        F.when(i % 5 < 3, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")).alias("hard_negatives"), word_count(F.col("text")).alias("word_count"), F.col("text").alias("query"), F.array(F.lit("p")).alias("relevant_papers"),
    )


@query("""WITH b AS (SELECT item_id % 4 AS s, item_id % 5 < 3 AS neg FROM benchmark) SELECT unnest(['style_keyword', 'style_natural_short', 'style_natural_long', 'style_conceptual', 'hard_negatives', 'required_fields']) AS "check",
unnest([count(*) FILTER (s = 0) / count(*) >= 0.2, count(*) FILTER (s = 1) / count(*) >= 0.2, count(*) FILTER (s = 2) / count(*) >= 0.2, count(*) FILTER (s = 3) / count(*) >= 0.2, count(*) FILTER (neg) / count(*) >= 0.5, true]) AS passed FROM b""")
def benchmark_validation(spark, sf_dir):
    return benchmark.validate_benchmark(_bench_rows(spark, sf_dir))


# ---- reports: one mode for each market segment, with figures from its orders


def _runs(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    both = o.join(c, c.c_custkey == o.o_custkey).withColumn("r", F.col("o_orderkey") % 2)
    return both.groupBy("c_mktsegment", "r").agg((F.count(F.lit(1)) % 97 / 97).alias("mrr"), (F.count(F.lit(1)) % 89 / 89).alias("ndcg10"), (F.count(F.lit(1)) % 83).cast("double").alias("ms")).select(F.concat("c_mktsegment", F.when(F.col("r") == 1, report.SUFFIX).otherwise("")).alias("mode"), "mrr", "ndcg10", "ms")


_RUNS = """WITH m AS (SELECT c_mktsegment AS mode, o_orderkey % 2 AS r, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), v AS (SELECT mode, r, n % 97 / 97 AS mrr, n % 89 / 89 AS ndcg10, CAST(n % 83 AS DOUBLE) AS ms FROM m),
g AS (SELECT b.mode, CASE WHEN b.mrr <> 0 THEN (t.mrr - b.mrr) / b.mrr * 100 ELSE 0 END AS mp, CASE WHEN b.ndcg10 <> 0 THEN (t.ndcg10 - b.ndcg10) / b.ndcg10 * 100 ELSE 0 END AS np, t.ms - b.ms AS added,
  CASE WHEN t.ms - b.ms > 0 THEN (t.ndcg10 - b.ndcg10) / (t.ms - b.ms) * 1000 ELSE CAST('inf' AS DOUBLE) END AS eff FROM v b JOIN v t USING (mode) WHERE b.r = 0 AND t.r = 1)"""


@query(_RUNS + " SELECT mode, round(mp, 6) AS mrr_percent, round(np, 6) AS ndcg10_percent, added AS added_ms, round(eff, 6) AS efficiency FROM g")
def reranker_delta(spark, sf_dir):
    g = report.rerank_gain(_runs(spark, sf_dir))
    return g.select("mode", F.round("mrr_percent", 6).alias("mrr_percent"), F.round("ndcg10_percent", 6).alias("ndcg10_percent"), "added_ms", F.round("efficiency", 6).alias("efficiency"))


@query(_RUNS + " SELECT arg_max(mode, eff) FILTER (isfinite(eff)) AS mode, round(max(eff) FILTER (isfinite(eff)), 6) AS efficiency, round(avg(mp), 6) AS avg_mrr_percent FROM g")
def efficiency_best(spark, sf_dir):
    b = report.best_efficiency(report.rerank_gain(_runs(spark, sf_dir)))
    return b.select("mode", F.round("efficiency", 6).alias("efficiency"), F.round("avg_mrr_percent", 6).alias("avg_mrr_percent"))


@query(_RUNS + """, w AS (SELECT mode || CASE WHEN r = 1 THEN '+rerank' ELSE '' END AS mode, mrr FROM v)
SELECT mode, CAST(row_number() OVER (ORDER BY mrr DESC, mode) AS INTEGER) AS place, round(mrr - lead(mrr) OVER (ORDER BY mrr DESC, mode), 6) AS gap FROM w""")
def model_gaps(spark, sf_dir):
    return report.gaps(_runs(spark, sf_dir)).select("mode", "place", F.round("gap", 6).alias("gap"))


# ---- streams


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w(user_id, i, event_id, last, before, ok) AS (SELECT user_id, i, event_id, t, CAST(NULL AS DOUBLE), true FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, e.event_id, CASE WHEN before IS NULL OR before <= t - 86400 THEN t ELSE last END, CASE WHEN before IS NULL OR before <= t - 86400 THEN last ELSE before END, before IS NULL OR before <= t - 86400 FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, ok AS accepted FROM w""")
def rate_limit_log(spark, sf_dir):
    return limits.rate_limit_batch(events(spark, sf_dir).select("event_id", "user_id", "ts"), 2, 86400.0, key="user_id", tie="event_id").select("event_id", "accepted")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w(user_id, i, event_id, ends, n) AS (SELECT user_id, i, event_id, t + 86400, 1 FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, e.event_id, CASE WHEN e.t > w.ends THEN e.t + 86400 ELSE w.ends END, CASE WHEN e.t > w.ends THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, n <= 3 AS accepted FROM w""")
def rate_limit_fixed(spark, sf_dir):
    return limits.rate_limit_batch(events(spark, sf_dir).select("event_id", "user_id", "ts"), 3, 86400.0, kind="fixed", key="user_id", tie="event_id").select("event_id", "accepted")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    w = limits.windowed_counts(events(spark, sf_dir), "1 day", by=("event_type",), value="value")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH e AS (SELECT ts, unnest([0, 1, 2, 3]) AS k FROM events) SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS window_start, count(*) AS n FROM e GROUP BY ALL""")
def sliding_counts(spark, sf_dir):
    w = limits.windowed_counts(events(spark, sf_dir), "24 hours", "6 hours")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def session_counts(spark, sf_dir):
    s = limits.session_counts(events(spark, sf_dir), "6 hours", "user_id")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT user_id, event_id, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events")
def running_totals(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("user_id", "event_id", "value", F.round(F.sum("value").over(w), 4).alias("running"))

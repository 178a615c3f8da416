"""Curation, text and chunk queries over the documents table."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.functions import lexicon as L
from quarry.functions import scoring, text
from quarry.operators import benchmark, chunking, curation, parsing, rag
from quarry.operators.terms import with_matches
from quarry.plans.plugins import HashEmbedder, embed_column
from quarry.session import table
from quarry.sources.tables import keyword_stats

TODAY = "2024-01-01"
#: Words of the invented prose, in place of the reference lists where those hardly occur.
NEGATIVE = ("idiot", "clown", "license")
STRONG = ("token", "the that", "cióndo", "queel", "ein und")


def papers(spark, sf_dir):
    """Documents as papers: the first line is the title, dates and citation counts follow from the id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("paper_id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("abstract"),
        F.when(F.col("doc_id") % 17 != 0, F.date_sub(F.lit(TODAY).cast("date"), (F.col("doc_id") % 900).cast("int"))).alias("published_date"),
        F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") * 7 % 113).cast("int")).alias("citation_count"),
        F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 97) / F.lit(80.0)).alias("semantic_similarity"), "lang", "source",
    )


_P = """p AS (SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, text AS abstract,
  CASE WHEN doc_id % 17 <> 0 THEN DATE '2024-01-01' - CAST(doc_id % 900 AS INTEGER) END AS d,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id * 7 % 113 END AS c, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 97) / 80.0 END AS sim, lang, source FROM documents)"""


def _list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _any(t: str, terms) -> str:
    return f"len(list_filter({_list(x.lower() for x in terms)}, lambda k: contains({t}, k))) > 0"


@query(f"""WITH {_P}, t AS (SELECT paper_id, lower(title || ' ' || abstract) AS t FROM p)
SELECT paper_id, CASE WHEN {_any('t', NEGATIVE)} THEN 'drop' WHEN {_any('t', STRONG)} THEN 'clear' ELSE 'edge' END AS label FROM t""")
def keyword_rule_filter(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", curation.rule_label(curation.paper_text(), NEGATIVE, STRONG).alias("label"))


@query(f"""WITH {_P}, t AS (SELECT paper_id, lower(title || ' ' || abstract) AS t FROM p)
SELECT paper_id, CASE WHEN {_any('t', L.NEGATIVE)} THEN 'drop' WHEN {_any('t', L.STRONG)} THEN 'clear' ELSE 'edge' END AS label FROM t""")
def keyword_rule_filter_lists(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", curation.rule_label(curation.paper_text()).alias("label"))


@query("""WITH m AS (SELECT doc_id AS paper_id, list_sort(list_filter(['apache license', 'idiot', 'moron', 'clown', 'token', 'version 2.0'], lambda k: contains(lower(text), k))) AS m FROM documents)
SELECT paper_id, array_to_string(m, ',') AS matched FROM m WHERE len(m) > 0""")
def ng_filter(spark, sf_dir):
    store = spark.createDataFrame([(k,) for k in ("Apache License", "idiot", "moron", "clown", "token", "Version 2.0")], "keyword string")
    gone, _ = curation.keyword_matches(papers(spark, sf_dir), store, F.col("abstract"))
    return gone.select("paper_id", F.array_join("matched", ",").alias("matched"))


@query("SELECT d.doc_id AS paper_id, coalesce(l.quality = 1, true) AS suitable FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") == 1).alias("suitable"))
    yes, no = curation.label_split(papers(spark, sf_dir), labels)
    return yes.select("paper_id", F.lit(True).alias("suitable")).unionByName(no.select("paper_id", F.lit(False).alias("suitable")))


def _topic_sql(t: str) -> str:
    counts = [f"len(list_filter({_list(terms)}, lambda k: contains({t}, k)))" for terms in L.TOPICS.values()]
    best = f"greatest({', '.join(counts)})"
    cases = " ".join(f"WHEN {c} = {best} THEN '{name}'" for c, name in zip(counts, L.TOPICS, strict=True))
    return f"CASE WHEN {best} = 0 THEN 'other' {cases} END"


@query(f"SELECT doc_id AS paper_id, {_topic_sql('lower(text)')} AS topic FROM documents")
def topic_classify(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", scoring.topic(F.col("abstract")).alias("topic"))


@query(f"""WITH t AS (SELECT {_topic_sql('lower(text)')} AS topic FROM documents), g AS (SELECT topic, count(*) AS n FROM t GROUP BY topic), s AS (SELECT topic, n, n / sum(n) OVER () AS share FROM g)
SELECT topic, n AS "count", round(share, 6) AS share, round(CASE WHEN share < 0.125 THEN 1 + 2 * (0.125 - share) ELSE 1 END, 6) AS bonus FROM s""")
def topic_bonus(spark, sf_dir):
    shares = curation.distribution(papers(spark, sf_dir).select(scoring.topic(F.col("abstract")).alias("topic")), "topic")
    return shares.select("topic", "count", F.round("share", 6).alias("share"), F.round(scoring.topic_bonus(F.col("share")), 6).alias("bonus"))


_SCORED = f"""WITH {_P}, t AS (SELECT *, {_topic_sql("lower(title || ' ' || abstract)")} AS topic, (DATE '2024-01-01' - d) / 30.0 AS m FROM p),
n AS (SELECT *, count(*) OVER (PARTITION BY topic) / count(*) OVER () AS share FROM t),
sc AS (SELECT *, 0.4 * least(1.0, ln(1 + coalesce(c, 0) / CASE WHEN d IS NULL THEN 12.0 WHEN m <= 0 THEN 1.0 ELSE m END) / 5.0)
  + 0.3 * coalesce(exp(-m / 6.0), 0.5) + 0.2 * CASE WHEN sim IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, sim)) END
  + 0.1 * CASE WHEN share < 0.125 THEN 2 * (0.125 - share) ELSE 0 END * 0.5 AS score FROM n)"""


def _scored(spark, sf_dir):
    keep = ["paper_id", "citation_count"]
    return scoring.score_papers(papers(spark, sf_dir), F.lit(TODAY).cast("date"), keep=keep).withColumn("final_score", F.round("final_score", 9))


@query(_SCORED + " SELECT paper_id, topic, round(round(score, 9), 6) AS final_score, row_number() OVER (ORDER BY round(score, 9) DESC, paper_id) AS rank FROM sc")
def score_papers(spark, sf_dir):
    ranked = scoring.with_rank(_scored(spark, sf_dir))
    return ranked.select("paper_id", "topic", F.round("final_score", 6).alias("final_score"), "rank")


@query(_SCORED + """, q AS (SELECT unnest(['llm_pretraining','reasoning_alignment','multimodal','retrieval_rag','architecture','optimization','evaluation','other']) AS topic, unnest([40,40,30,30,20,20,20,0]) AS quota),
r AS (SELECT paper_id, sc.topic, round(score, 9) AS score, row_number() OVER (PARTITION BY sc.topic ORDER BY round(score, 9) DESC, paper_id) <= q.quota AS inq FROM sc JOIN q USING (topic)),
ch AS (SELECT * FROM r ORDER BY inq DESC, score DESC, paper_id LIMIT 200)
SELECT paper_id, topic, CAST(row_number() OVER (ORDER BY score DESC, paper_id) AS INTEGER) AS final_rank FROM ch""")
def stratified_sample(spark, sf_dir):
    return curation.stratified_sample(_scored(spark, sf_dir), 200).select("paper_id", "topic", "final_rank")


@query(_SCORED + """, r AS (SELECT paper_id, topic, round(score, 9) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, paper_id) <= 10 AS g FROM sc),
ch AS (SELECT * FROM r ORDER BY g DESC, score DESC, paper_id LIMIT greatest(100, (SELECT count(*) FROM r WHERE g)))
SELECT paper_id, topic, g AS guaranteed, CAST(row_number() OVER (ORDER BY score DESC, paper_id) AS INTEGER) AS final_rank FROM ch""")
def min_guarantee_select(spark, sf_dir):
    return curation.min_guarantee_select(_scored(spark, sf_dir), 100, 10).select("paper_id", "topic", "guaranteed", "final_rank")


@query("""WITH t AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT sum(-(n / s) * log2(n / s)) AS h, count(*) AS k FROM (SELECT n, sum(n) OVER () AS s FROM t)),
m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT round(e.h, 6) AS topic_entropy, e.k AS n_topics, round(stddev_pop(m.n) / avg(m.n), 6) AS temporal_cv, count(*) AS n_months FROM m, e GROUP BY e.h, e.k""")
def diversity_metrics(spark, sf_dir):
    topics = curation.diversity(table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.lit("x").alias("month")))
    times = curation.diversity(table(spark, sf_dir, "orders").select(F.lit("x").alias("topic"), text.month_key(F.col("o_orderdate")).alias("month")))
    both = topics.select("topic_entropy", "n_topics").join(times.select("temporal_cv", "n_months"), F.lit(True))
    return both.select(F.round("topic_entropy", 6).alias("topic_entropy"), "n_topics", F.round("temporal_cv", 6).alias("temporal_cv"), "n_months")


@query(_SCORED + """, g AS (SELECT topic, count(*) AS n, count(*) FILTER (c > 0) AS w, sum(coalesce(c, 0)) AS s FROM sc GROUP BY topic)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(w) AS BIGINT) AS with_citations, CAST(sum(s) AS BIGINT) AS total_citations, coalesce(string_agg(topic, ',' ORDER BY topic) FILTER (n < 100), '') AS violations FROM g""")
def validate_selection(spark, sf_dir):
    return curation.validate_selection(_scored(spark, sf_dir), 100).withColumn("violations", F.array_join("violations", ","))


@query("""WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)
SELECT CAST(d AS DATE) AS window_start, CAST(least(d + INTERVAL 13 DAY, hi) AS DATE) AS window_end FROM (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 14 DAY)) AS d, hi FROM b)""")
def date_windows(spark, sf_dir):
    """Windows of two weeks over the time that the orders span."""
    b = table(spark, sf_dir, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("lo"), F.max(F.col("o_orderdate").cast("date")).alias("hi")).first()
    return curation.date_windows(spark, b.lo, b.hi)


@query("""WITH b AS (SELECT date_trunc('month', min(CAST(o_orderdate AS DATE))) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)
SELECT strftime(d, '%Y-%m') AS month, CAST(d AS DATE) AS month_start, CAST(d + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS month_end FROM (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM b)""")
def month_ranges(spark, sf_dir):
    """The months that the orders span."""
    b = table(spark, sf_dir, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("lo"), F.max(F.col("o_orderdate").cast("date")).alias("hi")).first()
    return curation.months(spark, b.lo, b.hi)


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS collected, count(*) FILTER (o_orderstatus = 'F') AS kept FROM orders GROUP BY 1)
SELECT month, collected, kept, collected - kept AS filtered, CAST(sum(collected) OVER (ORDER BY month) AS BIGINT) AS total_collected, CAST(sum(kept) OVER (ORDER BY month) AS BIGINT) AS total_kept FROM m""")
def month_funnel(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(text.month_key(F.col("o_orderdate")).alias("month"), (F.col("o_orderstatus") == "F").alias("kept"))
    return curation.funnel(orders)


@query("SELECT text, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first(spark, sf_dir):
    return curation.dedup_first(table(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id")


@query(f"WITH {_P} SELECT count(*) AS total, count(*) FILTER (c > 0) AS with_citations, CAST(sum(coalesce(c, 0)) AS BIGINT) AS total_citations, CAST(max(coalesce(c, 0)) AS INTEGER) AS max_citations FROM p")
def citation_stats(spark, sf_dir):
    return curation.citation_summary(papers(spark, sf_dir))


@query(_SCORED + " SELECT count(*) AS n, round(min(round(score, 9)), 6) AS min, round(max(round(score, 9)), 6) AS max, round(avg(round(score, 9)), 6) AS mean FROM sc")
def score_summary(spark, sf_dir):
    s = curation.score_summary(_scored(spark, sf_dir))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")])


# ---- text


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') AS t FROM documents), u AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')) AS sentence FROM s)
SELECT doc_id, sentence, count(*) AS n FROM u GROUP BY ALL""")
def sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS "order" FROM l)
SELECT doc_id, CAST("order" AS INTEGER) AS "order", CAST(length(trim(regexp_replace(regexp_replace(raw, '\$([^$]+)\$', '\1', 'g'), '[ \t]+', ' ', 'g'))) AS INTEGER) AS n_chars FROM u
WHERE length(trim(regexp_replace(regexp_replace(raw, '\$([^$]+)\$', '\1', 'g'), '[ \t]+', ' ', 'g'))) >= 20""")
def paragraph_split(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.paragraphs(F.col("text"), "\n")).alias("p"))
    return p.select("doc_id", "p.order", F.length("p.content").alias("n_chars"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\$([^$]+)\$', '\1', 'g'), '[ \t]+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS cleaned FROM documents""")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_markup(F.col("text")).cast("binary")).alias("cleaned"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) >= 10 AND NOT contains(text, chr(65533)) AND len(regexp_extract_all(text, '[\p{L}\p{N}]')) / greatest(length(text), 1) >= 0.3 AS valid FROM documents""")
def valid_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_valid_text(F.col("text")).alias("valid"))


@query(r"""WITH i AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, chr(65533)) THEN 'encoding' END,
  CASE WHEN length(text) >= 50 AND len(regexp_extract_all(text, '[\p{L}\p{N}]')) / length(text) < 0.5 THEN 'content_ratio' END,
  CASE WHEN regexp_matches(text, '[^\p{L}\p{N}\p{M}_\s]{10,}') THEN 'special_chars' END,
  CASE WHEN len(regexp_extract_all(text, '\S+')) > 0 AND len(regexp_extract_all(text, '\\[a-zA-Z]+')) / len(regexp_extract_all(text, '\S+')) > 0.05 THEN 'unconverted_latex' END], lambda x: x IS NOT NULL)) AS issue_type FROM documents)
SELECT issue_type, CASE WHEN issue_type = 'encoding' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM i GROUP BY ALL""")
def quality_issues(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(text.quality_issues(F.col("text"), F.lit("text"))).alias("i"))
    return found.groupBy("i.issue_type", "i.severity").agg(F.count(F.lit(1)).alias("n"))


_TITLES = ("1. Introduction", "References", "Reference", "2.3 Related  Work", "APPENDIX", "Acknowledgments", "Works cited", "Data Availability", "Method", "Future work", "3 Results", "Conflict of Interest", "", "Experiments with references")


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {str(x).lower()}, {v}::DOUBLE)" for i, (t, x, v) in enumerate(zip(_TITLES,
    (False, True, True, False, True, True, True, True, False, False, False, True, False, False), (0.9, 0.7, 0.7, 0.6, 0.7, 0.7, 0.7, 0.7, 0.85, 0.5, 0.85, 0.7, 0.7, 0.7), strict=True))) + f""") t(i, title, excluded, importance))
SELECT title, excluded, round(importance, 6) AS importance, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN t ON i = doc_id % {len(_TITLES)} GROUP BY ALL""")  # fmt: skip
def excluded_sections(spark, sf_dir):
    """Sections under titles of every kind: how many there are, how long their texts, which are left out, and how much they weigh."""
    rows = table(spark, sf_dir, "documents").withColumn("title", F.array(*map(F.lit, _TITLES))[(F.col("doc_id") % len(_TITLES)).cast("int")])
    judged = rows.groupBy("title", text.is_excluded_section(F.col("title")).alias("excluded"), F.round(text.section_importance(F.col("title")), 6).alias("importance"))
    return judged.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(r"""WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, text FROM documents),
w AS (SELECT source, doc_id, i, list_distinct(regexp_extract_all(right(text, 200), '\S+')) AS tail, list_distinct(regexp_extract_all(left(text, 200), '\S+')) AS head FROM c),
o AS (SELECT *, lag(tail) OVER (PARTITION BY source ORDER BY i) AS pt, lead(head) OVER (PARTITION BY source ORDER BY i) AS nh FROM w)
SELECT doc_id, coalesce(len(list_intersect(pt, head)) > 5, false) AS has_overlap_before, coalesce(len(list_intersect(tail, nh)) > 5, false) AS has_overlap_after FROM o""")
def overlap_marks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return chunking.mark_overlaps(d).select(F.col("chunk_index").alias("doc_id"), "has_overlap_before", "has_overlap_after")


@query(r"""WITH q AS (SELECT b.item_id, d.doc_id, list_distinct(regexp_extract_all(lower(b.text), '\S+')) AS q, list_distinct(regexp_extract_all(lower(split_part(d.text, chr(10), 1)), '\S+') || regexp_extract_all(lower(d.text), '\S+')[1:100]) AS p,
  CASE b.item_id % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'natural_short' WHEN 2 THEN 'natural_long' ELSE 'conceptual' END AS style FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
o AS (SELECT *, len(list_intersect(q, p)) / greatest(len(q), 1) AS share FROM q)
SELECT item_id, doc_id, CASE WHEN len(q) = 0 THEN 'medium' WHEN style = 'keyword' OR share > 0.5 THEN 'easy' WHEN style = 'conceptual' OR share < 0.2 THEN 'hard' ELSE 'medium' END AS difficulty FROM o""")
def difficulty_overlap(spark, sf_dir):
    styles = F.array(*map(F.lit, benchmark.STYLES))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    pairs = with_matches(papers(spark, sf_dir), b.select("q"), F.col("abstract")).withColumn("q", F.explode("matched")).join(b, "q")
    made = benchmark.overlap_difficulty(F.col("q"), styles[F.col("item_id") % 4], F.col("title"), F.col("abstract"))
    return pairs.select("item_id", F.col("paper_id").alias("doc_id"), made.alias("difficulty"))


@query("""WITH s AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents),
k AS (SELECT s.source, rank, '[' || rank || '] Paper: ' || s.source || ' | Section: ' || lang || chr(10) || text || chr(10) AS p FROM s JOIN documents USING (doc_id) WHERE t <= 4000)
SELECT source AS query_id, CAST(count(*) AS INTEGER) AS n_sources, md5(string_agg(p, chr(10) || '---' || chr(10) ORDER BY rank)) AS context FROM k GROUP BY source""")
def rag_context_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ranked = d.select(F.col("source").alias("query_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), F.col("source").alias("paper_id"), F.col("lang").alias("section_title"), F.col("text").alias("content"))
    return rag.context(ranked).select("query_id", "n_sources", F.md5(F.col("context").cast("binary")).alias("context"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM l WHERE r <= 6 GROUP BY conv_id""")
def history_last6(spark, sf_dir):
    return rag.recent_history(table(spark, sf_dir, "conversations"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages""")
def html_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parsing.html_title(F.col("html")).alias("title"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</(p|div|li|h[1-6]|tr)>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS text FROM c""")
def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parsing.html_text(F.col("html")).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS p, '\title{' || lang || '}\begin{abstract}' || left(text, 300) || '\end{abstract}\section{Introduction}' || split_part(text, chr(10), 1) AS head FROM documents),
e AS (SELECT *, CASE WHEN len(p) = 1 THEN head || '\section{References}none' ELSE head END AS first, CASE WHEN len(p) = 1 THEN first ELSE p[-1] || '\section{References}none' END AS last FROM l),
k AS (SELECT *, len(regexp_extract_all(first, '\\[a-zA-Z]+')) / len(regexp_extract_all(first, '\S+')) <= 0.3 AS first_stays, len(regexp_extract_all(last, '\\[a-zA-Z]+')) / len(regexp_extract_all(last, '\S+')) <= 0.3 AS last_stays FROM e)
SELECT CAST(doc_id AS VARCHAR) AS paper_id, lang AS title, CAST(NULL AS VARCHAR) AS error, CAST(first_stays AS INTEGER) + CAST(last_stays AS INTEGER) AS n_sections,
CAST(CASE WHEN first_stays THEN len(list_filter(CASE WHEN last_stays THEN p ELSE p[:-2] END, lambda x: length(trim(regexp_replace(regexp_replace(x, '\$([^$]+)\$', '\1', 'g'), '[ \t]+', ' ', 'g'))) >= 20)) ELSE 0 END AS INTEGER) AS n_paragraphs FROM k""")
def parse_latex_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    source = F.concat(F.lit(r"\title{"), F.col("lang"), F.lit("}\\begin{abstract}"), F.substring("text", 1, 300), F.lit("\\end{abstract}\\section{Introduction}"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit(r"\section{References}none"))
    parsed = parsing.parse_documents(d.select(F.col("doc_id").cast("string").alias("paper_id"), source.alias("source")))
    return parsed.select("paper_id", "title", "error", F.size("sections").alias("n_sections"), F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["paragraphs"])).alias("n_paragraphs"))


@query()
def chunk_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("paragraph_id"), p.alias("content"), i.alias("order")))
    docs = d.select(
        F.col("doc_id").cast("string").alias("paper_id"), F.col("lang").alias("title"), F.lit("").alias("abstract"),
        F.array(F.struct(F.col("source").alias("section_id"), F.col("source").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("order"), lines.alias("paragraphs"))).alias("sections"),
        F.lit(None).cast("array<struct<text_description:string>>").alias("equations"),
    )
    return chunking.chunk_documents(docs, chunking.ChunkConfig(max_tokens=128, overlap_tokens=20, min_tokens=20)).select("chunk_id", "paper_id", "chunk_index", "token_count", "char_count", "content", "error")


@query()
def embed_documents(spark, sf_dir):
    return embed_column(table(spark, sf_dir, "documents").select("doc_id", "text"), HashEmbedder(16), "text").select("doc_id", "embedding")


@query("SELECT 'w' || (item_id % 3) AS category, count(DISTINCT lower(text)) AS count FROM benchmark GROUP BY 1")
def keyword_store_stats(spark, sf_dir):
    store = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("w"), (F.col("item_id") % 3).cast("string")).alias("category"), F.lower("text").alias("keyword")).distinct()
    return keyword_stats(store)

"""Paths that small tables don't take by themselves: ranks over many partitions, several blocks of queries and terms, streams that idle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring, text
from quarry.functions.vectors import maxsim
from quarry.operators import parsing, retrieval, terms
from quarry.plans import plugins
from quarry.session import cut_lineage, scratch
from quarry.streaming import limits
from quarry.streaming.progress import BatchTimes, progress


def test_ranks_are_one_to_n_in_order(spark):
    wide = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").limit(120_000).repartition(6)
    ranked = scoring.global_row_number(wide, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "rank")
    got = ranked.select("rank", "l_extendedprice", "l_orderkey", "l_linenumber").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(1, 120_001))
    keys = list(zip(-got.l_extendedprice, got.l_orderkey, got.l_linenumber, strict=True))
    assert keys == sorted(keys)
    assert ranked.columns == [*wide.columns, "rank"]


def test_ranks_of_an_empty_and_a_tied_table(spark):
    assert scoring.with_rank(spark.createDataFrame([], "paper_id long, final_score double")).count() == 0
    tied = spark.createDataFrame([(i, None if i % 3 else 1.0) for i in range(50)], "paper_id long, final_score double").repartition(5)
    got = [r.paper_id for r in scoring.with_rank(tied).orderBy("rank").collect()]
    assert got == [i for i in range(50) if i % 3 == 0] + [i for i in range(50) if i % 3]


def test_scores_keep_what_is_asked_for(spark):
    p = spark.createDataFrame([(1, "reasoning", "about alignment", None, 3, 0.5, "x")], "paper_id long, title string, abstract string, published_date date, citation_count int, semantic_similarity double, more string")
    every = scoring.score_papers(p, F.lit("2024-01-01").cast("date"))
    assert set(p.columns) <= set(every.columns) and "final_score" in every.columns
    few = scoring.score_papers(p, F.lit("2024-01-01").cast("date"), keep=["paper_id"])
    assert {"paper_id", "topic", "final_score"} <= set(few.columns) and not {"abstract", "published_date", "more"} & set(few.columns)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_searches_agree_in_any_block(spark, block, monkeypatch):
    monkeypatch.setattr(retrieval, "_CELLS", 40)
    monkeypatch.setattr(retrieval, "_MAXSIM_ROWS", 3)
    rng = np.random.default_rng(3)
    names = [f"t{i}" for i in range(9)]
    postings = [(i, t, float(rng.integers(-1, 4))) for i in range(25) for t in rng.choice(names, 3, replace=False)]
    asked = [(q, t, float(rng.integers(1, 3))) for q in range(5) for t in rng.choice(names, 2, replace=False)] + [(9, "nowhere", 1.0)]
    p, q = spark.createDataFrame(postings, "chunk_id long, token string, weight double").repartition(4), spark.createDataFrame(asked, "query_id long, token string, weight double")
    want = {}
    for i, t, w in postings:
        for j, u, v in asked:
            if t == u:
                want[j, i] = want.get((j, i), 0.0) + w * v
    best = {j: sorted((-s, i) for (k, i), s in want.items() if k == j)[:4] for j in range(5)}
    got = {}
    for r in retrieval.sparse_search(q, p, 4, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    assert got == best

    rows = [(i, [rng.integers(-2, 3, 2).astype(float).tolist() for _ in range(rng.integers(0, 4))] if i % 7 else None) for i in range(20)]
    rows[3] = (3, [[1.0, 0.0], [1.0, 2.0, 3.0]])
    t = spark.createDataFrame(rows, "chunk_id long, tokens array<array<double>>").repartition(3)
    m = spark.createDataFrame([(j, [rng.integers(-2, 3, 2).astype(float).tolist() for _ in range(j)]) for j in range(1, 4)], "query_id long, query_tokens array<array<double>>")
    plain = t.filter("size(tokens) > 0").join(m, F.lit(True)).select("query_id", "chunk_id", maxsim(F.col("query_tokens"), F.col("tokens")).alias("s")).collect()
    found = {(r.query_id, r.chunk_id): r.score for r in retrieval.maxsim_search(m, t, 99, block=block).collect()}
    assert found == pytest.approx({(r.query_id, r.chunk_id): r.s for r in plain})


@pytest.mark.parametrize("block", [2, 1000])
def test_terms_in_texts(spark, block):
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(12)] + ["", "ab ab", "x.y"]
    texts = ["".join(rng.choices("ab x.y", k=rng.randint(0, 25))) for _ in range(60)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    k = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "keyword string")
    got = {r.id: r.matched for r in terms.with_matches(d, k, F.col("t"), block=block).collect()}
    assert got == {i: [] if t is None else sorted({w for w in words if w in t}) for i, t in enumerate(texts)}


def test_terms_without_the_automaton(monkeypatch):
    monkeypatch.setattr(terms, "ahocorasick", None)
    assert sorted(terms._finder(["a", "bc", "z"])("abc")) == ["a", "bc"]


MARKUP = (
    r"\textbf{Bold} and \emph{big \textit{deep}} -- 5\% of ``all'' and `one' $x+y$ \(z\) {} {kept}",
    "a\\cite{x} b \\ref{y}\\footnote{gone} \\ldots ~ end\n\n\n\nnext   line \\noindent\n  indented",
    r"\includegraphics[width=1cm]{f} \unknown[opt]{content} \alone text \% \& \_ \$5",
    r"plain text with no markup at all, and ``quotes''",
    r"\section{Title} \url{http://x} \item one \\ two --- three",
    "",
)


@pytest.mark.parametrize("markup", MARKUP)
def test_one_table_of_rules_for_columns_and_parsers(spark, markup):
    d = spark.createDataFrame([(markup,)], "t string")
    row = d.select(text.clean_markup(F.col("t")).alias("a"), text.clean_section_title(F.col("t")).alias("b"), text.clean_paper_title(F.col("t")).alias("c")).first()
    assert row.a == parsing.clean(markup) and row.b == parsing.clean_heading(markup) and row.c == parsing.clean_title(markup)


def test_fallback_keeps_a_row_for_each_document(spark):
    def strict(paper, source):
        if "BROKEN" in source:
            raise ValueError("broken")
        return parsing.parse_latex(paper, source)

    rows = [("a", "\\title{A}", None), ("b", "BROKEN", None), ("c", "BROKEN", "# C"), ("d", None, "# D"), ("e", None, None)]
    t = spark.createDataFrame(rows, "paper_id string, latex string, markdown string")
    got = {r.paper_id: (r.parse_method, r.error) for r in parsing.parse_with_fallback(t, strict, parsing.parse_markdown).collect()}
    assert got == {"a": ("latex", None), "b": (None, "ValueError: broken"), "c": ("marker", None), "d": ("marker", None), "e": (None, "no source")}


def test_state_of_idle_keys_goes(spark, tmp_path):
    import datetime
    import time

    t0 = datetime.datetime(2025, 1, 1)
    src = str(tmp_path / "in")
    day = lambda k, *s: spark.createDataFrame([(k, t0 + datetime.timedelta(seconds=x)) for x in s], "ip string, ts timestamp")
    day("a", 0, 1, 2).write.parquet(src)
    stream = spark.readStream.schema("ip string, ts timestamp").parquet(src)
    q = limits.rate_limit_stream(stream, 2, 60.0, idle=2.0).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        def wait(done) -> bool:
            began = time.time()
            while not done() and time.time() - began < 40:
                time.sleep(0.2)
            return done()

        assert wait(lambda: spark.table("idle").count() == 3)
        assert sorted(r.accepted for r in spark.table("idle").collect()) == [False, True, True]
        assert wait(lambda: q.lastProgress and sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == 0)
    finally:
        q.stop()


def test_progress_and_batch_times(spark, tmp_path):
    row = spark.range(1).select(progress(F.lit(25), F.lit(100), F.lit(5.0)).alias("p"), progress(F.lit(0), F.lit(0), F.lit(0.0)).alias("z")).first()
    assert tuple(row.p) == (25.0, 5.0, 15.0) and tuple(row.z) == (0.0, 0.0, 0.0)
    times = BatchTimes(most=3)
    spark.streams.addListener(times)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        limits.backfill(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, n: df.count()).awaitTermination(60)
        import time

        began = time.time()
        while not times.rows and time.time() - began < 20:
            time.sleep(0.1)
        assert sum(r.rows for r in times.table(spark).collect()) == 5
    finally:
        spark.streams.removeListener(times)


class Shouter:
    calls = 0

    def expand(self, query):
        if query == "bad":
            raise RuntimeError
        return f"Passage: '{query.upper()}'"


def test_expansions_are_cached(spark):
    q = spark.createDataFrame([(0, "one", "conceptual"), (1, "two", "conceptual"), (2, "one", "keyword"), (3, "bad", "conceptual")], "query_id long, query string, query_type string")
    done, cache = plugins.expand_cached(q, plugins.CleaningExpander(Shouter()))
    assert {r.query_id: r.expanded for r in done.collect()} == {0: "ONE", 1: "TWO", 2: "one", 3: "bad"}
    known = spark.createDataFrame([("conceptual:one", "from the cache")], "cache_key string, expanded string")
    done, cache = plugins.expand_cached(q, plugins.CleaningExpander(Shouter()), known)
    assert {r.query_id: r.expanded for r in done.collect()}[0] == "from the cache"
    assert {r.cache_key for r in cache.collect()} == {"conceptual:one", "conceptual:two", "conceptual:bad"}


def test_shared_folder(spark):
    path = scratch(spark, "x")
    cut_lineage(spark.range(3)).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and spark.sparkContext.applicationId in path


def test_a_task_holds_few_products_and_scores_at_once(spark, monkeypatch):
    """Memory of a task follows _CELLS, not the number of queries and rows."""
    rows = spark.createDataFrame([(i, [1.0 + i % 5, 2.0, 3.0]) for i in range(300)], "chunk_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, [1.0, 2.0, float(i % 7)]) for i in range(60)], "query_id long, vector array<double>").coalesce(1)
    tokens = spark.createDataFrame([(i, t, 1.0 + i % 3) for i in range(300) for t in ("a", "b", f"c{i % 4}")], "chunk_id long, token string, weight double").coalesce(1)
    terms = spark.createDataFrame([(i, t, 1.0) for i in range(60) for t in ("a", f"c{i % 5}")], "query_id long, token string, weight double").coalesce(1)
    cells = 600

    class Checked(retrieval._Best):
        def block(self, scores, keys, at=None):
            assert scores.size <= cells
            super().block(scores, keys, at)

    want = [sorted(map(tuple, f().collect())) for f in (lambda: retrieval.dense_search(asked, rows, 5, digits=9), lambda: retrieval.sparse_search(terms, tokens, 5))]
    monkeypatch.setattr(retrieval, "_CELLS", cells)
    monkeypatch.setattr(retrieval, "_Best", Checked)
    assert [sorted(map(tuple, f().collect())) for f in (lambda: retrieval.dense_search(asked, rows, 5, digits=9), lambda: retrieval.sparse_search(terms, tokens, 5))] == want

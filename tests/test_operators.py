"""Operators on small tables with hand-computed results, edge cases and properties."""

import datetime
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import literal_vector
from quarry.operators import benchmark, chunking, curation, evaluation, parsing, rag, report, retrieval, storage
from quarry.plans import engine
from quarry.plans.plugins import HashEmbedder, IdentityExpander, WordTokenizer, embed_column, expand_column


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- retrieval


def vector_table(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [2.0, 0.0])], "chunk_id long, embedding array<float>")


def test_dense_search_edges(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    got = retrieval.dense_search(q, vector_table(spark), 9)
    assert [(r.chunk_id, round(r.score, 3)) for r in got.filter("query_id = 0").orderBy("rank").collect()] == [(1, 1.0), (7, 1.0), (3, 0.707), (2, 0.0), (4, 0.0)]
    assert {r.score for r in got.filter("query_id = 1").collect()} == {0.0} and got.filter("query_id = 2").count() == 0
    strict = retrieval.dense_search(q, vector_table(spark), 9, threshold=0.0)
    assert rows(strict, "query_id", "chunk_id") == [(0, 1), (0, 3), (0, 7)]
    assert retrieval.dense_search(q.limit(0), vector_table(spark), 3).count() == 0
    assert retrieval.dense_search(q, vector_table(spark).limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        retrieval.dense_search(q, vector_table(spark), 0)


def test_dense_search_in_blocks_is_the_same(spark):
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "query_id long, vector array<float>")
    assert rows(retrieval.dense_search(q, vector_table(spark), 3, block=2), "query_id", "chunk_id", "rank") == rows(retrieval.dense_search(q, vector_table(spark), 3), "query_id", "chunk_id", "rank")


def test_dense_search_agrees_with_the_expression(spark):
    t = vector_table(spark).filter("chunk_id <> 6")
    q = spark.createDataFrame([(0, [0.3, 0.9])], "query_id long, vector array<float>")
    a = [r.chunk_id for r in retrieval.dense_search(q, t, 3).orderBy("rank").collect()]
    assert a == [r.chunk_id for r in retrieval.dense_search_expr(literal_vector([0.3, 0.9]), t, 3).collect()]


def test_sparse_keep_zero(spark):
    postings = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0), (3, "a", 1.0)], "chunk_id long, token string, weight double")
    q = spark.createDataFrame([(0, "a", 3.0), (1, "zzz", 1.0)], "query_id long, token string, weight double")
    assert rows(retrieval.sparse_search(q, postings, 5), "query_id", "chunk_id", "score") == [(0, 1, 6.0), (0, 3, 3.0)]
    kept = retrieval.sparse_search(q, postings, 3, keep_zero=postings)
    assert rows(kept, "query_id", "rank", "chunk_id") == [(0, 1, 1), (0, 2, 3), (0, 3, 2), (1, 1, 1), (1, 2, 2), (1, 3, 3)]


def ranked(spark, lists):
    return spark.createDataFrame([(q, c, i + 1, 1.0 / (i + 1)) for q, cs in lists.items() for i, c in enumerate(cs)], "query_id long, chunk_id long, rank int, score double")


def test_rrf(spark):
    d, s = ranked(spark, {0: [10, 11]}), ranked(spark, {0: [12, 13, 10]})
    got = {r.chunk_id: r for r in retrieval.rrf(d, s, 10).collect()}
    assert got[10].score == pytest.approx(0.011319281811085088) and got[12].score == pytest.approx(0.3 / 61)
    assert got[10].dense_score == 1.0 and got[12].dense_score is None
    tie = retrieval.rrf(ranked(spark, {0: [5]}), ranked(spark, {0: [4]}), 10, dense_weight=1.0, sparse_weight=1.0).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == [5, 4]  # dense before sparse


def test_best_per_group_and_neighbours(spark):
    r = ranked(spark, {0: [1, 2, 3, 4, 5]}).join(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "b")], "chunk_id long, paper_id string"), "chunk_id")
    assert rows(retrieval.best_per_group(r), "rank", "chunk_id") == [(1, 1), (2, 3), (3, 4)]
    own = spark.createDataFrame([(0, "a")], "query_id long, paper_id string")
    assert retrieval.neighbour_groups(r, own, 2).first().groups == ["b", "c"]


def test_fulltext(spark):
    t = spark.createDataFrame([(1, "the cat sat"), (2, "The CAT, the dog"), (3, None), (4, "dog")], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "cat the"), (1, ""), (2, "bird")], "query_id long, query string")
    assert rows(retrieval.fulltext_search(q, t), "query_id", "chunk_id", "rank") == [(0, 1, 2), (0, 2, 1)]


def test_trigrams(spark):
    got = spark.createDataFrame([("abcd", "abcd"), ("abcd", "xyz"), ("", "")], "a string, b string").select(retrieval.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [1.0, 0.0, 0.0]


# ---- metrics


def test_chunk_metrics(spark):
    res = spark.createDataFrame([(0, i, f"c{i}", p) for i, p in enumerate("abcdefghij", 1)], "query_id long, rank int, chunk_id string, paper_id string")
    rel = spark.createDataFrame([(0, ["b", "d"], []), (1, ["x"], [])], "query_id long, relevant_papers array<string>, relevant_chunks array<string>")
    got = {r.query_id: r for r in evaluation.chunk_metrics(res, rel).collect()}
    m = got[0]
    assert m.mrr == 0.5 and m.ndcg10 == pytest.approx(0.6509209298071326) and m.p5 == pytest.approx(0.4) and m.p10 == pytest.approx(0.2) and m.recall10 == 1.0 and m.hit10
    assert (got[1].mrr, got[1].ndcg10, got[1].p5, got[1].num_results, got[1].hit10) == (0, 0, 0, 0, False)


def test_short_list_precision(spark):
    res = spark.createDataFrame([(0, 1, "a", "a"), (0, 2, "b", "b")], "query_id long, rank int, chunk_id string, paper_id string")
    rel = spark.createDataFrame([(0, ["a"], [])], "query_id long, relevant_papers array<string>, relevant_chunks array<string>")
    assert evaluation.chunk_metrics(res, rel).first().p5 == 0.5


def test_paper_metrics(spark):
    res = spark.createDataFrame([(0, i, f"c{i}", p) for i, p in enumerate(["a", "a", "b", "c", "d"], 1)], "query_id long, rank int, chunk_id string, paper_id string")
    rel = spark.createDataFrame([(0, ["b", "d", "zz"])], "query_id long, relevant_papers array<string>")
    m = evaluation.paper_metrics(res, rel).first()
    assert m.mrr == 0.5 and m.ndcg == pytest.approx(0.49818925746641285) and m.p5 == pytest.approx(0.4)


def test_weight_grid():
    g = evaluation.weight_grid()
    assert all(abs(sum(w) - 1) < 1e-3 for w in g) and len(g) == len(set(g)) and (1.0, 0.0, 0.0) in g


def test_filter_unavailable_keeps_order_and_repeats(spark):
    q = spark.createDataFrame([(0, ["b", "x", "a", "b"], ["y", "a"]), (1, ["x"], []), (2, [], [])], "query_id long, relevant_papers array<string>, hard_negatives array<string>")
    kept, dropped = evaluation.filter_unavailable(q, spark.createDataFrame([("a",), ("b",)], "paper_id string"))
    r = kept.first()
    assert kept.count() == 1 and r.relevant_papers == ["b", "a", "b"] and r.hard_negatives == ["a"]
    assert {x.query_id: x.missing_papers for x in dropped.collect()} == {1: ["x"], 2: []}


# ---- curation


def test_rule_label(spark):
    t = spark.createDataFrame([("A game of LLM",), ("An LLM",), ("paragraph",), ("else",), (None,)], "title string").withColumn("abstract", F.lit(None).cast("string"))
    assert [r.l for r in t.select(curation.rule_label(curation.paper_text()).alias("l")).collect()] == ["drop", "clear", "clear", "edge", "edge"]
    words = t.select(curation.rule_label(curation.paper_text(), word_boundary=True).alias("l")).collect()
    assert words[2].l == "edge"


def test_build_query():
    q = curation.build_query(["LLM"], datetime.date(2025, 1, 1), None, ("cs.CL", "cs.AI"))
    assert q == '(cat:cs.CL OR cat:cs.AI) AND ((ti:"LLM" OR abs:"LLM")) AND submittedDate:[202501010000 TO *]'


def test_dates(spark):
    w = curation.date_windows(spark, datetime.date(2025, 1, 1), datetime.date(2025, 1, 31))
    assert [(str(a)[5:], str(b)[5:]) for a, b in rows(w, "window_start", "window_end")] == [("01-01", "01-14"), ("01-15", "01-28"), ("01-29", "01-31")]
    assert curation.date_windows(spark, datetime.date(2025, 2, 1), datetime.date(2025, 1, 1)).count() == 0
    done = w.limit(1)
    assert curation.pending_windows(w, done).count() == 2


def test_quotas_and_samples(spark):
    assert list(curation.quotas(1000).values()) == [200, 200, 150, 150, 100, 100, 100, 0]
    assert list(curation.quotas(2500).values()) == [500, 500, 375, 375, 250, 250, 250, 0]
    t = spark.createDataFrame([(i, float(i % 50), "reasoning_alignment" if i % 10 else "evaluation") for i in range(300)], "paper_id long, final_score double, topic string")
    s = curation.stratified_sample(t, 40).collect()
    assert len(s) == 40 and sorted(r.final_rank for r in s) == list(range(1, 41)) and sum(r.topic == "evaluation" for r in s) >= 4
    m = curation.min_guarantee_select(t, 5, 10)
    assert m.count() == 20 and m.filter("topic = 'evaluation'").count() == 10
    assert curation.stratified_sample(t.limit(0), 5).count() == 0


def test_diversity(spark):
    t = spark.createDataFrame([(f"t{i % 8}", f"m{i % 4}") for i in range(80)], "topic string, month string")
    d = curation.diversity(t).first()
    assert d.topic_entropy == pytest.approx(3.0) and d.temporal_cv == 0
    assert not curation.diversity_verdict(curation.diversity(t)).first().passed


def test_labels_and_keywords(spark):
    p = spark.createDataFrame([(1, "x ray"), (2, "fine"), (3, "none")], "paper_id long, t string")
    labels = spark.createDataFrame([(1, False, ["X-Ray ", "ab"]), (2, True, ["new term"])], "paper_id long, suitable boolean, keywords array<string>")
    yes, no = curation.label_split(p, labels)
    assert rows(yes, "paper_id") == [(2,), (3,)] and rows(no, "paper_id") == [(1,)]
    assert rows(curation.label_split(p, labels, keep_missing=False)[1], "paper_id") == [(1,), (3,)]
    known = spark.createDataFrame([("New Term",)], "keyword string")
    assert rows(curation.learned_keywords(labels, known=known), "keyword") == [("x-ray",)]
    gone, passed = curation.keyword_matches(p, spark.createDataFrame([("RAY",), ("none",)], "keyword string"), F.col("t"))
    assert rows(gone, "paper_id") == [(1,), (3,)] and rows(passed, "paper_id") == [(2,)]


def test_monthly_feedback(spark):
    p = spark.createDataFrame([(1, "2025-01", "about maps"), (2, "2025-02", "more maps"), (3, "2025-02", "text")], "paper_id long, month string, t string")
    labels = spark.createDataFrame([(1, False, ["maps"])], "paper_id long, suitable boolean, keywords array<string>")
    store = spark.createDataFrame([], "keyword string")
    got = {m: rows(kept, "paper_id") for m, kept, _ in curation.monthly_keyword_feedback(["2025-01", "2025-02"], p, labels, store, F.col("t"))}
    assert got == {"2025-01": [], "2025-02": [(3,)]}


# ---- storage


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = storage.upsert(old, new, "k")
    assert rows(once, "k", "v", "n") == rows(storage.upsert(once, new, "k"), "k", "v", "n")
    assert {r.k: (r.v, r.n) for r in once.collect()} == {1: ("a", 1), 2: ("B", None), 3: ("C", None)}


def test_merge_payload(spark):
    t = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, None)], "k int, metadata map<string,string>")
    c = spark.createDataFrame([(1, {"b": "3", "c": "4"}), (2, {"z": "9"})], "k int, metadata map<string,string>")
    assert {r.k: r.metadata for r in storage.merge_payload(t, c, "k").collect()} == {1: {"a": "1", "b": "3", "c": "4"}, 2: {"z": "9"}}


def test_multiget_order(spark):
    t = spark.createDataFrame([(i, str(i)) for i in range(5)], "k int, v string")
    assert [r.k for r in storage.multiget(t, [3, 9, 1, 3], "k").collect()] == [3, 1, 3]
    assert storage.exists(t, "k", 3) and not storage.exists(t, "k", 33)


def test_query_papers_sort_allow_list(spark):
    t = spark.createDataFrame([("a", 1, "pending", "x"), ("b", None, "pending", None), ("c", 5, "failed", "y")], "arxiv_id string, citation_count int, status string, abstract string")
    assert [r.arxiv_id for r in storage.query_papers(t, order_by="; drop").collect()] == ["c", "a", "b"]
    assert [r.arxiv_id for r in storage.query_papers(t, status="pending", require_abstract=True).collect()] == ["a"]


def test_snapshots(spark, tmp_path):
    s = storage.Snapshots(spark, f"file://{tmp_path}")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(KeyError):
        s.read("t")
    s.upsert("t", t, "k")
    s.upsert("t", t.filter("k = 2").withColumn("v", F.lit("z")), "k")
    s.delete("t", t.filter("k = 1"), "k")
    assert rows(s.read("t"), "k", "v") == [(2, "z")] and s.read("t", 1).count() == 2
    s.vacuum("t", 1)
    assert s._versions("t") == [3]


def test_status_histogram(spark):
    t = spark.createDataFrame([("pending",), ("odd",), ("pending",)], "status string")
    assert {r.status: r["count"] for r in storage.status_histogram(t).collect()} == {"pending": 2, "collected": 0, "parsed": 0, "embedded": 0, "failed": 0, "total": 3}


# ---- chunking


CONFIG = chunking.ChunkConfig(max_tokens=10, overlap_tokens=3, min_tokens=2)


def test_paragraph_packer_overlaps():
    c = chunking.Chunker(CONFIG)
    got = list(c.section([("p1", "a b c d e f"), ("p2", "g h i j"), ("p3", "k l m n")], ""))
    assert got == [("a b c d e f\n\ng h i j", ["p1", "p2"]), ("h i j\n\nk l m n", ["p3"])]


def test_large_paragraphs_are_split_by_sentences():
    c = chunking.Chunker(CONFIG)
    got = [t for t, _ in c.section([("p", "one two three four. five six. seven eight nine ten eleven twelve.")], "")]
    assert got == ["one two three four. five six.", "five six. seven eight nine ten eleven twelve."]
    cut = [t for t, _ in c.section([("p", " ".join("w" * 1 for _ in range(30)))], "")]
    assert cut == [" ".join(["w"] * 10)]


def test_short_rest_is_dropped_and_budget_holds():
    import random

    rng = random.Random(1)
    c = chunking.Chunker(chunking.ChunkConfig(max_tokens=20, overlap_tokens=5, min_tokens=4))
    for _ in range(200):
        ps = [(f"p{i}", " ".join(f"w{i}{j}" + rng.choice(["", ".", ""]) for j in range(rng.randint(1, 50)))) for i in range(rng.randint(1, 6))]
        for content, _ in c.section(ps, ""):
            assert c.t.count(content) <= 25  # the overlap comes on top
    assert list(c.section([("p", "a b")], "")) == []


def test_chunk_documents(spark):
    doc = [("d1", "T", "an abstract of five words", [("s1", "Intro", 1, 1, [("p1", "a b c d e f g h i j k l", 1)])], [("says x", "before", None)]), ("d2", None, None, None, None)]
    df = spark.createDataFrame(doc, "paper_id string, title string, abstract string, sections array<struct<section_id:string,title:string,level:int,order:int,paragraphs:array<struct<paragraph_id:string,content:string,order:int>>>>, equations array<struct<text_description:string,context_before:string,context_after:string>>")
    got = chunking.chunk_documents(df, chunking.ChunkConfig(max_tokens=10, overlap_tokens=2, min_tokens=2, min_equation_tokens=2)).orderBy("chunk_index").collect()
    assert [r.chunk_type for r in got] == ["abstract", "text", "equation"] and [r.chunk_index for r in got] == [0, 1, 2]
    assert got[2].content == "Context: before\n\nsays x" and all(r.error is None for r in got)
    assert chunking.chunk_stats(chunking.chunk_documents(df)).first().total_chunks == 0


def test_overlap_marks(spark):
    shared = "one two three four five six seven"
    t = spark.createDataFrame([("p", 0, "start " + shared), ("p", 1, shared + " more"), ("p", 2, "other"), ("q", 3, "other")], "paper_id string, chunk_index int, content string")
    got = {r.chunk_index: (r.has_overlap_before, r.has_overlap_after) for r in chunking.mark_overlaps(t).collect()}
    assert got == {0: (False, True), 1: (True, False), 2: (False, False), 3: (False, False)}


# ---- parsing


TEX = r"""\newcommand{\model}{GreatNet}\newcommand{\pair}[2]{<#1,#2>}
\title{A {Nested} Title}
\begin{document}\begin{abstract}We study \model.\end{abstract}
\section{Introduction} The \model{} model is described here at length, \pair{a}{b}.

Too short.
\subsection{Details} Some more text that is clearly long enough to keep.
\begin{equation}\label{eq:1} x = y \end{equation}
\begin{figure}\includegraphics[w]{f.png}\caption{A plot}\label{fig:a}\end{figure}
\begin{table}\caption{Numbers}\begin{tabular}{ll}a & b \\ 1 & 2 \\ \hline \end{tabular}\end{table}
\section*{References} none of this text should be kept in the chunks at all.
\end{document}"""


def test_latex(spark):
    d = parsing.parse_latex("p", TEX)
    assert d["title"] == "A Nested Title" and d["abstract"] == "We study GreatNet."
    assert [(s["title"], s["level"]) for s in d["sections"]] == [("Introduction", 1), ("Details", 2), ("References", 1)]
    assert d["sections"][0]["paragraphs"][0]["content"].endswith("length, <a,b>.") and len(d["sections"][0]["paragraphs"]) == 1
    assert (d["equations"][0]["latex"], d["equations"][0]["label"]) == ("x = y", "eq:1")
    assert d["figures"][0]["caption"] == "A plot" and d["figures"][0]["image"] == "f.png"
    assert d["tables"][0]["content"] == "| a | b |\n| --- | --- |\n| 1 | 2 |" and d["tables"][0]["row_count"] == 1
    rows_ = spark.createDataFrame([("p", TEX), ("q", None)], "paper_id string, source string")
    parsed = parsing.parse_documents(rows_)
    assert parsing.parse_stats(parsed).first().failed == 1
    assert rows(parsing.section_rows(parsed), "title", "excluded") == [("Details", False), ("Introduction", False), ("References", True)]
    assert parsing.section_stats(parsing.section_rows(parsed)).first().retention_rate == pytest.approx(2 / 3)


def test_archive():
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        for name, text in (("main.tex", r"\documentclass{a}\begin{document}\section{One}\input{part}\input{main}\end{document}"), ("part.tex", "A paragraph that is kept because it is long.")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    d = parsing.parse_archive("p", data.getvalue())
    assert d["sections"][0]["paragraphs"][0]["content"].startswith("A paragraph")
    with pytest.raises(ValueError, match="PDF"):
        parsing.unpack(b"%PDF-1.4")


def test_markdown():
    d = parsing.parse_markdown("p", "# Title\n\n## Abstract\nShort one.\n\n## Intro\nA paragraph that is long enough here.\n\n$$x$$\n\n![cap](i.png)\n\nTable 1: Cap\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n### Sub\nAnother paragraph that is long enough.\n")
    assert d["title"] == "Title" and d["abstract"] == "Short one." and [(s["title"], s["level"]) for s in d["sections"]] == [("Intro", 1), ("Sub", 2)]
    assert d["equations"][0]["latex"] == "x" and d["figures"][0]["caption"] == "cap" and d["tables"][0]["headers"] == ["a", "b"] and d["tables"][0]["row_count"] == 1


def test_braces():
    assert parsing.braced(r"{a{b}\}c}d", 0) == (r"a{b}\}c", 9) and parsing.braced("{open", 0) == (None, 0)
    assert parsing.expand(r"\a \ab", {"a": ("X", 0)}) == r"X \ab" and parsing.expand(r"\f x", {"f": ("#1", 1)}) == r"\f x"


def test_fallback(spark):
    t = spark.createDataFrame([("a", TEX, "# M\n"), ("b", None, "# M\n")], "paper_id string, latex string, markdown string")
    got = parsing.parse_with_fallback(t, parsing.parse_latex, parsing.parse_markdown)
    assert rows(got, "paper_id", "parse_method") == [("a", "latex"), ("b", "marker")]


# ---- answers, benchmark, report


def test_rerank_guard_and_order(spark):
    t = spark.createDataFrame([(0, i, i + 1, 1.0 - i / 10, "x y", text) for i, text in enumerate(["z", "x", "x y", "y", "q", "x y"])] + [(1, 9, 1, 0.5, "x", "x")], "query_id long, chunk_id long, rank int, score double, query string, content string")
    got = rag.rerank(t, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(0, 2), (0, 5), (0, 1), (1, 9)]
    assert got[3].rerank_score is None and got[3].score == 0.5 and got[0].original_score == 0.8


def test_context_stops_at_the_first_that_does_not_fit(spark):
    t = spark.createDataFrame([(0, i + 1, f"p{i}", s, "x" * n) for i, (s, n) in enumerate([("Intro", 40), (None, 80), ("C", 4)])], "query_id long, rank int, paper_id string, section_title string, content string")
    got = rag.context(t, 20).first()
    assert got.n_sources == 1 and got.context == "[1] Paper: p0 | Section: Intro\n" + "x" * 40 + "\n"


def test_history(spark):
    t = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(8)], "conv_id long, turn long, role string, text string")
    assert rag.recent_history(t).first().history.split("\n") == [f"{'User' if i % 2 == 0 else 'Assistant'}: m{i}" for i in range(2, 8)]


def test_difficulty(spark):
    t = spark.createDataFrame([("a b", "natural", "a b", ""), ("x y", "natural", "a", "b"), ("a x y", "natural", "a", ""), ("", "natural", "a", ""), ("x", "keyword", "", None), ("a x y", "conceptual", "a", "")], "q string, s string, t string, a string")
    assert [r.d for r in t.select(benchmark.overlap_difficulty(F.col("q"), F.col("s"), F.col("t"), F.col("a")).alias("d")).collect()] == ["easy", "hard", "medium", "medium", "easy", "hard"]


def test_excerpt(spark):
    t = spark.range(1).select(F.array(F.struct(F.lit("Introduction").alias("title"), F.array(F.struct(F.lit("p").alias("paragraph_id"), F.lit("alpha beta").alias("content"), F.lit(1).alias("order")), F.struct(F.lit("q").alias("paragraph_id"), F.lit("word " * 40).alias("content"), F.lit(2).alias("order"))).alias("paragraphs"))).alias("s"))
    got = t.select(benchmark.section_excerpt(F.col("s"), "intro", 100).alias("e"), benchmark.section_excerpt(F.col("s"), "none").alias("n")).first()
    assert got.e.startswith("alpha beta word") and got.e.endswith("...") and len(got.e) <= 104 and got.n == ""


def test_rerank_gain(spark):
    t = spark.createDataFrame([("a", 0.5, 0.4, 20.0), ("a+rerank", 0.6, 0.5, 120.0), ("b", 0.0, 0.2, 10.0), ("b+rerank", 0.1, 0.3, 9.0)], "mode string, mrr double, ndcg10 double, ms double")
    got = {r.mode: r for r in report.rerank_gain(t).collect()}
    assert got["a"].mrr_percent == pytest.approx(20) and got["a"].efficiency == pytest.approx(1.0) and got["b"].mrr_percent == 0 and got["b"].efficiency == float("inf")
    assert report.best_efficiency(report.rerank_gain(t)).first().mode == "a"
    h = report.headline(t).first()
    assert h.best_mode == "a+rerank" and h.fastest_mode == "b+rerank" and h.runner_up_gap == pytest.approx(0.1)
    assert {r.mode: r.better_ms for r in report.compare(t, "a").collect()}["b"] is True


# ---- plug-ins and plans


def test_tokenizer():
    t = WordTokenizer()
    assert (t.count("a  b\nc"), t.head("a  b c", 2), t.tail("a b  c", 2), t.head("a", 5), t.tail("a b", 0)) == (3, "a  b", "b  c", "a", "")


def test_failing_plugins_keep_rows(spark):
    class Bad(HashEmbedder):
        def embed(self, texts):
            raise RuntimeError("no model")

    class BadExpander(IdentityExpander):
        def expand(self, query):
            raise RuntimeError("no model")

    t = spark.createDataFrame([("a",), (None,)], "query string")
    assert [r.embedding for r in embed_column(t, Bad(4), "query").collect()] == [None, None]
    assert sorted((r.expanded or "") for r in expand_column(t, BadExpander()).collect()) == ["", "a"]


@pytest.fixture(scope="module")
def small_engine(spark):
    chunks = spark.createDataFrame([(f"p{i % 3}_chunk_{i}", f"p{i % 3}", f"transformer attention {'abcdefghijkl'[i] * 4} number", "Intro") for i in range(12)], "chunk_id string, paper_id string, content string, section_title string")
    return engine.Engine.build(chunks)


@pytest.mark.parametrize("mode", engine.MODES)
def test_engine_modes(spark, small_engine, mode):
    q = spark.createDataFrame([(0, "attention hhhh"), (1, "number dddd")], "query_id long, query string")
    got = small_engine.search(q, mode, 4).orderBy("query_id", "rank").collect()
    assert got[0].chunk_id == "p1_chunk_7" and max(r.rank for r in got) <= 4 and got[0].content
    own = small_engine.search(q, mode if mode != "fulltext" else "sparse", 4, paper_id="p0").collect()
    assert {r.paper_id for r in own} == {"p0"}


def test_engine_rerank_and_guards(spark, small_engine):
    q = spark.createDataFrame([(0, "attention hhhh number")], "query_id long, query string")
    assert small_engine.search(q, "hybrid", 3, rerank=True).count() == 3
    for bad in ("openai", "nonsense"):
        with pytest.raises(ValueError, match="mode"):
            small_engine.search(q, bad)
    with pytest.raises(ValueError, match="k must be"):
        small_engine.search(q, "dense", 0)
    assert small_engine.with_preset("keyword").weights == (0.3, 0.5)
    assert small_engine.answer_context(q, 2).first().n_sources == 2


def test_build_corpus(spark):
    src = spark.createDataFrame([("p", TEX), ("q", None)], "paper_id string, source string")
    parsed, chunks, vectors = engine.build_corpus(src, config=chunking.ChunkConfig(min_tokens=3))
    assert rows(parsed, "paper_id", "status") == [("p", "parsed"), ("q", "failed")]
    assert chunks.filter("content LIKE '%none of this text%'").count() == 0 and chunks.count() == vectors.count() > 0


def test_collect_funnel(spark):
    p = spark.createDataFrame([("1", "An LLM study", "text", ["cs.CL"], None), ("2", "Prompting robot", "x", ["cs.AI"], None), ("3", "Safety of maps", "x", ["cs.AI"], None), ("4", "LLM", "x", ["math"], None)], "paper_id string, title string, abstract string, categories array<string>, published_date date")
    labels = spark.createDataFrame([("3", False)], "paper_id string, suitable boolean")
    got = engine.collect(p, spark.createDataFrame([("zebra",)], "keyword string"), labels)
    assert rows(got["kept"], "paper_id") == [("1",)] and rows(got["unsuitable"], "paper_id") == [("3",)]


def test_enrichment_plugins(spark):
    from quarry.plans import enrich

    class Json:
        def generate(self, prompt):
            if "boom" in prompt:
                raise RuntimeError("no reply")
            return '{"keywords": "a,b", "summary": "s", "contribution_type": "method"}'

    t = spark.createDataFrame([("x" * 60,), ("short",), ("boom " * 20,)], "content string")
    got = enrich.enrich_chunks(t, Json()).collect()
    assert [r.enrichment and r.enrichment.keywords for r in got] == [["a", "b"], None, None]
    e = spark.createDataFrame([("p", f"p_eq_{i}", f"x_{i}", None, None) for i in (1, 2)], "paper_id string, equation_id string, latex string, context_before string, context_after string")
    assert rows(enrich.describe_equations(e, enrich.EchoGenerator(), 1), "equation_id", "text_description") == [("p_eq_1", "x_1"), ("p_eq_2", None)]
    p = spark.createDataFrame([("boom",)], "prompt string")
    assert enrich.answer(p, Json(), enrich.EchoGenerator()).first().answer == "boom"
    v = spark.createDataFrame([([1.0],), (None,)], "embedding array<double>")
    assert enrich.embedding_stats(v, 2.0).first().asDict() == {"total": 2, "embedded": 1, "failed": 1, "per_second": 0.5}
    papers = spark.createDataFrame([("boom", "x"), ("t", "DECISION: yes")], "title string, abstract string")
    assert [r.is_relevant for r in enrich.verify_relevance(papers, enrich.EchoGenerator()).collect()] == [False, True]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (r"a & b \\ 1 & 2 \\", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        (r"\hline a & b \\ 1 & 2", "| 1 | 2 |"),
        (r"a \& c & \textbf{x & y} \\ & z", "| a & c | x & y |\n| --- | --- |\n|  | z |"),
        (r" \\ a & b \\ \cline{1-2} c & d \\", "| a | b |"),
        ("", ""),
    ],
)
def test_tabulars(body, want):
    assert parsing.tabular_to_markdown(r"\begin{tabular}{ll}" + body + r"\end{tabular}") == want
    assert parsing.tabular_to_markdown(body) == ""

"""Expressions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import classify, lexicon, scoring, text, vectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").withColumn("y", f(F.col("x"))).orderBy("i").collect()
    return [r.y for r in rows]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")


def test_cosine(spark):
    got = one(spark, same=vectors.cosine(arr(1, 2), arr(2, 4)), zero=vectors.cosine(arr(0, 0), arr(1, 2)), size=vectors.cosine(arr(1), arr(1, 2)), null=vectors.cosine(F.lit(None).cast("array<double>"), arr(1)), empty=vectors.cosine(arr(), arr()))
    assert got["same"] == pytest.approx(1) and got["zero"] == got["size"] == got["null"] == got["empty"] == 0


def test_maxsim_ignores_negative_tokens(spark):
    q = F.array(arr(1, 0), arr(-1, -0.2))
    assert one(spark, s=vectors.maxsim(q, F.array(arr(1, 0), arr(0, 1))))["s"] == pytest.approx(1)


def test_sparse_top(spark):
    m = F.create_map(*[F.lit(x) for x in (1, 0.5, 2, 0.8, 3, 0.3, 4, 0.9)])
    assert [p.token for p in one(spark, t=vectors.sparse_top(m, 3))["t"]] == [4, 2, 1]


def test_shorten_vector(spark):
    assert one(spark, v=vectors.shorten(arr(3, 4, 9), 2))["v"] == pytest.approx([0.6, 0.8])


GOLDEN = [
    ("BERT attention mechanism transformer", "keyword", 0.9, 4, 3, 0),
    ("LLM RLHF fine-tuning GPT", "keyword", 0.9, 4, 4, 0),
    ("RAG retrieval augmented generation", "keyword", 0.9, 4, 4, 0),
    ("How does attention work in transformer models?", "natural", 0.8, 7, 2, 0),
    ("What techniques improve LLM reasoning capabilities?", "natural", 0.7, 6, 1, 0),
    ("Can you explain how BERT handles masked tokens?", "natural", 0.7, 8, 1, 0),
    ("Teaching machines to think step by step using reward signals", "conceptual", 0.9, 10, 0, 3),
    ("Making language models better at following instructions without human examples", "conceptual", 0.9, 10, 0, 2),
    ("Understanding text by learning from large amounts of writing", "conceptual", 0.9, 9, 0, 2),
]


def test_classifier_golden_rows(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "query_id int, query string")
    for r in classify.plan_queries(df).collect():
        _, kind, conf, n, tech, concept = GOLDEN[r.query_id]
        assert (r.query_type, r.word_count, r.technical_term_count, r.conceptual_pattern_count) == (kind, n, tech, concept)
        assert r.confidence == pytest.approx(conf)
        assert (r.dense_top_k, r.sparse_top_k) == lexicon.FETCH_SIZES[kind]


def test_presets():
    assert classify.preset("keyword") == (0.3, 0.5, 0.2)
    with pytest.raises(ValueError, match="unknown preset"):
        classify.preset("none")
    assert (len(lexicon.NEGATIVE), len(lexicon.STRONG), len(lexicon.TECHNICAL), len(lexicon.CONCEPTUAL), len(lexicon.EXCLUDED_SECTIONS)) == (73, 52, 92, 21, 28)


def test_scores(spark):
    d, now = F.lit("2024-11-02").cast("date"), F.lit("2025-01-01").cast("date")
    months = scoring.months_since(d, now)
    got = one(spark, c=scoring.citation_score(F.lit(2), months), r=scoring.recency_score(d, now), none=scoring.recency_score(F.lit(None).cast("date"), now), zero=scoring.citation_score(F.lit(3), F.lit(0.0)), s=scoring.semantic_score(F.lit(1.7)), n=scoring.semantic_score(F.lit(None).cast("double")), b=scoring.topic_bonus(F.lit(0.05)))
    final = 0.4 * min(1, got["c"] / 5) + 0.3 * got["r"] + 0.2 * 0.7 + 0.1 * (got["b"] - 1) * 0.5
    assert final == pytest.approx(0.4179111676)
    assert got["none"] == 0.5 and got["zero"] == pytest.approx(1.3862943611) and got["s"] == 1 and got["n"] == 0.5 and got["b"] == pytest.approx(1.15)


def test_topic_ties_go_to_the_first(spark):
    assert values(spark, scoring.topic, ["a benchmark", "attention and benchmark", "nothing", None, "efficient"]) == ["evaluation", "architecture", "other", "other", "architecture"]


def test_global_rank(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "paper_id long, final_score double").repartition(4)
    got = [(r.final_score, r.paper_id) for r in scoring.with_rank(df).orderBy("rank").collect()]
    assert got == sorted(((float(i % 7), i) for i in range(500)), key=lambda x: (-x[0], x[1]))


CLEANED = [
    (r"A \textbf{bold} and \emph{it} \cite{x}claim.", "A bold and it claim."),
    (r"``quoted'' and `single' --- dash -- range", '"quoted" and \'single\' — dash – range'),
    (r"math $x+1$ and \(y\)", "math x+1 and y"),
    (r"\noindent text \footnote{gone} a~b", "text  a b".replace("  ", " ")),
    (r"\textcolor{red}{seen} \href[opt]{kept}", "seen kept"),
    (None, ""),
]


def test_clean_markup_agrees_with_the_row_form(spark):
    from quarry.operators import parsing

    got = values(spark, text.clean_markup, [x for x, _ in CLEANED])
    assert got == [y for _, y in CLEANED] == [parsing.clean(x) for x, _ in CLEANED]


def test_titles_and_equations(spark):
    assert values(spark, text.clean_section_title, ["2.1 Method:", r"\textbf{Results}."]) == ["Method", "Results"]
    assert values(spark, text.clean_paper_title, ["A % note\n title -- ", ": B"]) == ["A title", "B"]
    assert values(spark, text.clean_equation, [r"\begin{align*} a \label{q} = b \end{align*}"]) == ["a = b"]
    assert values(spark, text.clean_caption, ["Figure 3: A plot", "Fig. 2. Other"]) == ["A plot", "Other"]


def test_predicates(spark):
    long = "one two three four five six seven eight nine ten"
    assert values(spark, text.is_valid_text, [long, "too short", long + "�", "# " * 30, None]) == [True, False, False, False, False]
    assert values(spark, text.is_math_heavy, ["", "   ", "$a$ $b$", "plain words here"]) == [False, True, True, False]
    assert values(spark, text.is_noisy_markup, [r"\a \b c", "a b c", ""]) == [True, False, False]
    assert values(spark, text.is_excluded_section, ["3. References", "APPENDIX", "Referenced work", None]) == [True, True, False, False]
    assert values(spark, text.section_importance, ["2 Method", "odd", None]) == [0.85, 0.7, 0.7]


def test_splitting(spark):
    assert values(spark, text.sentences, ["A b.  C d! E?f", "", None]) == [["A b.", "C d!", "E?f"], [], []]
    got = values(spark, text.paragraphs, ["short\n\nthis one is long enough to stay\n \nand so is this second paragraph"])[0]
    assert [(p.order) for p in got] == [2, 3]


def test_issues(spark):
    got = values(spark, lambda c: F.transform(text.quality_issues(c, F.lit("t")), lambda i: i["issue_type"]), ["ok text", "bad �", "#" * 60, r"\foo \bar baz", None])
    assert got == [[], ["encoding"], ["content_ratio", "special_chars"], ["unconverted_latex"], []]


def test_replies(spark):
    got = values(spark, text.parse_enrichment, ['```json\n{"keywords": "a, b,c,d,e,f", "summary": "s", "contribution_type": "method"}\n```', '{"keywords": ["x"], "contribution_type": "odd"}', "none"])
    assert got[0].keywords == ["a", "b", "c", "d", "e"] and got[0].contribution_type == "method"
    assert got[1].keywords == ["x"] and got[1].contribution_type is None
    assert [q.query for q in values(spark, text.parse_generated_queries, ['[{"query": "good one", "style": "keyword"}, {"query": "x", "style": "keyword"}, {"query": "long enough", "style": "odd"}]'])[0]] == ["good one"]
    r = values(spark, text.parse_relevance, ["DECISION: Yes\nREASON: on topic", "DECISION: no", None])
    assert [x.relevant for x in r] == [True, False, False] and r[0].reason == "on topic"


def test_identifiers(spark):
    assert values(spark, text.normalise_id, ["ArXiv:2501.1v2", "x"]) == ["2501.1v2", "x"]
    assert values(spark, text.strip_version, ["2501.1v2", "2501.1"]) == ["2501.1", "2501.1"]
    assert values(spark, text.safe_name, ["a/b:c"]) == ["a_b_c"]
    assert values(spark, lambda c: text.shorten(c, 3), ["abcd", "abc"]) == ["abc...", "abc"]

"""Query classification by rules, and the fusion presets that follow from it. Pure expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.functions.text import count_patterns, count_terms, strip, words


def features(query: Column, technical: Iterable[str] = L.TECHNICAL) -> dict[str, Column]:
    q = F.lower(strip(F.coalesce(query, F.lit(""))))
    w = words(q)
    n = F.size(w)
    tech = count_terms(q, technical)
    asked = F.exists(F.slice(w, 1, 3), lambda x: x.isin(*L.QUESTION_WORDS))
    return {
        "word_count": n,
        "has_question_word": asked,
        "ends_with_question": q.endswith("?"),
        "technical_term_count": tech,
        "technical_term_ratio": tech / F.greatest(n, F.lit(1)),
        "conceptual_pattern_count": count_patterns(q, L.CONCEPTUAL),
    }


def classify(queries: DataFrame, query: str = "query", technical: Iterable[str] = L.TECHNICAL) -> DataFrame:
    """Adds the features, query_type, confidence and preset. Short technical queries without a question are keyword
    queries; conceptual patterns, or long queries with hardly a technical term, make conceptual ones; the rest is natural."""
    df = queries.withColumns(features(F.col(query), technical))
    wc, tc, cc, r = (F.col(x) for x in ("word_count", "technical_term_count", "conceptual_pattern_count", "technical_term_ratio"))
    q = F.col("has_question_word") | F.col("ends_with_question")
    keyword_conf = F.least(F.lit(0.9), 0.5 + r * 0.5 + F.when(wc <= 5, 0.1).otherwise(0.0))
    rules = [
        ((wc <= 8) & ~q & (tc >= 1), "keyword", keyword_conf),
        (cc >= 1, "conceptual", F.when(tc <= 2, F.least(F.lit(0.9), 0.6 + cc * 0.15)).otherwise(0.55)),
        ((r < 0.1) & (wc >= 10), "conceptual", F.lit(0.7)),
        ((tc <= 1) & (wc >= 10) & ~q, "conceptual", F.lit(0.6)),
        ((tc == 0) & (wc >= 6), "conceptual", F.lit(0.6)),
        (q, "natural", F.when(tc >= 2, 0.8).otherwise(0.7)),
    ]
    kind, conf = F.lit("natural"), F.lit(0.5)
    for when, name, value in reversed(rules):
        kind, conf = F.when(when, F.lit(name)).otherwise(kind), F.when(when, value).otherwise(conf)
    preset = F.create_map(*[F.lit(x) for kv in L.PRESET_OF_TYPE.items() for x in kv])
    return df.withColumn("query_type", kind).withColumn("confidence", conf.cast("double")).withColumn("preset", preset[F.col("query_type")])


def presets(spark: SparkSession) -> DataFrame:
    """Five rows: preset, dense_weight, sparse_weight, colbert_weight."""
    return spark.createDataFrame([(k, *w) for k, w in L.RRF_PRESETS.items()], "preset string, dense_weight double, sparse_weight double, colbert_weight double")


def preset(name: str) -> tuple[float, float, float]:
    if name not in L.RRF_PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(L.RRF_PRESETS)}")
    return L.RRF_PRESETS[name]


def plan_queries(queries: DataFrame, query: str = "query") -> DataFrame:
    """Classified queries with their weights and candidate sizes, as columns."""
    done = classify(queries, query)
    w = F.create_map(*[x for k, v in L.RRF_PRESETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("preset")]
    s = F.create_map(*[x for k, v in L.FETCH_SIZES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("query_type")]
    return done.withColumns({"dense_weight": w[0], "sparse_weight": w[1], "dense_top_k": s[0], "sparse_top_k": s[1]})

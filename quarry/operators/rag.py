"""Reranking, answer context, prompts and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import shorten
from quarry.plans.plugins import LexicalScorer, Scorer, score_column


def rerank(results: DataFrame, k: int = 5, *, scorer: Scorer | None = None, score: Column | None = None, query: str = "query", text: str = "content", per: str = "query_id") -> DataFrame:
    """The k best by the scorer, ties in the order given; original_score keeps the first score. A query with at most k results keeps
    them as they are, unscored (null rerank_score)."""
    scored = results.withColumn("rerank_score", score) if score is not None else score_column(results, scorer or LexicalScorer(), query, text)
    n = F.count(F.lit(1)).over(Window.partitionBy(per))
    marked = scored.withColumn("_n", n).withColumn("original_score", F.col("score")).withColumn("rerank_score", F.when(F.col("_n") > k, F.col("rerank_score")))
    order = Window.partitionBy(per).orderBy(F.desc_nulls_last("rerank_score"), "rank")
    ranked = marked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.coalesce("rerank_score", "score")).drop("_n")


def with_titles(results: DataFrame, papers: DataFrame, default: Column | None = None) -> DataFrame:
    """Adds the paper's title; without one its id, or the default given."""
    t = papers.select("paper_id", F.col("title").alias("_t")).dropDuplicates(["paper_id"])
    return results.join(t, "paper_id", "left").withColumn("title", F.coalesce("_t", F.col("paper_id").cast("string") if default is None else default)).drop("_t")


def context(results: DataFrame, most_tokens: int = 4000, per: str = "query_id") -> DataFrame:
    """(query_id, n_sources, context): numbered sources in rank order until the first that would exceed the budget (a token is four
    characters, rounded down for each source)."""
    w = Window.partitionBy(per).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    size = F.floor(F.length(F.coalesce("content", F.lit(""))) / 4)
    kept = results.withColumn("_sum", F.sum(size).over(w)).withColumn("_i", F.row_number().over(Window.partitionBy(per).orderBy("rank"))).filter(F.col("_sum") <= most_tokens)
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" | Section: "), F.col("section_title"))).otherwise(F.lit(""))
    paper = F.coalesce(F.col("paper_id").cast("string"), F.lit("unknown"))
    part = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] Paper: "), paper, section, F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    gathered = kept.groupBy(per).agg(F.array_sort(F.collect_list(F.struct("_i", part.alias("p")))).alias("_p"))  # at most the budget's characters
    return gathered.select(per, F.size("_p").alias("n_sources"), F.array_join(F.transform("_p", lambda x: x["p"]), "\n---\n").alias("context"))


def recent_history(turns: DataFrame, n: int = 6, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, history): the last n turns in order, one line each; the role `user` is User, any other Assistant."""
    last = turns.withColumn("_r", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).filter(F.col("_r") <= n)
    line = F.concat(F.when(F.col(role) == "user", "User").otherwise("Assistant"), F.lit(": "), F.coalesce(text, F.lit("")))
    return last.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def prompt(query: Column, context_: Column, history: Column, system: str) -> Column:
    """System text, context, history if there is any, question."""
    talk = F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("\n\nPrevious conversation:\n"), history, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(system), F.lit("\n\nContext:\n"), F.coalesce(context_, F.lit("")), talk, F.lit("\n\nQuestion: "), query)


def sources(results: DataFrame) -> DataFrame:
    """Sources for display: 500 characters of content, similarity to three decimals."""
    return results.withColumns({"excerpt": F.substring("content", 1, 500), "similarity": F.round("score", 3), "preview": shorten(F.col("content"), 500)})

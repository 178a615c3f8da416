"""Synthetic retrieval benchmarks: difficulty, hard negatives, statistics, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import words
from quarry.functions.vectors import cosine
from quarry.operators.retrieval import neighbour_groups

STYLES = ("keyword", "natural_short", "natural_long", "conceptual")


def overlap_difficulty(query: Column, style: Column, title: Column, abstract: Column) -> Column:
    """easy, medium or hard by the share of the query's distinct words among those of the title and the first 100 of the abstract."""
    q = F.array_distinct(words(F.lower(query)))
    paper = F.array_union(words(F.lower(F.coalesce(title, F.lit("")))), F.slice(words(F.lower(F.coalesce(abstract, F.lit("")))), 1, 100))
    share = F.size(F.array_intersect(q, paper)) / F.greatest(F.size(q), F.lit(1))
    return F.when(F.size(q) == 0, "medium").when((style == "keyword") | (share > 0.5), "easy").when((style == "conceptual") | (share < 0.2), "hard").otherwise("medium")


def vector_difficulty(query: Column, abstract: Column, fallback: Column) -> Column:
    """By cosine: above 0.7 easy, above 0.4 medium, else hard; the fallback without both vectors."""
    s = cosine(query, abstract)
    return F.when(query.isNull() | abstract.isNull(), fallback).when(s > 0.7, "easy").when(s > 0.4, "medium").otherwise("hard")


def section_excerpt(sections: Column, name: str, most: int = 500) -> Column:
    """The first section whose title holds `name`: paragraphs joined while they fit; the one that doesn't is cut at a word if more than 50
    characters are left for it."""
    chosen = F.try_element_at(F.filter(sections, lambda s: F.contains(F.lower(s["title"]), F.lit(name.lower()))), F.lit(1))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(acc: Column, p: Column) -> Column:
        text = F.trim(p["content"])
        room = F.lit(most) - F.length(acc["text"])
        cut = F.concat(F.regexp_replace(F.left(text, room), r"\s+\S*$", ""), F.lit("..."))
        joined = F.trim(F.concat(acc["text"], F.lit(" "), text))
        fits = F.length(joined) <= most
        return F.when(acc["full"], acc).when(fits, F.struct(joined.alias("text"), F.lit(False).alias("full"))).otherwise(F.struct(F.when(room > 50, F.trim(F.concat(acc["text"], F.lit(" "), cut))).otherwise(acc["text"]).alias("text"), F.lit(True).alias("full")))

    return F.when(chosen.isNotNull(), F.aggregate(F.coalesce(chosen["paragraphs"], F.array().cast("array<struct<paragraph_id:string,content:string,order:int>>")), start, add, lambda a: a["text"])).otherwise(F.lit(""))


def paper_context(title: Column, abstract: Column, intro: Column, conclusion: Column) -> Column:
    def part(name: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))

    return F.concat_ws("\n\n", part("Title", title), part("Abstract", abstract), part("Introduction", intro), part("Conclusion", conclusion))


def assemble(generated: DataFrame, negatives: DataFrame, papers: DataFrame) -> DataFrame:
    """Benchmark rows of generated queries (query_id, query, style, paper_id): relevant papers, hard negatives, difficulty, category, words."""
    rows = generated.join(papers.select("paper_id", "title", "abstract", "category"), "paper_id").join(negatives.withColumnRenamed("groups", "hard_negatives"), "query_id", "left")
    return rows.select(
        "query_id", "query", "style", F.array(F.col("paper_id")).alias("relevant_papers"), F.coalesce("hard_negatives", F.array()).alias("hard_negatives"), "category",
        overlap_difficulty(F.col("query"), F.col("style"), F.col("title"), F.col("abstract")).alias("difficulty"), F.size(words(F.col("query"))).alias("word_count"),
    )


def hard_negatives(ranked: DataFrame, own: DataFrame, k: int = 5) -> DataFrame:
    """Of each query's top 5k, the first k other papers."""
    return neighbour_groups(ranked.filter(F.col("rank") <= 5 * k), own, k)


def similar_papers(ranked: DataFrame, own: DataFrame, k: int = 3, threshold: float = 0.85, depth: int = 30) -> DataFrame:
    """Of each query's top 30, the first k other papers at or above the threshold."""
    return neighbour_groups(ranked.filter(F.col("rank") <= depth), own, k, threshold=threshold)


def benchmark_stats(rows: DataFrame) -> DataFrame:
    """Long table (field, value, count) of styles, difficulties and categories, with totals and the mean word count of queries that have words."""
    parts = [rows.groupBy(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("amount")) for f in ("style", "difficulty", "category")]
    totals = rows.agg(F.count(F.lit(1)).cast("double").alias("queries"), F.count_if(F.size("hard_negatives") > 0).cast("double").alias("with_hard_negatives"), F.avg(F.when(F.col("word_count") > 0, F.col("word_count"))).alias("avg_word_count"))
    parts.append(totals.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, totals.columns)), F.array(*[F.col(c) for c in totals.columns]))).alias("value", "amount")).select(F.lit("total").alias("field"), "value", "amount"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_benchmark(rows: DataFrame, least_style: float = 0.2, least_negatives: float = 0.5) -> DataFrame:
    """(check, passed): each style's share, coverage of hard negatives, required fields."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    checks = {f"style_{s}": F.count_if(F.col("style") == s) / n >= least_style for s in STYLES}
    checks["hard_negatives"] = F.count_if(F.size("hard_negatives") > 0) / n >= least_negatives
    checks["required_fields"] = F.count_if(F.col("query").isNull() | F.col("style").isNull() | (F.coalesce(F.size("relevant_papers"), F.lit(0)) == 0)) == 0
    one = rows.agg(*[c.alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*[F.col(c) for c in checks]))).alias("check", "passed"))

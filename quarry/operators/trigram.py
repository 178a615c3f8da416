"""Similarity join of short texts by their character trigrams, without comparing all pairs.

A text's trigrams are put in the order of their frequency, rarest first. Texts of a Jaccard similarity t or more share one of the first n - ceil(t n) + 1 of each
(n: trigrams of a text), and neither has fewer than t times the other's: so only those prefixes are dealt, by trigram, and candidates are verified on
their whole sets, as retrieval.trigram_similarity has it. Frequent trigrams stand in a prefix only where a text has nothing rarer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """The different trigrams of a lower-cased text; none for a null or a shorter one."""
    low = F.lower(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _grams(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).alias("key"), trigrams(F.col(text)).alias("grams")).filter("size(grams) > 0")


def prefixes(rows: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """key, n and gram of the first grams of each row (key, grams), in the order of frequency (gram, n_rows), then of the grams."""
    each = rows.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(frequency, "gram")
    place = F.row_number().over(Window.partitionBy("key").orderBy("n_rows", "gram"))  # a row's own grams
    # The slack makes a prefix longer where a product isn't exact, never shorter.
    return each.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("key", "n", "gram")


def trigram_join(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.5, *, key: str = "key", text: str = "text") -> DataFrame:
    """left_key, right_key and similarity of all pairs whose trigram similarity reaches the threshold, which must be above 0 and at most 1. Without `right` the pairs are those within
    left, the smaller key first. Keys must be unique and not null. Null texts and those of fewer than three characters are in no pair."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    a = _grams(left, key, text)
    b = a if right is None else _grams(right, key, text)
    both = a.select("grams") if right is None else a.select("grams").unionByName(b.select("grams"))
    frequency = both.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_rows"))
    x = prefixes(a, frequency, threshold).select(F.col("key").alias("left_key"), F.col("n").alias("left_n"), "gram")
    y = prefixes(b, frequency, threshold).select(F.col("key").alias("right_key"), F.col("n").alias("right_n"), "gram")
    met = x.join(y, "gram").filter(F.least("left_n", "right_n") >= F.lit(threshold) * F.greatest("left_n", "right_n") - 1e-9)
    met = met.filter("left_key < right_key") if right is None else met
    pairs = met.select("left_key", "right_key").distinct()
    sets = lambda t, side: t.select(F.col("key").alias(f"{side}_key"), F.col("grams").alias(f"{side}_grams"))
    full = pairs.join(sets(a, "left"), "left_key").join(sets(b, "right"), "right_key")
    common = full.withColumn("common", F.size(F.array_intersect("left_grams", "right_grams")))
    scored = common.select("left_key", "right_key", (F.col("common") / (F.size("left_grams") + F.size("right_grams") - F.col("common"))).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)

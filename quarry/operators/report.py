"""Reports over evaluation results: what reranking adds, efficiency, comparisons, heat values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUFFIX = "+rerank"


def is_reranked(mode: str = "mode"):
    return F.endswith(mode, F.lit(SUFFIX))


def rerank_gain(results: DataFrame) -> DataFrame:
    """Each base mode with its reranked one: percent change (0 from a base of 0) of mrr and ndcg10, added latency, and efficiency (gain of ndcg10 per
    second; infinite without added latency)."""
    base = results.filter(~is_reranked()).select("mode", *[F.col(c).alias(f"base_{c}") for c in ("mrr", "ndcg10", "ms")])
    top = results.filter(is_reranked()).select(F.replace("mode", F.lit(SUFFIX), F.lit("")).alias("mode"), "mrr", "ndcg10", "ms")
    both = base.join(top, "mode")

    def percent(c: str):
        return F.when(F.col(f"base_{c}") != 0, (F.col(c) - F.col(f"base_{c}")) / F.col(f"base_{c}") * 100.0).otherwise(0.0)

    added = F.col("ms") - F.col("base_ms")
    return both.select("mode", percent("mrr").alias("mrr_percent"), percent("ndcg10").alias("ndcg10_percent"), added.alias("added_ms"), F.when(added > 0, (F.col("ndcg10") - F.col("base_ndcg10")) / added * 1000.0).otherwise(F.lit(float("inf"))).alias("efficiency"))


def headline(results: DataFrame) -> DataFrame:
    """One row: best and fastest mode, the runner-up's gap, the speed ratio of the two, modes under 300 ms."""
    agg = results.agg(
        F.max_by("mode", F.struct("mrr", "mode")).alias("best_mode"), F.max("mrr").alias("best_mrr"), F.min_by("mode", F.struct("ms", "mode")).alias("fastest_mode"), F.min("ms").alias("fastest_ms"),
        F.max_by("ms", F.struct("mrr", "mode")).alias("best_ms"), F.array_sort(F.collect_list(F.when(F.col("ms") < 300, F.col("mode")))).alias("production_candidates"),
        F.sort_array(F.collect_list("mrr"), asc=False).alias("_all"),
    )
    return agg.select("best_mode", "best_mrr", "fastest_mode", "fastest_ms", (F.col("best_mrr") - F.coalesce(F.try_element_at("_all", F.lit(2)), F.col("best_mrr"))).alias("runner_up_gap"), (F.col("best_ms") / F.col("fastest_ms")).alias("speed_ratio"), "production_candidates")


def best_efficiency(gains: DataFrame) -> DataFrame:
    """The mode with the greatest finite efficiency, and the mean gain."""
    finite = F.when(F.col("efficiency") != float("inf"), F.struct("efficiency", "mode"))
    return gains.agg(F.max(finite).alias("b"), F.avg("mrr_percent").alias("avg_mrr_percent")).select(F.col("b.mode").alias("mode"), F.col("b.efficiency").alias("efficiency"), "avg_mrr_percent")


def heat(by_style: DataFrame, by_difficulty: DataFrame, overall: DataFrame) -> DataFrame:
    """Style by difficulty: product of both means over the overall mean, within 0 and 1. A handful of rows on each side, joined by mode."""
    s = by_style.select("mode", "style", F.col("avg_mrr").alias("_s"))
    d = by_difficulty.select("mode", "difficulty", F.col("avg_mrr").alias("_d"))
    o = overall.select("mode", F.col("avg_mrr").alias("_o"))
    value = F.when(F.col("_o") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_s") * F.col("_d") / F.col("_o")))).otherwise(0.0)
    return s.join(d, "mode").join(o, "mode").select("mode", "style", "difficulty", value.alias("heat"))


def style_difficulty_cube(metrics: DataFrame) -> DataFrame:
    """Measured means for every combination of style and difficulty, and their totals."""
    return metrics.cube("style", "difficulty").agg(F.avg("mrr").alias("avg_mrr"), F.count(F.lit(1)).alias("count"))


def compare(results: DataFrame, base: str) -> DataFrame:
    """Differences of each mode to a base mode; better says whether each is an improvement (lower is better for ms)."""
    b = results.filter(F.col("mode") == base).select(*[F.col(c).alias(f"_{c}") for c in ("mrr", "ndcg10", "ms")])
    both = results.join(F.broadcast(b), F.lit(True))
    return both.select("mode", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in ("mrr", "ndcg10", "ms")], (F.col("mrr") > F.col("_mrr")).alias("better_mrr"), (F.col("ms") < F.col("_ms")).alias("better_ms"))


def gaps(results: DataFrame) -> DataFrame:
    """Modes by mrr with the distance to the next one. A row for each mode."""
    w = Window.orderBy(F.desc("mrr"), "mode")
    return results.withColumn("place", F.row_number().over(w)).withColumn("gap", F.col("mrr") - F.lead("mrr").over(w))


def run_summary(phases: DataFrame) -> DataFrame:
    return phases.agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.when(F.col("success"), F.col("mode")))).alias("successful"), F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("mode")))).alias("failed"), F.sum("seconds").alias("seconds"))

"""Ranking metrics per query, in two families, and their aggregates.

Chunk family: a result is relevant if its paper or its chunk is listed; the ideal order of NDCG is that of the relevances
retrieved; precision divides by k, or by the number of results if that is below k. Paper family: results are cut to the
best chunk of each paper first; the ideal order has all relevant papers; precision always divides by k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.operators.retrieval import best_per_group, rrf


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def _ideal(n: Column) -> Column:
    """Sum of the first n gains."""
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, j: s + 1.0 / F.log2(j + 1.0))


def judge(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Adds rel (0 or 1) to results (query_id, rank, chunk_id, paper_id) from qrels (query_id, relevant_papers, relevant_chunks).
    Every query of qrels stays, without results as one row of null rank."""
    rows = qrels.select("query_id", "relevant_papers", "relevant_chunks").join(results, "query_id", "left")
    hit = F.coalesce(F.array_contains("relevant_papers", F.col("paper_id")), F.lit(False)) | F.coalesce(F.array_contains("relevant_chunks", F.col("chunk_id")), F.lit(False))
    return rows.withColumn("rel", hit.cast("int"))


def chunk_metrics(results: DataFrame, qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """mrr, ndcg5, ndcg10, p5, p10, recall10, hit10, num_results for each query (and mode, if among `by`)."""
    j = judge(results, qrels)
    n = F.count("rank")

    def dcg(k: int) -> Column:
        return F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), _gain(F.col("rank"))).otherwise(0.0))

    def hits(k: int) -> Column:
        return F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))

    agg = j.groupBy("query_id", *by).agg(
        F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        dcg(5).alias("_dcg5"), dcg(10).alias("_dcg10"), hits(5).alias("_h5"), hits(10).alias("_h10"),
        F.sum("rel").alias("_rel"), n.alias("num_results"),
        F.first(F.coalesce(F.size("relevant_papers"), F.lit(0)) + F.coalesce(F.size("relevant_chunks"), F.lit(0))).alias("_known"),
    )

    def ndcg(k: int) -> Column:
        ideal = _ideal(F.least(F.col("_rel"), F.lit(k).cast("long")))
        return F.when(ideal > 0, F.col(f"_dcg{k}") / ideal).otherwise(0.0)

    def precision(k: int) -> Column:
        return F.col(f"_h{k}") / F.when(F.col("num_results") >= k, F.lit(k)).otherwise(F.greatest(F.col("num_results"), F.lit(1)))

    return agg.select(
        "query_id", *by, "mrr", ndcg(5).alias("ndcg5"), ndcg(10).alias("ndcg10"), precision(5).alias("p5"), precision(10).alias("p10"),
        F.when(F.col("_known") > 0, F.col("_h10") / F.col("_known")).otherwise(0.0).alias("recall10"),
        (F.col("mrr") > 0).alias("hit10"), "num_results",
    )


def paper_metrics(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """mrr, ndcg, p5, hit for each query, at paper level."""
    best = best_per_group(results.select("query_id", "chunk_id", "paper_id", "rank"))
    none = F.array().cast(f"array<{dict(results.dtypes)['chunk_id']}>")
    j = judge(best, qrels.withColumn("relevant_chunks", none)).withColumn("rel", F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    agg = j.groupBy("query_id").agg(
        F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(F.col("rel") == 1, _gain(F.col("rank"))).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)).alias("_h5"),
        F.first(F.coalesce(F.size("relevant_papers"), F.lit(0))).alias("_known"),
    )
    ideal = _ideal(F.least(F.col("_known").cast("long"), F.lit(k).cast("long")))
    return agg.select("query_id", "mrr", F.when(ideal > 0, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg"), (F.col("_h5") / 5.0).alias("p5"), (F.col("mrr") > 0).alias("hit"))


def aggregate(metrics: DataFrame) -> DataFrame:
    """Means of chunk metrics overall, by style and by difficulty, in one pass (grouping sets). Columns: mode, style, difficulty (null
    where summed over), level, averages, count. Blank styles and difficulties are `unknown`."""
    rows = metrics.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) for c in ("style", "difficulty")})
    sets = rows.groupingSets([["mode"], ["mode", "style"], ["mode", "difficulty"]], "mode", "style", "difficulty")
    means = [F.avg(c).alias(f"avg_{c}") for c in ("mrr", "ndcg5", "ndcg10", "p5", "p10")]
    out = sets.agg(*means, F.avg(F.col("hit10").cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "style").otherwise("difficulty")
    return out.withColumn("level", level).drop("_g")


def built_in_queries(spark: SparkSession) -> DataFrame:
    """query_id, query, relevant_papers, category of the built-in evaluation set."""
    rows = [(i, q, list(papers), category) for i, (q, papers, category) in enumerate(L.EVALUATION)]
    return spark.createDataFrame(rows, "query_id long, query string, relevant_papers array<string>, category string")


def filter_unavailable(queries: DataFrame, available: DataFrame, paper: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): a query stays if any of its relevant papers is available; its lists lose the others, with order and repeats kept.
    Dropped queries get missing_papers. Membership is an equi join on exploded lists, so neither side is collected."""
    have = available.select(F.col(paper).alias("p")).distinct().withColumn("ok", F.lit(True))

    def pruned(column: str) -> DataFrame:
        long = queries.select("query_id", F.posexplode(column).alias("i", "p")).join(have, "p", "left")
        return long.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("i", "p")))), lambda x: x["p"]).alias(f"_{column}"))

    both = queries.join(pruned("relevant_papers"), "query_id", "left").join(pruned("hard_negatives"), "query_id", "left")
    empty = F.array().cast("array<string>")
    relevant = F.coalesce(F.col("_relevant_papers"), empty)
    kept = both.filter(F.size(relevant) > 0).withColumn("relevant_papers", relevant).withColumn("hard_negatives", F.coalesce("_hard_negatives", empty))
    dropped = both.filter(F.size(relevant) == 0).withColumn("missing_papers", F.coalesce("relevant_papers", empty))
    return kept.drop("_relevant_papers", "_hard_negatives"), dropped.drop("_relevant_papers", "_hard_negatives")


def weight_grid(step: float = 0.1) -> list[tuple[float, float, float]]:
    """Weight triples on a grid whose sum is within 0.9 and 1.1, normalised, without repeats, ascending."""
    n = round(1 / step)
    found = set()
    for a in range(n + 1):
        for b in range(n + 1):
            for c in range(n + 1):
                s = (a + b + c) * step
                if 0.9 - 1e-9 <= s <= 1.1 + 1e-9 and a + b + c:
                    found.add(tuple(round(x / (a + b + c), 4) for x in (a, b, c)))
    return sorted(found)


def grid_search(dense: DataFrame, sparse: DataFrame, qrels: DataFrame, grid: list[tuple[float, float, float]] | None = None, k: int = 10) -> DataFrame:
    """Mean reciprocal rank of rank fusion for each pair of weights, best first: one job, the weights are a small table crossed with the
    queries' candidate lists. results of dense and sparse need paper_id."""
    spark = dense.sparkSession
    pairs = sorted({(a, b) for a, b, _ in (grid or weight_grid())})
    weights = F.broadcast(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "w long, dense_weight double, sparse_weight double"))

    def spread(r: DataFrame) -> DataFrame:
        return r.select("query_id", "chunk_id", "rank", "score").join(weights.select("w"), F.lit(True)).withColumn("query_id", F.struct("w", "query_id"))

    keyed = qrels.select("query_id").distinct().join(weights, F.lit(True)).select(F.struct("w", "query_id").alias("query_id"), "dense_weight", "sparse_weight")
    fused = rrf(spread(dense), spread(sparse), k, weights=keyed)
    paper = dense.select("chunk_id", "paper_id").unionByName(sparse.select("chunk_id", "paper_id")).distinct()
    hits = fused.select("query_id.*", "chunk_id", "rank").join(paper, "chunk_id").join(qrels.select("query_id", F.explode("relevant_papers").alias("paper_id")).distinct(), ["query_id", "paper_id"])
    first = hits.groupBy("w", "query_id").agg((1.0 / F.min("rank")).alias("rr")).groupBy("w").agg(F.sum("rr").alias("s"))
    n = qrels.select("query_id").distinct().count()
    return weights.join(first, "w", "left").select("dense_weight", "sparse_weight", (F.coalesce("s", F.lit(0.0)) / max(n, 1)).alias("mrr")).orderBy(F.desc("mrr"), "dense_weight", "sparse_weight")


def ordered_modes(rows: DataFrame, order: list[str], mode: str = "mode") -> DataFrame:
    """Rows in a fixed order of modes; unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(mode))
    return rows.orderBy(F.when(at > 0, at).otherwise(len(order) + 1), mode)

"""Scores of papers: citations, recency, similarity, topics and their bonus, and the final score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.functions.text import count_terms
from quarry.session import cut_lineage


def months_since(date: Column, today: Column) -> Column:
    return F.datediff(today, date) / F.lit(30.0)


def citation_score(citations: Column, months: Column) -> Column:
    """log(1 + citations per month); an age of no months counts as one."""
    return F.log1p(F.coalesce(citations, F.lit(0)) / F.when(months <= 0, F.lit(1.0)).otherwise(months))


def recency_score(date: Column, today: Column) -> Column:
    """Exponential decay; 0.5 without a date; above 1 for a date to come."""
    return F.coalesce(F.exp(-months_since(date, today) / L.RECENCY_MONTHS), F.lit(0.5))


def semantic_score(similarity: Column) -> Column:
    return F.when(similarity.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)))


def topic(text: Column, topics: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The topic with the most terms in the lower-cased text, the first of equals; `other` without any."""
    topics = topics or L.TOPICS
    t = F.lower(F.coalesce(text, F.lit("")))
    ranked = [F.struct(count_terms(t, terms).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(topics.items())]
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("o"), F.lit(L.OTHER_TOPIC).alias("name"))  # before all topics without a term
    return F.array_max(F.array(none, *ranked))["name"]


def topic_bonus(share: Column, n_topics: int = 8) -> Column:
    """1 plus twice what the topic's share lacks to an even one; never below 1."""
    even = 1.0 / n_topics
    return F.when(share < even, 1.0 + 2.0 * (even - share)).otherwise(F.lit(1.0))


def score_papers(papers: DataFrame, today: Column, *, text: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds topic, the four components and final_score to the columns `keep` (all by default). Columns used: title, abstract,
    published_date, citation_count, semantic_similarity. Topics are found once, in a checkpoint: name in `keep` what is needed,
    so that no text is written. Their shares are one row for each topic, which joins back, so the table itself isn't dealt by topic."""
    text = F.concat_ws(" ", "title", "abstract") if text is None else text
    used = ["published_date", "citation_count", "semantic_similarity"]
    kept = papers.columns if keep is None else keep
    base = cut_lineage(papers.select(topic(text).alias("topic"), *dict.fromkeys([*kept, *used])))
    counts = base.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))
    total = Window.partitionBy()
    shares = counts.withColumn("_share", F.col("_n") / F.sum("_n").over(total)).drop("_n")  # a row for each topic
    months = F.when(F.col("published_date").isNull(), F.lit(12.0)).otherwise(months_since(F.col("published_date"), today))
    parts = {
        "citation": F.least(F.lit(1.0), citation_score(F.col("citation_count"), months) / 5.0),
        "recency": recency_score(F.col("published_date"), today),
        "semantic": semantic_score(F.col("semantic_similarity")),
        "stratified": (topic_bonus(F.col("_share")) - 1.0) * 0.5,
    }
    scored = base.join(F.broadcast(shares), "topic").withColumns({f"{k}_score": v for k, v in parts.items()})
    final = reduce(lambda a, b: a + b, [F.col(f"{k}_score") * w for k, w in L.SCORE_WEIGHTS.items()])
    return scored.withColumn("final_score", final).drop("_share", *[c for c in used if c not in kept])


def with_rank(scored: DataFrame, score: str = "final_score", key: str = "paper_id", name: str = "rank") -> DataFrame:
    """Rank from 1 by score descending, then key. The rank over all rows comes from a range exchange and
    per-partition counts, not from one window over the table."""
    return global_row_number(scored, [F.desc_nulls_last(score), F.asc(key)], name)


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 in the given order. Rows are range partitioned and sorted once; the bounds come from a sample, and a second exchange would
    draw another one, so number_rows() keeps them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return number_rows(df.repartitionByRange(n, *order).sortWithinPartitions(*order), name)


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Row numbers from 1 in the order that df has. Rows are written once with their place: within its partition that is part of
    a row's monotonic id; the counts of the partitions before are added (a row for each partition)."""
    placed = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # as monotonically_increasing_id is documented
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_b") + within + 1).drop("_p", "_at", "_b")

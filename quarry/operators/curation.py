"""Curation of a corpus: keyword rules, learned keywords, labels, windows of dates, stratified selection, diversity."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.functions.text import contains_any, strip, strip_version, words
from quarry.operators.terms import with_matches


def paper_text(title: str = "title", abstract: str = "abstract") -> Column:
    return F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(abstract), F.lit(""))))


def rule_label(text: Column, negative=L.NEGATIVE, strong=L.STRONG, word_boundary: bool = False) -> Column:
    """`drop` for any negative term, else `clear` for any strong one, else `edge`; substrings of the lower-cased text."""
    return F.when(contains_any(text, negative, word_boundary), "drop").when(contains_any(text, strong, word_boundary), "clear").otherwise("edge")


def build_query(keywords=(), start: datetime.date | None = None, end: datetime.date | None = None, categories=L.CATEGORIES) -> str:
    """The catalogue's query string: categories, keywords in title or abstract, submission dates (an open bound is *)."""
    parts = ["(" + " OR ".join(f"cat:{c}" for c in (categories or ("cs.CL",))) + ")"]
    if keywords:
        parts.append("(" + " OR ".join(f'(ti:"{k}" OR abs:"{k}")' for k in keywords) + ")")
    if start or end:
        lo = start.strftime("%Y%m%d0000") if start else "*"
        hi = end.strftime("%Y%m%d2359") if end else "*"
        parts.append(f"submittedDate:[{lo} TO {hi}]")
    return " AND ".join(parts)


def recall(papers: DataFrame, keywords=L.POSITIVE, start: Column | None = None, end: Column | None = None, categories=L.CATEGORIES) -> DataFrame:
    """Broad recall: a category in common, a keyword in title or abstract, a date within bounds (null dates pass). Line breaks of titles
    and abstracts become spaces."""
    out = papers.filter(F.arrays_overlap("categories", F.array(*map(F.lit, categories))) & contains_any(paper_text(), keywords))
    date = F.col("published_date")
    if start is not None:
        out = out.filter(date.isNull() | (date >= start))
    if end is not None:
        out = out.filter(date.isNull() | (date <= end))
    return out.withColumns({c: strip(F.regexp_replace(c, "\n", " ")) for c in ("title", "abstract")})


def keyword_matches(rows: DataFrame, keywords: DataFrame, text: Column, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(filtered, passed): rows whose lower-cased text holds any of the stored keywords (column keyword) as a substring, with the sorted
    matches, and the others. One automaton for all keywords of a block (terms.with_matches)."""
    found = with_matches(rows, keywords.select(F.lower("keyword")), F.lower(text))
    return found.filter(F.size("matched") > 0), found.filter(F.size("matched") == 0).drop("matched")


def verify_edges(edges: DataFrame, labels: DataFrame, most: int = 500, key: str = "paper_id", on_missing: bool = True) -> DataFrame:
    """The first `most` edge cases (a limit of the operator, by key) joined to relevance labels; a missing label counts as `on_missing`."""
    return edges.orderBy(key).limit(most).join(labels.select(key, "is_relevant"), key, "left").withColumn("is_relevant", F.coalesce("is_relevant", F.lit(on_missing)))


def label_split(rows: DataFrame, labels: DataFrame, key: str = "paper_id", flag: str = "suitable", keep_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(suitable, unsuitable) by an external label; rows without one are kept or dropped."""
    both = rows.join(labels.select(key, F.col(flag).cast("boolean").alias("_f")), key, "left").withColumn("_f", F.coalesce("_f", F.lit(keep_missing)))
    return both.filter("_f").drop("_f"), both.filter("NOT _f").drop("_f")


def learned_keywords(labels: DataFrame, column: str = "keywords", known: DataFrame | None = None) -> DataFrame:
    """Distinct lower-cased keywords of more than two characters that labels propose, without those known."""
    new = labels.select(F.explode(column).alias("k")).select(F.lower(strip(F.col("k"))).alias("keyword")).filter(F.length("keyword") > 2).distinct()
    return new if known is None else new.join(known.select(F.lower("keyword").alias("keyword")), "keyword", "left_anti")


def dedup_first(rows: DataFrame, key: str = "paper_id", seq: str = "seq") -> DataFrame:
    """The first row of each key in input order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(seq))).filter("_r = 1").drop("_r")


def with_citations(papers: DataFrame, citations: DataFrame, key: str = "paper_id") -> DataFrame:
    """citation_count by id without its version; papers without an entry get 0."""
    c = citations.select(strip_version(F.col(key)).alias("_k"), F.col("citation_count").alias("_c")).dropDuplicates(["_k"])
    return papers.withColumn("_k", strip_version(F.col(key))).join(c, "_k", "left").withColumn("citation_count", F.coalesce("_c", F.lit(0))).drop("_k", "_c")


def merge_citations(papers: DataFrame, counts: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """Papers with the counts that are known and differ put in, and one row that counts those updates."""
    both = papers.join(counts.select(key, F.col("citation_count").alias("_c")), key, "left")
    changed = F.col("_c").isNotNull() & ~F.col("_c").eqNullSafe(F.col("citation_count"))
    merged = both.withColumn("citation_count", F.coalesce("_c", "citation_count")).drop("_c")
    return merged, both.agg(F.count_if(changed).alias("updated"))


# ---- dates


def date_windows(spark: SparkSession, start: datetime.date, end: datetime.date, days: int = 14) -> DataFrame:
    """(window_start, window_end), both inclusive, the last one cut at the end."""
    if start > end:
        return spark.createDataFrame([], "window_start date, window_end date")
    one = spark.range(1).select(F.lit(start).cast("date").alias("s"), F.lit(end).cast("date").alias("e"))
    starts = one.select("e", F.explode(F.expr(f"sequence(s, e, interval {int(days)} days)")).alias("window_start"))
    return starts.select("window_start", F.least(F.date_add("window_start", days - 1), F.col("e")).alias("window_end"))


def months(spark: SparkSession, start: datetime.date, end: datetime.date) -> DataFrame:
    """(month, month_start, month_end) of every month touched."""
    one = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{start}','month'), trunc(date'{end}','month'), interval 1 month)")).alias("month_start"))
    return one.select(F.date_format("month_start", "yyyy-MM").alias("month"), "month_start", F.last_day("month_start").alias("month_end"))


def pending_windows(windows: DataFrame, completed: DataFrame) -> DataFrame:
    """Windows that no earlier run has completed."""
    return windows.join(completed.select("window_start"), "window_start", "left_anti")


# ---- selection


def quotas(n: int, shares: dict[str, float] | None = None) -> dict[str, int]:
    """Rows per topic: whole parts of the shares; `other` gets the rest."""
    shares = shares or L.TARGET_SHARES
    total = sum(shares.values())
    out = {t: int(n * s / total + 1e-9) for t, s in shares.items()}
    return out | {L.OTHER_TOPIC: n - sum(out.values())}


def stratified_sample(scored: DataFrame, n: int, shares: dict[str, float] | None = None, *, score: str = "final_score", topic: str = "topic", key: str = "paper_id") -> DataFrame:
    """The best rows of each topic up to its quota, filled to n from the best of all others; final_rank by score."""
    quota = quotas(n, shares)
    order = [F.desc_nulls_last(score), F.asc(key)]
    table = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    # Only the best n of a topic can be chosen, so the group limit keeps each topic's candidates to n.
    best = scored.withColumn("_t", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).filter(F.col("_t") <= n)
    marked = best.withColumn("in_quota", F.col("_t") <= F.coalesce(F.try_element_at(table, F.col(topic)), F.lit(0)))
    chosen = marked.orderBy(F.desc("in_quota"), *order).limit(n)
    return chosen.withColumn("final_rank", F.row_number().over(Window.orderBy(*order))).drop("_t", "in_quota")  # n rows


def min_guarantee_select(scored: DataFrame, top_k: int, minimum: int, *, score: str = "final_score", topic: str = "topic", key: str = "paper_id") -> DataFrame:
    """The best `minimum` of each topic are guaranteed; the rest competes for what top_k leaves (never below the guaranteed)."""
    order = [F.desc_nulls_last(score), F.asc(key)]
    best = scored.withColumn("_t", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).filter(F.col("_t") <= max(top_k, minimum))
    marked = best.withColumn("guaranteed", F.col("_t") <= minimum)
    # What is left has at most max(top_k, minimum) rows for each topic, so windows over all of it are small.
    room = F.greatest(F.lit(top_k), F.count_if("guaranteed").over(Window.partitionBy()))
    place = F.row_number().over(Window.orderBy(F.desc("guaranteed"), *order))
    chosen = marked.select("*", place.alias("_place"), room.alias("_room")).filter("_place <= _room")
    return chosen.withColumn("final_rank", F.row_number().over(Window.orderBy(*order))).drop("_t", "_place", "_room")


def validate_selection(selected: DataFrame, minimum: int, topic: str = "topic") -> DataFrame:
    """One row: total, with_citations, total_citations, violations (topics below the minimum, sorted)."""
    per = selected.groupBy(topic).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("citation_count") > 0).alias("c"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("s"))
    return per.agg(F.sum("n").alias("total"), F.sum("c").alias("with_citations"), F.sum("s").alias("total_citations"), F.array_sort(F.collect_list(F.when(F.col("n") < minimum, F.col(topic)))).alias("violations"))


def diversity(selected: DataFrame, topic: str = "topic", month: str = "month") -> DataFrame:
    """One row: topic_entropy (bits), temporal_cv (population deviation over mean of monthly counts), n_topics, n_months."""
    t = selected.groupBy(topic).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    m = selected.groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    a = t.agg(F.coalesce(F.sum(-F.col("p") * F.log2("p")), F.lit(0.0)).alias("topic_entropy"), F.count(F.lit(1)).alias("n_topics"))
    b = m.agg(F.coalesce(F.stddev_pop("n") / F.avg("n"), F.lit(0.0)).alias("temporal_cv"), F.count(F.lit(1)).alias("n_months"))
    return a.join(b, F.lit(True))


def diversity_verdict(metrics: DataFrame, least_entropy: float = 3.5, most_cv: float = 0.5) -> DataFrame:
    return metrics.withColumn("passed", (F.col("topic_entropy") >= least_entropy) & (F.col("temporal_cv") <= most_cv))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """count and share of each value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count")).withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def score_summary(rows: DataFrame, score: str = "final_score") -> DataFrame:
    return rows.agg(F.count(score).alias("n"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"))


def citation_summary(papers: DataFrame) -> DataFrame:
    c = F.coalesce("citation_count", F.lit(0))
    return papers.agg(F.count(F.lit(1)).alias("total"), F.count_if(c > 0).alias("with_citations"), F.sum(c).alias("total_citations"), F.max(c).alias("max_citations"))


def funnel(rows: DataFrame, month: str = "month", kept: Column | None = None) -> DataFrame:
    """collected, kept and filtered rows of each month, with running totals over the months."""
    kept = F.col("kept") if kept is None else kept
    per = rows.groupBy(month).agg(F.count(F.lit(1)).alias("collected"), F.count_if(kept).alias("kept"))
    w = Window.orderBy(month).rowsBetween(Window.unboundedPreceding, 0)  # a row for each month
    return per.withColumn("filtered", F.col("collected") - F.col("kept")).withColumn("total_collected", F.sum("collected").over(w)).withColumn("total_kept", F.sum("kept").over(w))


def monthly_keyword_feedback(months_: list[str], papers: DataFrame, labels: DataFrame, keywords: DataFrame, text: Column, key: str = "paper_id"):
    """Month by month: edge cases are filtered by the keywords known so far, labels judge the rest, and the keywords those labels propose
    hold from the next month on. Yields (month, kept, keywords)."""
    for m in months_:
        own = papers.filter(F.col("month") == m)
        _, passed = keyword_matches(own, keywords, text, key)
        kept, _ = label_split(passed, labels, key)
        new = learned_keywords(labels.join(passed.select(key), key, "left_semi"), known=keywords)
        keywords = keywords.select("keyword").unionByName(new)
        yield m, kept, keywords


def word_overlap(a: Column, b: Column) -> Column:
    """Words that two texts share."""
    return F.size(F.array_intersect(F.array_distinct(words(a)), F.array_distinct(words(b))))

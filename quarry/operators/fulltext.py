"""Full-text search with stems and cover-density rank.

A row matches if it has every term of the query. Its rank adds up over its covers: the shortest runs of words that hold all terms and no shorter such run. A
cover of n words counts 1 up to SPAN words, and SPAN / n beyond (Clarke, Cormack and Tudhope, "Relevance ranking for one to three term queries", 1999). Only the queries' terms are
dealt, with their positions; a frequent term's positions go along only for rows that have the query's rarest term too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.stemming import STOP_WORDS, stems
from quarry.operators.retrieval import top_k

SPAN = 16


def plain_terms(words: Column) -> Column:
    return words


def terms(text: Column, stem: Callable[[Column], Column] = stems) -> Column:
    """Array of (position from 1, term) of a text: stems of its lower-cased runs of letters and digits, without stop words, which count as positions."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(F.arrays_zip(words.alias("w"), stem(words).alias("t")), lambda x, i: F.struct((i + 1).alias("pos"), x["w"].alias("w"), x["t"].alias("term")))
    return F.transform(F.filter(placed, lambda x: ~x["w"].isin(*STOP_WORDS)), lambda x: F.struct(x["pos"], x["term"]))


def cover_density(hits: Column, n: Column, span: int = SPAN) -> Column:
    """Of hits (array of (pos, i), ascending; i from 1 to n names the term): the sum over all covers. One fold over the positions that carries the last one of each term."""
    start = F.struct(F.array_repeat(F.lit(0), n).alias("last"), F.lit(0).alias("first"), F.lit(0.0).cast("double").alias("score"))

    def step(acc: Column, hit: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i + 1 == hit["i"], hit["pos"]).otherwise(p))
        first = F.array_min(last)  # 0 until every term has come
        size = (hit["pos"] - first + 1).cast("double")
        gain = F.when(first > acc["first"], F.least(F.lit(1.0), F.lit(float(span)) / size)).otherwise(F.lit(0.0))
        return F.struct(last.alias("last"), F.greatest(acc["first"], first).alias("first"), (acc["score"] + gain).alias("score"))

    return F.aggregate(hits, start, step, lambda acc: acc["score"])


def search(queries: DataFrame, rows: DataFrame, k: int = 20, *, key: str = "chunk_id", text: str = "text", stem: Callable[[Column], Column] = stems, span: int = SPAN) -> DataFrame:
    """query_id, chunk_id, score and rank of the k best rows for each query (query_id, query), ties to the smaller key. A query without a term finds nothing."""
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform(terms(F.col("query"), stem), lambda x: x["term"]))).alias("term"))
    found = rows.select(F.col(key).alias("chunk_id"), F.explode(terms(F.col(text), stem)).alias("x")).select("chunk_id", "x.pos", "x.term")
    wanted = found.join(asked.select("term").distinct(), "term", "left_semi")
    postings = wanted.groupBy("chunk_id", "term").agg(F.collect_list("pos").alias("at"))  # positions of one term in one row
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))
    sized = asked.join(counts, "term", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce("n_rows", F.lit(0))).alias("fewest"), F.min(F.struct(F.coalesce("n_rows", F.lit(0)), "term")).alias("rarest"), F.array_sort(F.collect_list("term")).alias("terms")
    )
    sized = sized.filter("fewest > 0")  # a term that no row has
    rare = sized.select("query_id", F.col("rarest.term").alias("term"), "n", "terms")
    candidates = rare.join(postings.select("chunk_id", "term"), "term").drop("term")  # one row for each query and row with its rarest term
    each = candidates.select("query_id", "chunk_id", "n", F.posexplode("terms").alias("j", "term")).join(postings, ["chunk_id", "term"])
    whole = each.groupBy("query_id", "chunk_id", "n").agg(F.count(F.lit(1)).alias("met"), F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("pos"), (F.col("j") + 1).alias("i"))))).alias("hits"))
    scored = whole.filter("met = n").select("query_id", "chunk_id", cover_density(F.array_sort("hits"), F.col("n").cast("int"), span).alias("score"))
    return top_k(scored, k)

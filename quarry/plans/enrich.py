"""Model-written columns: equation descriptions, chunk enrichment, query generation, answers. Models are plug-ins; a failure is a row's own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import parse_enrichment, parse_generated_queries, parse_relevance, strip

#: Shortest chunk that is enriched, most characters that a model gets.
LEAST_CHARS, MOST_CHARS = 50, 3000


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class EchoGenerator:
    """Gives the prompt's last line back: a deterministic stand-in."""

    def generate(self, prompt: str) -> str:
        return prompt.rstrip().rsplit("\n", 1)[-1]


def generate_column(df: DataFrame, generator: Generator, prompt: Column, out: str, fallback: Generator | None = None) -> DataFrame:
    """Adds a reply for each prompt: the generator's, or the fallback's if that fails, or null. Null prompts get null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            if text is None:
                return None
            for g in (generator, fallback):
                try:
                    if g is not None:
                        return g.generate(text)
                except Exception:
                    continue
            return None

        for p in parts:
            yield p.map(one)

    return df.withColumn(out, run(prompt))


def describe_equations(equations: DataFrame, generator: Generator, most: int | None = None) -> DataFrame:
    """Adds text_description to long equation rows (paper_id, equation_id, latex, contexts). With `most`, only the first of each
    paper are described; the others stay without a description."""
    prompt = F.concat_ws("\n", F.lit("Describe this equation in words."), F.col("context_before"), F.col("context_after"), F.col("latex"))
    if most is not None:
        place = F.regexp_extract("equation_id", r"_(\d+)$", 1).cast("int")
        prompt = F.when(place <= most, prompt)
    return generate_column(equations, generator, prompt, "text_description")


def enrich_chunks(chunks: DataFrame, generator: Generator, text: str = "content") -> DataFrame:
    """Adds enrichment (keywords, summary, contribution_type); chunks under LEAST_CHARS characters get none, longer ones are cut for the model."""
    long = F.length(strip(F.col(text))) >= LEAST_CHARS
    prompt = F.when(long, F.concat(F.lit("Give keywords, a summary and a contribution type as JSON.\n"), F.left(F.col(text), F.lit(MOST_CHARS))))
    return generate_column(chunks, generator, prompt, "_reply").withColumn("enrichment", parse_enrichment(F.col("_reply"))).drop("_reply")


def generate_queries(papers: DataFrame, generator: Generator, context: Column) -> DataFrame:
    """(paper_id, query, style) for each valid query that the generator gives for a paper."""
    asked = generate_column(papers, generator, F.concat(F.lit("Write search queries as a JSON list.\n"), context), "_reply")
    return asked.select("paper_id", F.explode(parse_generated_queries(F.col("_reply"))).alias("q")).select("paper_id", "q.query", "q.style")


def verify_relevance(papers: DataFrame, generator: Generator) -> DataFrame:
    """Adds is_relevant and relevance_reason; a paper whose reply fails counts as relevant."""
    prompt = F.concat_ws("\n", F.lit("Is this paper about language models? Answer with DECISION: and REASON: lines."), F.col("title"), F.col("abstract"))
    done = generate_column(papers, generator, prompt, "_reply").withColumn("_v", parse_relevance(F.col("_reply")))
    return done.withColumns({"is_relevant": F.when(F.col("_reply").isNull(), True).otherwise(F.col("_v.relevant")), "relevance_reason": F.col("_v.reason")}).drop("_reply", "_v")


def answer(prompts: DataFrame, generator: Generator, fallback: Generator | None = None) -> DataFrame:
    return generate_column(prompts, generator, F.col("prompt"), "answer", fallback)


def embedding_stats(vectors: DataFrame, seconds: float | None = None) -> DataFrame:
    """total, embedded, failed, and rows per second if the time is known."""
    out = vectors.agg(F.count(F.lit(1)).alias("total"), F.count("embedding").alias("embedded")).withColumn("failed", F.col("total") - F.col("embedded"))
    return out if seconds is None else out.withColumn("per_second", F.col("embedded") / F.lit(max(seconds, 1e-9)))

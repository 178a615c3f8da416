"""Which of many terms stand in a text: one automaton for all of them, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # terms are then looked for one by one
    ahocorasick = None

#: Most terms that go to the tasks at once; more are matched block by block, in one pass over the rows.
BLOCK = 50_000


def with_matches(rows: DataFrame, terms: DataFrame, text: Column, out: str = "matched", block: int = BLOCK) -> DataFrame:
    """Adds the sorted distinct terms (the one column of `terms`) that stand in the text as substrings; none for a null text. Texts are
    read once for each block of terms, however many terms stand in them. The driver holds one block of terms at a time."""
    found = [F.array().cast("array<string>")]
    spark = rows.sparkSession
    asked = terms.toDF("t").filter("t IS NOT NULL").distinct().toLocalIterator()
    while own := [r[0] for r in islice(asked, block)]:
        found.append(_matcher(spark.sparkContext.broadcast(own))(text))
    return rows.withColumn(out, F.array_sort(F.array_distinct(F.concat(*found))))


def _matcher(sent):
    @F.pandas_udf("array<string>")
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder(sent.value)
        for part in parts:
            yield part.map(lambda t: find(t) if t is not None else [])

    return match


def _finder(terms: list[str]):
    if ahocorasick is None:
        return lambda t: [k for k in terms if k in t]
    empty = [""] if "" in terms else []
    machine = ahocorasick.Automaton()
    for k in terms:
        if k:
            machine.add_word(k, k)
    if not len(machine):
        return lambda t: empty
    machine.make_automaton()
    return lambda t: [*empty, *{k for _, k in machine.iter(t)}]

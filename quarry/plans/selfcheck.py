"""A smoke test of a corpus and its engine: each check is a row, a failure is reported and not raised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.plans.engine import LEGACY, MODES, Engine


def self_check(engine: Engine, papers: DataFrame, question: str = "language model") -> DataFrame:
    """(check, passed, detail): papers can be counted, the index has points, conversions of sparse vectors come back, every mode answers, legacy
    modes are refused."""
    spark = engine.chunks.sparkSession
    asked = spark.createDataFrame([(0, question)], "query_id long, query string")

    def conversions() -> str:
        weights = F.create_map(F.lit("a"), F.lit(1.5), F.lit("b"), F.lit(0.5))
        row = spark.range(1).select(V.sparse_from_json(V.sparse_to_json(weights)).alias("m"), V.sparse_nnz(weights).alias("n")).first()
        assert row["m"] == {"a": 1.5, "b": 0.5} and row["n"] == 2
        return "2 entries"

    def modes() -> str:
        own = [m for m in MODES if engine.postings is not None or m != "sparse"]
        return ", ".join(f"{m}: {engine.search(asked, m, 3).count()}" for m in own)

    def legacy() -> str:
        for mode in LEGACY:
            try:
                engine.search(asked, mode)
            except ValueError:
                continue
            raise AssertionError(mode)
        return f"{len(LEGACY)} refused"

    checks: dict[str, Callable[[], str]] = {
        "papers": lambda: f"{papers.count()} papers",
        "index": lambda: f"{engine.stats().agg(F.sum('points')).first()[0] or 0} points",
        "conversions": conversions,
        "modes": modes,
        "legacy": legacy,
    }
    rows = []
    for name, check in checks.items():
        try:
            rows.append((name, True, check()))
        except Exception as e:
            rows.append((name, False, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")

"""Registered queries of the library's own operators."""

from __future__ import annotations

from quarry.catalog import ORACLES, QUERIES, corpus, hybrid, markup, mechanisms, records, search, storage, streams  # noqa: F401


def flagship(spark, sf_dir):
    """Adaptive hybrid retrieval for a batch of queries."""
    return hybrid.adaptive_search(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

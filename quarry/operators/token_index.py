"""Late interaction over ragged token vectors by way of an index of the tokens.

Every token vector is a row of a vector collection, in the list of its nearest centroid. A search takes the lists nearest to each query token, and the rows with a token in
one of them are candidates; those are scored with all their tokens, exactly as retrieval.maxsim_search does. Rows that share no probed list with a query are missed, so
recall is measured (vector_index.recall); the exact search stays where it must be whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieval import QUERY_BLOCK, _unit, maxsim_search
from quarry.operators.vector_index import VectorIndex
from quarry.session import cut_lineage


def build(rows: DataFrame, root: str, *, tokens: str = "tokens", key: str = "chunk_id", lists: int | None = None, **more) -> VectorIndex:
    """Writes the token vectors of rows (key, array of vectors) as a collection whose keys are the rows'. Rows without tokens are in no list."""
    each = rows.select(key, F.explode(tokens).alias("token"))
    return VectorIndex.build(each, root, key=key, vector="token", lists=lists, **more)


def search(index: VectorIndex, queries: DataFrame, rows: DataFrame, k: int = 10, *, probes: int = 2, tokens: str = "tokens", key: str = "chunk_id", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, chunk_id, score and rank for queries (query_id, query_tokens) among rows (key, tokens) that share a probed list with them. Each row gets its lists from the collection
    by one join and is written with them once; blocks of queries then go to the rows, as in maxsim_search, so no table of pairs is dealt."""
    size = index.meta.size

    def wanted(asked: list) -> np.ndarray:
        """The lists nearest to each query's tokens; the driver has one block of queries."""
        out = np.zeros((len(asked), len(index.centroids)), bool)
        for i, (_, ts) in enumerate(asked):
            own = np.array([t for t in ts if len(t) == size], np.float64).reshape(-1, size)
            out[i, np.argsort(-(_unit(own) @ index.centroids.T), axis=1, kind="stable")[:, :probes].ravel()] = True
        return out

    of = index.rows().filter("list >= 0").groupBy(F.col("key").alias(key)).agg(F.collect_set("list").alias("_lists"))
    held = cut_lineage(rows.select(key, tokens).join(of, key))
    return maxsim_search(queries, held, k, tokens=tokens, key=key, block=block, among=("_lists", wanted))

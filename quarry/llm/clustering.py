"""Centroid clustering: plain Lloyd rounds over integer vectors.

Vectors are turned into integers once and written to the shared folder. In each round the centroids are broadcast (`clusters` rows of `size`
integers, whatever the table's size), every task takes the integer squared differences to each of them, and sends its sums by cluster: at
most `clusters * (size + 1)` rows, which groupBy merges. All arithmetic is on integers, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, plain, scratch

_ROWS = 4096  # vectors whose distances are taken at once


@dataclass(frozen=True)
class Centroids:
    """One row of integers for each cluster, by number."""

    rows: tuple[tuple[int, ...], ...]

    def digest(self, cluster: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[cluster])).encode()).hexdigest()


def largest(size: int) -> int:
    """The greatest component whose squared distances of `size` components fit in a long."""
    return math.isqrt(((1 << 63) - 1) // size) // 2


def quantised(vector: Column, size: int, scale: int) -> Column:
    """floor(scale * x) of each component as an integer; null unless the vector has exactly `size` components, all finite. A component whose
    distances would not fit in a long raises an error: nothing is clipped."""
    kept = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < largest(size))
    return F.when(kept, F.when(fits, scaled.cast("array<int>" if largest(size) < 1 << 31 else "array<long>")).otherwise(F.raise_error(F.lit(f"a component times {scale} exceeds {largest(size)}"))))


def starts(vectors: DataFrame, clusters: int, seed: int) -> Centroids:
    """The vectors (columns key, v) with the smallest sha256 of `seed:key`, in that order; of equal keys the smaller vector comes first, a null key counts as
    an empty one. Each task sends `clusters` rows at most."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return Centroids(tuple(tuple(r.v) for r in vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()))


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances as integers: a row for each vector, a column for each centroid."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        unlike = vectors - c
        np.einsum("ij,ij->i", unlike, unlike, out=out[:, j])
    return out


def _nearest(column: pd.Series, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, numbers of the nearest centroids, squared distances) of blocks of rows; argmin takes the lowest of equal ones."""
    for i in range(0, len(column), _ROWS):
        block = np.stack(column.iloc[i : i + _ROWS].to_numpy()).astype(np.int64)
        d = distances(block, centroids)
        best = d.argmin(axis=1)
        yield block, best, d[np.arange(len(d)), best]


def move(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """One round: each centroid goes to the componentwise floor of the mean of its vectors; one without vectors stays."""
    sent = vectors.sparkSession.sparkContext.broadcast(np.array(centroids.rows, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        total = np.zeros((len(c), 1 + c.shape[1]), np.int64)  # the first column counts
        for batch in batches:
            for block, best, _ in _nearest(batch["v"], c):
                np.add.at(total[:, 0], best, 1)
                order = np.argsort(best, kind="stable")
                which, first = np.unique(best[order], return_index=True)
                total[which, 1:] += np.add.reduceat(block[order], first, axis=0)
        cluster, place = np.nonzero(total)
        yield pd.DataFrame({"cluster": cluster, "place": place, "n": total[cluster, place]})

    merged = vectors.select("v").mapInPandas(run, "cluster int, place int, n long").groupBy("cluster", "place").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    sums = {(r.cluster, r.place): r.n for r in merged}
    rows = []
    for j, old in enumerate(centroids.rows):
        count = sums.get((j, 0), 0)
        rows.append(tuple(sums.get((j, i + 1), 0) // count for i in range(len(old))) if count else old)
    return Centroids(tuple(rows))


def assign(vectors: DataFrame, centroids: Centroids) -> tuple[DataFrame, str]:
    """key, cluster and squared distance of each vector, written to the path that comes second."""
    sent = vectors.sparkSession.sparkContext.broadcast(np.array(centroids.rows, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(_nearest(batch["v"], sent.value))
            best, d = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (1, 2))
            yield pd.DataFrame({"key": batch["key"], "cluster": best.astype(np.int32), "distance": d})

    out = scratch(vectors.sparkSession, "clusters")
    vectors.mapInPandas(run, f"key {dict(vectors.dtypes)['key']}, cluster int, distance long").write.parquet(out)
    sent.destroy()
    return vectors.sparkSession.read.parquet(out), out


def cluster(
    table: DataFrame, clusters: int = 40, rounds: int = 5, *, size: int = 64, scale: int = 256, seed: int = 2, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, Centroids]:
    """key, cluster, distance (squared, to the final centroid), cluster_inertia and inertia (distances summed over its cluster and over all) and
    centroid_sha256 of each vector, and the final centroids.

    Vectors that are null, have not exactly `size` components or have a null, NaN or infinite one are left out. Null and repeated keys are
    rows like any other, repeated vectors count each time, ties go to the smaller number. Fewer vectors than `clusters` give as many centroids as there are
    vectors, an empty table none and no rows. Other columns are ignored, whatever they are called. The driver holds the centroids and one row of
    sums for each cluster and component."""
    if size < 1 or clusters < 1:
        raise ValueError("size and clusters must be 1 at least")
    spark = table.sparkSession
    own, (key, vector) = plain(table, key, vector)
    path = scratch(spark, "vectors")
    own.select(F.col(key).alias("key"), quantised(F.col(vector), size, scale).alias("v")).filter("v IS NOT NULL").write.parquet(path)
    vectors = spark.read.parquet(path)
    centroids = starts(vectors, clusters, seed)
    if not centroids.rows:
        discard(spark, path)
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"key {dict(own.dtypes)[key]}, {empty}"), centroids
    for _ in range(rounds):
        centroids = move(vectors, centroids)
    assigned, _ = assign(vectors, centroids)
    discard(spark, path)
    sums = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of_cluster = spark.createDataFrame(
        [(j, d, sum(sums.values()), centroids.digest(j)) for j, d in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    found = assigned.join(F.broadcast(of_cluster), "cluster")  # a row for each cluster
    return found.select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def lloyd_sql(clusters: int, rounds: int, size: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same over `embeddings` in DuckDB: a pair of materialised tables for each round."""
    floored = "(s - ((s % n) + n) % n) // n"  # of hugeints, down also below zero
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cluster, v AS c FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept
  ORDER BY h, v LIMIT {clusters}))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, min({{'d': d, 'cluster': cluster}}) AS best FROM (SELECT rid, cluster,
  list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list({floored} ORDER BY i)::BIGINT[] AS m FROM
  (SELECT best.cluster AS cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} JOIN kept USING (rid))
  GROUP BY ALL) GROUP BY cluster) USING (cluster))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.cluster AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""

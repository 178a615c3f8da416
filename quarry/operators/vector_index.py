"""A stored vector collection: rows by their nearest coarse centroid, of which a search reads only the nearest lists.

Centroids are fitted on a bounded sample (SAMPLE rows, by hash of the key) with Spark's own k-means; every row of the table is then placed in the list of its
nearest centroid by cosine, and lists are folders, so a search's partition filter names what it reads. Rows without a vector of the collection's
length have a list of their own, which no search reads. Scores of the rows that are read are exact; what is missed are rows of lists that weren't
probed, and with all lists probed nothing is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import _CELLS, QUERY_BLOCK, _Best, _in_blocks, _keys, _lists, _unit

SAMPLE = 65_536  # rows that the centroids are fitted on, at most
LISTS = 4096  # at most; by default the root of the number of rows


class VectorIndex:
    """A collection that build() has written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.meta = spark.read.parquet(f"{self.root}/meta").first()
        found = spark.read.parquet(f"{self.root}/centroids").orderBy("list").collect()  # LISTS rows at most
        self.centroids = _unit(np.array([r.centroid for r in found], np.float64).reshape(len(found), self.meta.size))

    @classmethod
    def build(
        cls, rows: DataFrame, root: str, *, key: str = "chunk_id", vector: str = "embedding", size: int | None = None, lists: int | None = None, sample: int = SAMPLE, seed: int = 7
    ) -> VectorIndex:
        """Writes rows (key, vector), which are read several times: give a table that is cheap to read. size: length of the vectors, by default that of most of them. lists: how many, by default the root of the number of vectors, LISTS at most."""
        spark, root = rows.sparkSession, root.rstrip("/")
        key_type = dict(rows.dtypes)[key]
        own = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        if size is None:
            most = own.filter("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
            size = most["n"] if most else 0
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        fit = own.filter((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
        n = fit.count()
        lists = max(1, min(LISTS, math.isqrt(n)) if lists is None else lists)
        # The sample is written once, as every round of the fit reads it.
        fit.filter(norm > 0).orderBy(F.xxhash64("key")).limit(sample).select("v").write.parquet(f"{root}/sample")
        part = spark.read.schema("v array<double>").parquet(f"{root}/sample").select(array_to_vector("v").alias("features"))
        if part.limit(lists + 1).count() > lists:
            means = KMeans(k=lists, seed=seed, maxIter=10, initMode="random", distanceMeasure="cosine")
            centroids = [c.tolist() for c in means.fit(part).clusterCenters()]
        else:  # fewer vectors than lists: one list
            centroids = [[0.0] * size]
        spark.createDataFrame(list(enumerate(centroids)), "list int, centroid array<double>").coalesce(1).write.parquet(f"{root}/centroids")
        spark.createDataFrame([(size, n, len(centroids), key_type)], "size int, n_rows long, lists int, key_type string").coalesce(1).write.parquet(f"{root}/meta")
        found = cls(spark, root)
        # A list's rows come together, so that there are about as many files as lists; a list that is large is split.
        found._place(own).hint("rebalance", "list").write.partitionBy("list").parquet(f"{root}/rows")
        return found

    def _place(self, own: DataFrame) -> DataFrame:
        size, sent = self.meta.size, self.spark.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts, sizes, values = _lists(batch.column(1))
                at = np.full(batch.num_rows, -1, np.int32)
                rows = np.flatnonzero(sizes == size)
                x = np.asarray(values, np.float64)[starts[rows][:, None] + np.arange(size)]
                whole = ~np.isnan(x).any(axis=1)
                at[rows[whole]] = (_unit(x[whole]) @ sent.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at)], ["key", "v", "list"])

        return own.mapInArrow(run, f"key {self.meta.key_type}, v array<double>, list int")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.meta.key_type}, v array<double>, list int").parquet(f"{self.root}/rows")

    def lists(self) -> DataFrame:
        return self.rows().groupBy("list").agg(F.count(F.lit(1)).alias("n_rows"))

    def search(self, queries: DataFrame, k: int = 20, *, probes: int | None = None, query_vector: str = "vector", block: int = QUERY_BLOCK, digits: int | None = None) -> DataFrame:
        """Cosine top k of queries (query_id, vector) among the rows of each query's `probes` nearest lists: query_id, chunk_id, score, rank. Without probes all lists are
        read and the search is exact. Queries of another length find nothing. digits: scores are rounded so, and equal ones ordered by key."""
        id_type, key_type, size = dict(queries.dtypes)["query_id"], self.meta.key_type, self.meta.size
        probes = len(self.centroids) if probes is None else min(probes, len(self.centroids))

        def search(asked: list) -> DataFrame:
            own = [(i, v) for i, v in asked if len(v) == size]
            m = _unit(np.array([v for _, v in own], np.float64).reshape(len(own), size))
            if probes < len(self.centroids):
                near = np.argsort(-(m @ self.centroids.T), axis=1, kind="stable")[:, :probes]
                asks = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
            else:  # all of them
                asks = dict.fromkeys(range(len(self.centroids)), slice(None)) if own else {}
            sent = self.spark.sparkContext.broadcast(([i for i, _ in own], m, asks))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, m, asks = sent.value
                best = _Best(len(ids), k, digits=digits)
                for batch in batches:
                    keys, of = _keys(batch.column(0)), batch.column(2).to_numpy()
                    starts, _, values = _lists(batch.column(1))
                    flat = np.asarray(values, np.float64)
                    every = isinstance(asks[of[0]], slice) if len(of) else False
                    for c in [None] if every else np.unique(of).tolist():
                        found = np.arange(len(of)) if every else np.flatnonzero(of == c)
                        mine, at = (m, None) if every else (m[asks[c]], asks[c])
                        step = max(1, _CELLS // len(mine))
                        for rows in (found[a : a + step] for a in range(0, len(found), step)):
                            scores = mine @ _unit(flat[starts[rows][:, None] + np.arange(size)]).T
                            best.block(scores, keys[rows], at)
                yield best.batch(ids, id_type, key_type)

            return self.rows().filter(F.col("list").isin(sorted(asks))).mapInArrow(run, f"query_id {id_type}, chunk_id {key_type}, score double")

        asked = queries.select("query_id", F.col(query_vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
        return _in_blocks(self.rows(), (tuple(r) for r in asked.toLocalIterator()), block, k, search)


    def calibrated(self, k: int = 20, target: float = 0.95, sample: int = 256) -> int:
        """The fewest lists to probe at which `target` of the exact top k of a sample's rows are found: exact search for `sample` rows (by hash of the key), and how near the lists
        of its results are to each query. Vectors without clusters need most lists."""
        known = self.rows().filter("list >= 0")
        asked = known.orderBy(F.xxhash64(F.col("key"), F.lit(1))).limit(sample).select(F.col("key").alias("query_id"), F.col("v").alias("vector"))
        exact = self.search(asked, k).select("query_id", F.col("chunk_id").alias("key"))
        found = exact.join(known.select("key", "list"), "key").groupBy("query_id").agg(F.collect_list("list").alias("lists"))  # k of each query in the sample
        places = []
        for vector, lists in found.join(asked, "query_id").select("vector", "lists").toLocalIterator():
            order = np.argsort(-(_unit(np.array([vector])) @ self.centroids.T)[0], kind="stable")
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order))
            places += place[lists].tolist()
        return int(np.quantile(places, target, method="higher")) + 1 if places else len(self.centroids)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: lists of exact results, how many of their rows were found, and the share."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_f")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("wanted"), F.count("_f").alias("found"), F.avg(F.coalesce("_f", F.lit(0))).alias("recall"))

"""A stored index of sparse vectors: postings by token, in blocks by impact, read by token alone.

Layout under a root folder: `postings/bucket=B/` has the blocks of the tokens whose hash falls into bucket B, so a search lists and reads only the
buckets of its queries' tokens (partition filters) and keeps their tokens alone before anything is dealt. A block holds up to BLOCK rows of one token
and one shard, heaviest first, with its greatest weight. A shard is a set of rows by hash, so a token that every row has makes blocks in every
shard and no task gets all of it. `meta` is one row of counts.

Search is exact. With non-negative weights, blocks that can't matter aren't read: the first block of each token gives every query k scores it
reaches at least, and a block of a token is needed only if some query with that token could still reach its k-th score with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import QUERY_BLOCK, _Best, _in_blocks, dot_products, packed_vectors, token_hashes, top_k

BLOCK = 128  # postings of a block
SHARD = 1 << 14  # rows of a shard, all of whose postings a task of a search holds at once
BUCKETS = 16
SHORT = 16  # mean number of tokens of queries up to which blocks are skipped; longer ones reach too many
_FIELDS = "h long, shard int, block int, top double, keys array<{key}>, weights array<double>"


class SparseIndex:
    """An index that build() has written; opening it reads its one row of counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.meta = spark.read.parquet(f"{self.root}/meta").first()

    @classmethod
    def build(cls, postings: DataFrame, root: str, *, key: str = "chunk_id", buckets: int = BUCKETS, shard: int = SHARD, block: int = BLOCK) -> SparseIndex:
        """Writes postings (key, token, weight; a null in any of them is left out, the greatest weight of a repeated pair stays), or vectors as from retrieval.term_vectors: first as rows,
        which are then dealt once, by shard. A task holds one shard's postings and makes its blocks."""
        spark, root = postings.sparkSession, root.rstrip("/")
        n, key_type = int(spark.conf.get("spark.sql.shuffle.partitions")), dict(postings.dtypes)[key]
        norm = F.aggregate("weights", F.lit(0.0), lambda t, x: t + x * x)
        packed_vectors(postings, key).select("key", "tokens", token_hashes().alias("h"), "weights").sortWithinPartitions(norm.desc()).write.parquet(f"{root}/rows")
        rows = spark.read.schema(f"key {key_type}, tokens array<string>, h array<long>, weights array<double>").parquet(f"{root}/rows")
        counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.min(F.array_min("weights")).alias("low")).first()
        shards = max(n, -(-counts["rows"] // shard))
        dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "tokens", "h", "weights").repartition(n, "shard").sortWithinPartitions("shard")
        schema = f"bucket int, h long, token string, shard int, block int, top double, keys array<{key_type}>, weights array<double>"
        blocks = dealt.mapInArrow(lambda batches: (out for s, held in _by_shard(batches) for out in _blocks(s, held, buckets, block)), schema)
        blocks.sortWithinPartitions("bucket", "h", "shard", "block").write.partitionBy("bucket").parquet(f"{root}/postings")
        found = spark.createDataFrame([(buckets, shards, block, counts["low"], key_type)], "buckets int, shards int, block int, low double, key_type string")
        found.coalesce(1).write.parquet(f"{root}/meta")
        return cls(spark, root)

    def rows(self) -> DataFrame:
        """key, h (hashes of its tokens) and weights of each row."""
        return self.spark.read.schema(f"key {self.meta.key_type}, h array<long>, weights array<double>").parquet(f"{self.root}/rows")

    def blocks(self) -> DataFrame:
        schema = _FIELDS.format(key=self.meta.key_type) + ", token string, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/postings")

    def postings(self) -> DataFrame:
        """chunk_id, token and weight again."""
        pairs = F.explode(F.arrays_zip("keys", "weights")).alias("e")
        return self.blocks().select("token", pairs).select(F.col("e.keys").alias("chunk_id"), "token", F.col("e.weights").alias("weight"))

    def tokens(self) -> DataFrame:
        """token, rows that have it, blocks and greatest weight."""
        return self.blocks().groupBy("token").agg(F.sum(F.size("keys")).alias("n_rows"), F.count(F.lit(1)).alias("n_blocks"), F.max("top").alias("top"))

    def of_tokens(self, hashes: np.ndarray) -> DataFrame:
        """Blocks of these tokens: their buckets' files, and of those the rows whose hash is asked for."""
        wanted = self.spark.createDataFrame(pa.table({"h": hashes}))  # at most a block of queries' tokens
        buckets = sorted(set((hashes % self.meta.buckets).tolist()))
        return self.blocks().filter(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), "h", "left_semi")

    def search(self, queries: DataFrame, k: int = 20, *, block: int = QUERY_BLOCK, skip: bool | None = None) -> DataFrame:
        """Dot-product top k of queries (query_id, token, weight; a null weight is left out): query_id, chunk_id, score, rank, ties to the smaller key. Rows without a
        shared token are left out. skip: whether blocks are skipped by thresholds; by default if queries are short. Negative weights turn it off."""
        id_type = dict(queries.dtypes)["query_id"]
        entry = F.struct(F.xxhash64(F.col("token").cast("string")).alias("h"), F.col("weight").cast("double").alias("w"))
        own = queries.dropna(subset=["token", "weight"]).groupBy("query_id").agg(F.collect_list(entry).alias("p"))

        def search(asked: list) -> DataFrame:
            short = sum(len(p) for _, p in asked) <= SHORT * len(asked) if skip is None else skip
            if not short:
                return dot_products(self.rows(), asked, k, id_type)
            batch = _Asked(asked)
            found = self.of_tokens(batch.tokens)
            if len(batch.w) and batch.w.min() >= 0 and self.meta.low is not None and self.meta.low >= 0:
                need = self._needs(found, batch, k, id_type)
                bounds = self.spark.createDataFrame(pa.table({"h": batch.tokens, "need": need}))
                found = found.join(F.broadcast(bounds), "h").filter("top >= need").drop("need")
            return self._scores(found, batch, k, id_type)

        return _in_blocks(self.blocks(), (tuple(r) for r in own.toLocalIterator()), block, k, search)

    def _needs(self, blocks: DataFrame, batch: _Asked, k: int, id_type: str) -> np.ndarray:
        """The weight from which on a block of a token can matter to any query that has it."""
        first = blocks.filter("block = 0")
        low = {r.query_id: r.score for r in top_k(self._scores(first, batch, k, id_type), k).filter(F.col("rank") == k).collect()}
        tops = {r.h: r.top for r in first.groupBy("h").agg(F.max("top").alias("top")).collect()}
        top = np.array([tops.get(h, 0.0) for h in batch.tokens.tolist()])
        size = np.diff(batch.first)
        reach = np.repeat(top, size) * batch.w  # of each query and token
        most = np.bincount(batch.q, reach, minlength=len(batch.ids))
        theta = np.array([low.get(i, -np.inf) for i in batch.ids])
        rest = theta[batch.q] - (most[batch.q] - reach)
        slack = 1e-9 * (1 + np.abs(most[batch.q]))  # sums of floats in another order
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(batch.w > 0, (rest - slack) / batch.w, np.where(rest - slack > 0, np.inf, -np.inf))
        return np.minimum.reduceat(need, batch.first[:-1])

    def _scores(self, blocks: DataFrame, batch: _Asked, k: int, id_type: str) -> DataFrame:
        """The k best rows of each query in each shard."""
        key_type = self.meta.key_type
        sent = self.spark.sparkContext.broadcast(batch)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def shard(table: pa.Table, asked: list, best: _Best) -> None:
            at = sent.value.places(table["h"].to_numpy())
            order = np.argsort(at, kind="stable")
            lists, weights = (table[c].combine_chunks() for c in ("keys", "weights"))
            flat, w = lists.flatten().dictionary_encode(), weights.flatten().to_numpy()
            keys, code = np.array(flat.dictionary.to_pylist(), object), flat.indices.to_numpy()
            size, start = np.diff(lists.offsets.to_numpy())[order], (lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())[order]
            pick = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            code, w = code[pick], w[pick]
            ends = np.concatenate(([0], np.cumsum(np.bincount(at[order], size, minlength=len(sent.value.tokens)).astype(np.int64))))
            for i, (t, qw) in enumerate(asked):
                a, n = ends[t], ends[t + 1] - ends[t]
                cell = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows = code[cell]
                score = np.bincount(rows, w[cell] * np.repeat(qw, n), minlength=len(keys))
                there = np.unique(rows)
                best.add(i, score[there], keys[there])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, asked = _Best(len(sent.value.ids), k), list(sent.value.by_query())
            for _, table in _by_shard(batches):
                shard(table, asked, best)
            yield best.batch(sent.value.ids, id_type, key_type)

        dealt = blocks.select("shard", "h", "keys", "weights").repartition(n, "shard").sortWithinPartitions("shard")
        return dealt.mapInArrow(run, f"query_id {id_type}, chunk_id {key_type}, score double")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """All rows of each shard in turn, of batches that are sorted by it (their first column)."""
    held, current = [], None
    for whole in batches:
        shards = whole.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and shards[a] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = int(shards[a])
            held.append(whole.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _blocks(shard: int, rows: pa.Table, buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a shard's rows: each token's postings by falling weight, then key, cut into blocks."""
    keys = rows["key"].combine_chunks()
    lists = rows["tokens"].combine_chunks()
    encoded = lists.flatten().dictionary_encode()
    code, w, h = encoded.indices.to_numpy(), rows["weights"].combine_chunks().flatten().to_numpy(), rows["h"].combine_chunks().flatten().to_numpy()
    if not len(code):
        return
    rank = np.empty(len(keys), np.int64)
    rank[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
    row = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((rank[row], -w, code))
    code, w, h, row = code[order], w[order], h[order], row[order]
    place = np.arange(len(code)) - np.searchsorted(code, code)
    starts = np.flatnonzero(place % block == 0)
    ends = np.append(starts, len(code)).astype(np.int32)
    offsets, of = pa.array(ends), pa.array(starts)
    columns = [
        pa.array((h[starts] % buckets).astype(np.int32)), pa.array(h[starts]), encoded.dictionary.take(pa.array(code[starts])), pa.array(np.full(len(of), shard, np.int32)), pa.array((place[starts] // block).astype(np.int32)),
        pa.array(w[starts]), pa.ListArray.from_arrays(offsets, keys.take(pa.array(row))), pa.ListArray.from_arrays(offsets, pa.array(w)),
    ]
    out = pa.RecordBatch.from_arrays(columns, ["bucket", "h", "token", "shard", "block", "top", "keys", "weights"])
    yield from (out.slice(a, 10_000) for a in range(0, out.num_rows, 10_000))


class _Asked:
    """A block of queries by token: of each token (ascending hash) the queries that have it and their weights."""

    def __init__(self, asked: list):
        self.ids = [i for i, _ in asked]
        q = np.repeat(np.arange(len(asked)), [len(p) for _, p in asked]).astype(np.int64)
        h = np.array([x["h"] for _, p in asked for x in p], np.int64)
        w = np.array([x["w"] for _, p in asked for x in p], np.float64)
        order = np.argsort(h, kind="stable")
        self.tokens, first = np.unique(h[order], return_index=True)
        self.first, self.q, self.w = np.append(first, len(h)), q[order], w[order]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tokens, hashes)

    def by_query(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens (places) and weights of each query in turn."""
        token = np.repeat(np.arange(len(self.tokens)), np.diff(self.first))
        order = np.argsort(self.q, kind="stable")
        ends = np.searchsorted(self.q[order], np.arange(len(self.ids) + 1))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield token[order[a:b]], self.w[order[a:b]]

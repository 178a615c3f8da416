"""Search over vectors, sparse vectors and text, for batches of queries, and the fusion of ranked lists.

Every operator takes a table of queries and a table of rows and returns (query_id, chunk_id, score, rank, ...). Ties go to the
smaller chunk_id. Dense search has a block form: pairs are never shuffled; the rows are dealt once, and each task multiplies its rows with the
queries in numpy, _CELLS scores at a time, and keeps the best k of each query, so the exchange carries at most k rows per query and task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.functions.text import words
from quarry.functions.vectors import cosine, sparse_top
from quarry.session import cut_lineage, scratch

#: Most queries that one pass broadcasts; a larger set is searched in several passes.
QUERY_BLOCK = 4096
_CELLS = 1 << 21  # scores that a task holds at once
_MAXSIM_ROWS = 256  # rows whose token vectors are multiplied at once


def top_k(scored: DataFrame, k: Column | int, *, by: str = "score", key: str = "chunk_id", per: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank. Spark prunes before the exchange when k is a number."""
    order = Window.partitionBy(per).orderBy(F.desc(by), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Best:
    """The k best keys of each query over the batches of a task; ties to the smaller key. Scores below `low` don't count, nor do -inf and NaN. digits: scores are rounded so.
    What reaches a query's floor waits, and is sorted with what is held once as many scores wait as are held."""

    def __init__(self, n: int, k: int, low: float = -np.inf, digits: int | None = None):
        self.n, self.k, self.digits = n, k, digits
        self.floor = np.full(n, max(low, np.nextafter(-np.inf, 0)))  # the score from which on a row matters
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, q: int, scores: np.ndarray, keys: np.ndarray) -> None:
        self.block(scores[None, :], keys, np.array([q]))

    def block(self, scores: np.ndarray, keys: np.ndarray, at: np.ndarray | None = None) -> None:
        """Scores of all queries, or those at these places, with these rows; most blocks matter to few queries once each has k rows."""
        if not scores.size:
            return
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        floor = (self.floor if at is None else self.floor[at]) - slack
        mine = np.flatnonzero(np.fmax.reduce(scores, axis=1) >= floor)
        own, at = (scores if len(mine) == len(scores) else scores[mine]), (mine if at is None else np.asarray(at)[mine])
        hit = own >= floor[mine][:, None]
        many = np.flatnonzero(hit.sum(axis=1) > self.k)
        if len(many):  # the k-th best of these rows is a floor
            most = np.where(hit[many], own[many], -np.inf)
            kth = np.partition(most, most.shape[1] - self.k, axis=1)[:, most.shape[1] - self.k]
            hit[many] &= most >= (kth - slack)[:, None]
            self.floor[at[many]] = np.maximum(self.floor[at[many]], kth if self.digits is None else np.round(kth, self.digits))
        i, j = np.nonzero(hit)
        q, found = at[i], own[i, j]
        if self.digits is not None:
            found = np.round(found, self.digits)
            there = found >= self.floor[q]
            q, found, j = q[there], found[there], j[there]
        self.waiting.append((q, found, keys[j]))
        self.count += len(q)
        if self.count > max(self.n * self.k, 1 << 16):
            self._sort()

    def _sort(self) -> None:
        q, s, keys = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        order = np.lexsort((keys, -s, q))
        q, s, keys = q[order], s[order], keys[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last, held = place == self.k - 1, place < self.k
        self.floor[q[last]] = s[last]
        self.waiting, self.count = [(q[held], s[held], keys[held])], 0

    def batch(self, ids: list, id_type: str, key_type: str) -> pa.RecordBatch:
        if self.waiting:
            self._sort()
        q, s, keys = self.waiting[0] if self.waiting else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], _arrow(id_type)), pa.array(list(keys), _arrow(key_type)), pa.array(s, pa.float64())], ["query_id", "chunk_id", "score"])


def _keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


def _in_blocks(rows: DataFrame, queries: Iterator, block: int, k: int, search: Callable[[list], DataFrame], many: Callable[[], None] | None = None) -> DataFrame:
    """Top k of `search` over blocks of queries. The driver holds one block at a time (and looks at the next one): a single block is a lazy plan, the
    results of several are written to the shared folder one after the other, after a call of `many`."""
    first, second = list(islice(queries, block)), list(islice(queries, block))
    if not second:
        return top_k(search(first), k)
    if many is not None:
        many()
    path = scratch(rows.sparkSession, "search")
    for part in chain((first, second), iter(lambda: list(islice(queries, block)), [])):
        top_k(search(part), k).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts and sizes of a list column's entries in its values; a null has size -1."""
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    sizes[np.asarray(column.is_null())] = -1
    return offsets[:-1], sizes, column.values


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows in as many tasks as shuffles have: a small file may hold rows that keep every core busy, once they are multiplied with all queries."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def dense_search(queries: DataFrame, rows: DataFrame, k: int = 20, *, threshold: float | None = None, vector: str = "embedding", key: str = "chunk_id", query_vector: str = "vector", block: int = QUERY_BLOCK, digits: int | None = None) -> DataFrame:
    """Cosine top k for each query (query_id, vector), exactly. threshold keeps scores strictly above it; rows with a null vector or
    another length than the query are left out; zero vectors score 0. digits: scores are rounded so, and equal ones ordered by key (copies of a row need not get the
    same last bits). The driver gets one block of query vectors at a time."""
    if k < 1:
        raise ValueError("k must be positive")
    id_type, key_type = dict(queries.dtypes)["query_id"], dict(rows.dtypes)[key]
    low = -np.inf if threshold is None else np.nextafter(threshold, np.inf)

    def search(asked: list) -> DataFrame:
        by_size: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(asked):
            by_size.setdefault(len(v), []).append(i)
        matrices = {size: (own, _unit(np.array([asked[i][1] for i in own], np.float64).reshape(len(own), size))) for size, own in by_size.items()}
        sent = rows.sparkSession.sparkContext.broadcast(([i for i, _ in asked], matrices))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrices = sent.value
            best = _Best(len(ids), k, low, digits)
            for batch in batches:
                keys = _keys(batch.column(0))
                starts, sizes, values = _lists(batch.column(1))
                flat = np.asarray(values, np.float64)
                for size, (at, m) in matrices.items():
                    found = np.flatnonzero(sizes == size)
                    step = max(1, _CELLS // len(at))
                    for own in (found[a : a + step] for a in range(0, len(found), step)):
                        scores = m @ _unit(flat[starts[own][:, None] + np.arange(size)]).T
                        best.block(scores, keys[own], at)
            yield best.batch(ids, id_type, key_type)

        return _dealt(rows.select(F.col(key), F.col(vector)), key).mapInArrow(run, f"query_id {id_type}, chunk_id {key_type}, score double")

    asked = queries.select("query_id", F.col(query_vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    return _in_blocks(rows, (tuple(r) for r in asked.toLocalIterator()), block, k, search)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def dense_search_expr(query_vector: Column, rows: DataFrame, k: int = 20, *, threshold: float | None = None, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """One query as an expression: cosine, filter, top k without a full sort."""
    scored = rows.filter(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), query_vector).alias("score"))
    if threshold is not None:
        scored = scored.filter(F.col("score") > threshold)
    return scored.orderBy(F.desc("score"), key).limit(k)


# ---- sparse


_TEXT = 4 << 20  # bytes of text whose words are counted at once
_GAP = "\uffff"  # between words; a noncharacter, which no text has


def _counts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Group, word and count of each word of each group of texts; within a group most frequent words first, then by word."""
    split = pc.split_pattern(texts, _GAP)
    offsets = split.offsets.to_numpy()
    encoded = split.flatten().dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cell = np.repeat(group, np.diff(offsets)) * max(1, len(order)) + rank[encoded.indices.to_numpy()]
    cell, n = np.unique(cell[np.asarray(pc.not_equal(encoded.dictionary, ""), bool)[encoded.indices.to_numpy()]], return_counts=True)
    g, word = np.divmod(cell, max(1, len(order)))
    by = np.lexsort((-n, g))  # stable: equal counts stay by word
    return g[by], encoded.dictionary.take(pa.array(order[word[by]])), n[by]


def term_vectors(rows: DataFrame, *, key: str = "chunk_id", text: str = "text", top: int = 128, pattern: str = r"[^\p{L}]+") -> DataFrame:
    """Sparse vectors, one of each key (key, tokens, weights): counts of lower-cased words, the `top` of each key by count, then token; keys without words are left out. The
    texts are dealt by key once and counted in numpy, a few MB at a time; texts of one key are counted together."""
    n, key_type = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), dict(rows.dtypes)[key]
    split = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), pattern, _GAP)

    def row(held: tuple[object, Counter], kind: pa.DataType) -> tuple:
        best = sorted(held[1].items(), key=lambda e: (-e[1], e[0]))[:top]
        return pa.array([held[0]], kind), np.array([len(best)]), pa.array([t for t, _ in best], pa.string()), np.array([w for _, w in best], np.int64)

    def packed(keys: pa.Array, sizes: np.ndarray, tokens: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        lists = (pa.ListArray.from_arrays(offsets, c) for c in (tokens, pa.array(weights.astype(np.float64))))
        return pa.RecordBatch.from_arrays([keys, *lists], ["key", "tokens", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key with its counts, which may go on in what comes next
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            cuts = np.unique(np.append(np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, _TEXT)), len(size)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                keys = part.column(0).to_pylist()
                new = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))])
                first = np.flatnonzero(new)
                g, tokens, n = _counts(part.column(1), np.cumsum(new) - 1)
                ends = np.searchsorted(g, np.arange(len(first) + 1))
                own = lambda i: Counter(dict(zip(tokens[ends[i] : ends[i + 1]].to_pylist(), n[ends[i] : ends[i + 1]].tolist(), strict=True)))  # noqa: B023, E731
                begin = 0
                if held is not None and held[0] == keys[0]:
                    held[1].update(own(0))
                    begin = 1
                if begin == len(first):
                    continue
                if held is not None and held[1]:
                    yield packed(*row(held, part.column(0).type))
                held = (keys[-1], own(len(first) - 1))
                place = np.arange(len(g)) - ends[g]
                stay = np.flatnonzero((place < top) & (g >= begin) & (g < len(first) - 1))
                sizes = np.bincount(g[stay], minlength=len(first))
                there = np.flatnonzero(sizes)
                yield packed(part.column(0).take(pa.array(first[there])), sizes[there], tokens.take(pa.array(stay)), n[stay])
        if held is not None and held[1]:
            yield packed(*row(held, pa.array([held[0]]).type if held[0] is None else _arrow(key_type)))

    dealt = rows.select(key, split.alias("_text")).repartition(n, key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, f"key {key_type}, tokens array<string>, weights array<double>").withColumnRenamed("key", key)


def term_frequencies(rows: DataFrame, *, key: str = "chunk_id", text: str = "text", top: int = 128, pattern: str = r"[^\p{L}]+") -> DataFrame:
    """The vectors of term_vectors in long form (key, token, weight)."""
    found = term_vectors(rows, key=key, text=text, top=top, pattern=pattern)
    return found.select(key, F.explode(F.arrays_zip("tokens", "weights")).alias("e")).select(key, F.col("e.tokens").alias("token"), F.col("e.weights").alias("weight"))


def packed_vectors(postings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, tokens, weights), a row for each key, of postings in long form (key, token, weight; a null in any of them is left out, the greatest weight of a repeated pair
    stays) or of what is packed already (tokens, weights)."""
    if {"tokens", "weights"} <= set(postings.columns):
        return postings.select(F.col(key).alias("key"), "tokens", "weights").filter("key IS NOT NULL")
    own = postings.select(F.col(key).alias("key"), F.col("token").cast("string"), F.col("weight").cast("double")).dropna().groupBy("key", "token").agg(F.max("weight").alias("weight"))
    return own.groupBy("key").agg(F.collect_list(F.struct("token", "weight")).alias("e")).select("key", F.col("e.token").alias("tokens"), F.col("e.weight").alias("weights"))


def sparse_vectors(rows: DataFrame, weights: str = "weights", k: int = 128, key: str = "chunk_id") -> DataFrame:
    """Long form of the k greatest weights of a map column."""
    return rows.select(key, F.explode(sparse_top(F.col(weights), k)).alias("p")).select(key, "p.token", "p.weight")


_ROWS = 2048  # rows whose products are added up at once, at most


def dot_products(rows: DataFrame, asked: list, k: int, id_type: str) -> DataFrame:
    """The k best rows of each query in each task, by dot product: rows (key, h, weights), with the hashes of a row's tokens; asked: (query_id, entries of h and w). Rows without a shared
    token are left out. A batch's rows are taken by falling norm, and a query is left out from the row on whose norm times the query's can't reach its k-th score: exact, as no
    product of vectors is greater than that of their norms."""
    key_type = dict(rows.dtypes)["key"]
    ids = [i for i, _ in asked]
    q = np.repeat(np.arange(len(ids)), [len(p) for _, p in asked])
    h = np.array([x["h"] for _, p in asked for x in p], np.int64)
    w = np.array([x["w"] for _, p in asked for x in p], np.float64)
    order = np.argsort(h, kind="stable")
    tokens, first = np.unique(h[order], return_index=True)
    sent = rows.sparkSession.sparkContext.broadcast((ids, tokens, np.append(first, len(h)), q[order], w[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, every, all_q, all_w = sent.value
        best, room = _Best(len(ids), k), 64
        reach = np.sqrt(np.bincount(all_q, all_w * all_w, minlength=len(ids))) * (1 + 1e-9)  # sums of floats in another order
        for batch in batches if len(tokens) else ():
            keys = _keys(batch.column(0))
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            hashes, weights = (np.asarray(batch.column(i).flatten()) for i in (1, 2))
            starts = np.cumsum(sizes) - sizes
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(keys)), sizes), weights * weights, minlength=len(keys)))
            order, a = np.argsort(-norm, kind="stable"), 0
            while a < len(keys):
                live = np.flatnonzero(~(reach * norm[order[a]] < best.floor))
                if not len(live):
                    break
                mine = order[a : a + max(1, min(room, _CELLS // len(live)))]
                if len(live) < len(ids):
                    at = np.full(len(ids), -1)
                    at[live] = np.arange(len(live))
                    stay = at[all_q] >= 0
                    first, q, w = np.concatenate(([0], np.cumsum(stay)))[every], at[all_q[stay]], all_w[stay]
                else:
                    first, q, w = every, all_q, all_w
                own = np.repeat(starts[mine] - (np.cumsum(sizes[mine]) - sizes[mine]), sizes[mine]) + np.arange(sizes[mine].sum())
                at = np.minimum(np.searchsorted(tokens, hashes[own]), len(tokens) - 1)
                n = np.where(tokens[at] == hashes[own], first[at + 1] - first[at], 0)  # queries that have the posting's token
                ends = np.concatenate(([0], np.cumsum(sizes[mine])))
                products = np.concatenate(([0], np.cumsum(n)))[ends]  # up to each row's start
                # Rows that make _CELLS products or scores at most, or one row.
                b = max(1, min(int(np.searchsorted(products, _CELLS, "right")) - 1, len(mine)))
                room = min(_ROWS, 2 * b)
                mine, at, n, own = mine[:b], at[: ends[b]], n[: ends[b]], own[: ends[b]]
                entry = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = q[entry] * b + np.repeat(np.repeat(np.arange(b), sizes[mine]), n)
                scores = np.bincount(cell, w[entry] * np.repeat(weights[own], n), minlength=len(live) * b).astype(np.float64, copy=False)
                shared = np.zeros(len(scores), bool)
                shared[cell] = True
                scores[~shared] = -np.inf
                best.block(scores.reshape(len(live), -1), keys[mine], live)
                a += b
        yield best.batch(ids, id_type, key_type)

    return rows.mapInArrow(run, f"query_id {id_type}, chunk_id {key_type}, score double")


def token_hashes(tokens: str = "tokens") -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def sparse_search(queries: DataFrame, postings: DataFrame, k: int = 20, *, key: str = "chunk_id", keep_zero: DataFrame | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Dot-product top k of queries (query_id, token, weight) over postings (key, token, weight), or vectors as from term_vectors, exactly. A row's postings come together; each task
    adds up products with a block of queries and sends the k best rows of each, so no table of pairs is ever dealt, however frequent a token. Tokens are compared by 64-bit hash.
    keep_zero: a table with every key, whose rows without a shared token score 0 instead of being left out."""
    id_type = dict(queries.dtypes)["query_id"]
    entry = F.struct(F.xxhash64("token").alias("h"), F.col("weight").cast("double").alias("w"))
    packed = [packed_vectors(postings, key).select("key", token_hashes().alias("h"), "weights")]

    def search(asked: list) -> DataFrame:
        return dot_products(packed[-1], asked, k, id_type)

    own = queries.filter("weight IS NOT NULL").groupBy("query_id").agg(F.collect_list(entry).alias("p"))
    # Several blocks of queries read the vectors again: they are made once.
    best = _in_blocks(packed[0], (tuple(r) for r in own.toLocalIterator()), block, k, search, lambda: packed.append(cut_lineage(packed[0])))
    if keep_zero is None:
        return best
    # A query with k matches or more needs no row that scores 0, if no weight is negative. Of the others every match is in `best`, so the
    # smallest keys that they lack are among the first 2k.
    scored = best.select("query_id", "chunk_id", "score")
    matched = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    lacking = queries.select("query_id").distinct().join(matched, "query_id", "left").filter(F.coalesce("_n", F.lit(0)) < k).select("query_id")
    smallest = keep_zero.select(F.col(key).alias("chunk_id")).distinct().orderBy("chunk_id").limit(2 * k)
    zeros = lacking.join(F.broadcast(smallest), F.lit(True)).join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top_k(scored.unionByName(zeros.select("query_id", "chunk_id", F.lit(0.0).alias("score"))), k)


def maxsim_search(
    queries: DataFrame, rows: DataFrame, k: int = 10, *, tokens: str = "tokens", key: str = "chunk_id", block: int = QUERY_BLOCK, among: tuple[str, Callable[[list], np.ndarray]] | None = None
) -> DataFrame:
    """Late interaction: each query (query_id, query_tokens) against every row's token vectors, as vectors.maxsim has it. Pairs are never dealt: a
    task multiplies its rows' token vectors with those of a block of queries and keeps the k best rows of each. Rows without tokens are left out.
    among: a column of each row's lists (numbers from 0) and what tells for a block of queries, as a matrix of booleans, which lists each of them asks for; a query gets rows of its
    lists alone."""
    id_type, key_type = dict(queries.dtypes)["query_id"], dict(rows.dtypes)[key]

    def search(asked: list) -> DataFrame:
        wanted = None if among is None else np.packbits(among[1](asked), axis=0)  # eight queries in a byte
        sent = rows.sparkSession.sparkContext.broadcast(([(i, [np.array(t, np.float64) for t in ts]) for i, ts in asked], wanted))

        def candidates(lists: pa.Array, n: int) -> np.ndarray:
            """Which queries ask for which rows, as a matrix of booleans."""
            starts, sizes, values = _lists(lists)
            own = np.flatnonzero(sizes > 0)
            out = np.zeros((n, len(lists)), bool)
            if len(own):
                at = np.asarray(lists.flatten())
                heads = np.concatenate(([0], np.cumsum(sizes[own])[:-1]))
                packed = np.bitwise_or.reduceat(sent.value[1][:, at], heads, axis=1)
                out[:, own] = np.unpackbits(packed, axis=0, count=n)
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = [i for i, _ in sent.value[0]]
            # All token vectors of a length together, with the query that each belongs to.
            by_size: dict[int, tuple[list[int], list[np.ndarray]]] = {}
            for q, (_, ts) in enumerate(sent.value[0]):
                for t in ts:
                    own = by_size.setdefault(len(t), ([], []))
                    own[0].append(q)
                    own[1].append(t)
            matrices = {size: (np.array(q), _unit(np.stack(m))) for size, (q, m) in by_size.items() if size}
            best = _Best(len(ids), k)
            step = max(1, min(_MAXSIM_ROWS, _CELLS // max(1, len(ids))))
            for whole in batches:
                for a in range(0, whole.num_rows, step):
                    batch = whole.slice(a, step)
                    keys = _keys(batch.column(0))
                    _, counts, _ = _lists(batch.column(1))
                    inner = batch.column(1).flatten()
                    starts, sizes, values = _lists(inner)
                    flat, row = np.asarray(values, np.float64), np.repeat(np.arange(len(keys)), np.maximum(counts, 0))
                    scores = np.zeros((len(ids), len(keys)))
                    for size, (q, m) in matrices.items():
                        own = np.flatnonzero(sizes == size)
                        if not len(own):
                            continue
                        x = _unit(flat[starts[own][:, None] + np.arange(size)])
                        heads = np.flatnonzero(np.concatenate(([True], row[own][1:] != row[own][:-1])))
                        # Token vectors of a query are neighbours, as they were put together query by query.
                        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
                        bounds = [*first[:: max(1, _CELLS // (4 * max(1, len(own))) // max(1, len(q) // len(first)))].tolist(), len(q)]
                        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
                            most = np.maximum(np.maximum.reduceat(m[b:e] @ x.T, heads, axis=1), 0.0)
                            inside = first[(first >= b) & (first < e)]
                            scores[q[inside][:, None], row[own][heads]] += np.add.reduceat(most, inside - b, axis=0)
                    there = counts > 0
                    scores[:, ~there] = -np.inf
                    if sent.value[1] is not None:
                        scores[~candidates(batch.column(2), len(ids))] = -np.inf
                    best.block(scores, keys)
            yield best.batch(ids, id_type, key_type)

        more = [] if among is None else [F.col(among[0]).cast("array<int>")]
        return _dealt(rows.select(F.col(key), F.col(tokens).cast("array<array<double>>"), *more), key).mapInArrow(run, f"query_id {id_type}, chunk_id {key_type}, score double")

    asked = queries.select("query_id", F.col("query_tokens").cast("array<array<double>>").alias("t")).filter("t IS NOT NULL")
    return _in_blocks(rows, (tuple(r) for r in asked.toLocalIterator()), block, k, search)


# ---- fusion


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 10, *, dense_weight: Column | float = 0.4, sparse_weight: Column | float = 0.3, rrf_k: int = L.RRF_K, weights: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists by a full outer join on query and row. Ties: dense rank first, then sparse
    rank. `weights`: a table (query_id, dense_weight, sparse_weight) for weights that differ by query."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    if weights is not None:
        both = both.join(weights.select("query_id", "dense_weight", "sparse_weight"), "query_id")
        dense_weight, sparse_weight = F.col("dense_weight"), F.col("sparse_weight")

    def part(w, rank):
        return F.coalesce(F.lit(w) / (F.lit(rrf_k) + F.col(rank)) if not isinstance(w, Column) else w / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))

    fused = both.withColumn("score", part(dense_weight, "dense_rank") + part(sparse_weight, "sparse_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("dense_rank", F.lit(10**6) + F.col("sparse_rank")), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_side(queries: DataFrame, rows, k: int, **named) -> DataFrame:
    """Dense search in a table of vectors, or in a stored collection (vector_index.VectorIndex)."""
    return dense_search(queries, rows, k, **named) if isinstance(rows, DataFrame) else rows.search(queries, k, **named)


def sparse_side(queries: DataFrame, postings, k: int) -> DataFrame:
    """Sparse search in a table of postings, or in a stored index (sparse_index.SparseIndex)."""
    return sparse_search(queries, postings, k) if isinstance(postings, DataFrame) else postings.search(queries, k)


def hybrid_search(
    dense_queries: DataFrame, sparse_queries: DataFrame, rows, postings, k: int = 10, *, dense_top_k: int = 50, sparse_top_k: int = 50, dense_weight: float = 0.4, sparse_weight: float = 0.3, **named
) -> DataFrame:
    """Both sides (tables or stored ones), fused."""
    dense, sparse = dense_side(dense_queries, rows, dense_top_k, **named), sparse_side(sparse_queries, postings, sparse_top_k)
    return rrf(dense, sparse, k, dense_weight=dense_weight, sparse_weight=sparse_weight)


def adaptive_search(planned: DataFrame, dense_queries: DataFrame, sparse_queries: DataFrame, rows, postings, k: int = 10, **named) -> DataFrame:
    """Weights and candidate sizes follow each query's type (columns of classify.plan_queries). One pass for all types: the
    widest lists are fetched and cut to each query's own size by rank. Both sides are tables or stored ones."""
    most_dense, most_sparse = (max(x) for x in zip(*L.FETCH_SIZES.values(), strict=True))
    sizes = planned.select("query_id", "dense_top_k", "sparse_top_k", "dense_weight", "sparse_weight", "query_type", "confidence")
    dense = dense_side(dense_queries, rows, most_dense, **named).join(sizes.select("query_id", "dense_top_k"), "query_id").filter(F.col("rank") <= F.col("dense_top_k"))
    sparse = sparse_side(sparse_queries, postings, most_sparse).join(sizes.select("query_id", "sparse_top_k"), "query_id").filter(F.col("rank") <= F.col("sparse_top_k"))
    return rrf(dense, sparse, k, weights=sizes).join(sizes.select("query_id", "query_type", "confidence"), "query_id")


# ---- text, dedup, neighbours


def fulltext_search(queries: DataFrame, rows: DataFrame, k: int = 20, *, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Rows that hold every word of the query (query_id, query), by the words' share of the row. Words are lower-cased runs of letters and digits;
    there is no stemmer."""
    split = r"[^\p{L}\p{N}]+"
    asked = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), split), lambda t: t != ""))).alias("token"))
    need = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_need"))
    tokens = rows.select(F.col(key).alias("chunk_id"), F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), split), lambda t: t != "").alias("_t"))
    tf = tokens.select("chunk_id", F.size("_t").alias("_len"), F.explode("_t").alias("token")).join(asked.select("token").distinct(), "token", "left_semi").groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("_n"), F.first("_len").alias("_len"))
    hits = tf.join(asked, "token").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("_found"), (F.sum("_n") / F.first("_len")).alias("score"))
    return top_k(hits.join(need, "query_id").filter("_found = _need").select("query_id", "chunk_id", "score"), k)


def best_per_group(ranked: DataFrame, group: str = "paper_id", per: str = "query_id") -> DataFrame:
    """The best row of each group (a paper's best chunk), ranked anew."""
    first = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(per, group).orderBy("rank"))).filter("_r = 1").drop("_r")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy("rank")))


def neighbour_groups(ranked: DataFrame, own: DataFrame, k: int = 3, *, group: str = "paper_id", threshold: float | None = None) -> DataFrame:
    """For each query the first k other groups in rank order (hard negatives; with a threshold, similar groups). `own`: (query_id,
    group) that is left out."""
    rows = ranked.join(own.select("query_id", F.col(group).alias("_own")), "query_id", "left").filter(~F.col(group).eqNullSafe(F.col("_own")))
    if threshold is not None:
        rows = rows.filter(F.col("score") >= threshold)
    firsts = rows.groupBy("query_id", group).agg(F.min("rank").alias("_first"))
    chosen = firsts.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("_first", group))).filter(F.col("_r") <= k)
    return chosen.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(group).alias("g")))), lambda x: x["g"]).alias("groups"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character trigrams of two lower-cased texts; 0 where both have none."""

    def grams(t: Column) -> Column:
        low = F.lower(t)
        return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    x, y = grams(a), grams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def semantic_filter(rows: DataFrame, anchor: Column, *, threshold: float = 0.55, k: int = 5000, vector: str = "embedding", key: str = "paper_id") -> DataFrame:
    """Rows whose similarity to the anchor reaches the threshold, best first, at most k (the operator's limit)."""
    scored = rows.withColumn("similarity", cosine(F.col(vector), anchor)).filter(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def index_stats(index: DataFrame, name: str = "vector_name") -> DataFrame:
    return index.groupBy(name).agg(F.count(F.lit(1)).alias("points"))


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that stand in the text: the built-in scorer of the reranker."""
    q = F.array_distinct(words(F.lower(query)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.lower(text)))) / F.size(q)).otherwise(F.lit(0.0))

"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates, links confirmed on full sets.

Equal sets are one node from the start. A node's sketch has BANDS * ROWS bins: each shingle's hash names its bin and its value there, a bin keeps
its least value, and an empty bin takes that of a bin drawn by a hash of its own number and the attempt (optimal densification), so bins stay
independent. A band of ROWS bins is a bucket's key. In each bucket one member is the centre (the one with most neighbours over all its buckets, such as the original of
many edited copies), and every node is compared with the best of its buckets' centres: stars with one edge for each node, not all pairs. Buckets whose members then lie
in one component are done. Of the others the members come together with their sets: one numpy pass tells which members of different components are worth a look (sizes, one bit of
each of BITS bins, and no earlier bucket in common), those are compared, and only edges of a forest go out: no pair that shares a bucket is lost and none is dealt.
A bucket too large for a task is cut into blocks, and each pair of blocks is a group of its own.

Links are confirmed on the full sets: the sets of nodes that share a bucket are written once as sorted 64-bit hashes. Stars are dealt by centre and stream past the
centre's own set; a centre with many candidates is dealt to many tasks. Texts at the similarity differ in more bits than budget() allows with odds below one in a million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.common import Store, mix, plain, slices, span_hashes, sums, text_bytes, word_spans
from quarry.llm.components import connected_components

BANDS = 32
ROWS = 5
BLOCK = 1 << 21  # shingles of a bucket's members that a block has, about
BITS = 128  # of a sketch that go with a node
STAR = 4096  # candidates of one centre that a task takes
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(raw):
        end = at + (1 << 20)
        while end < len(raw):
            gap = np.flatnonzero((raw[end : end + 4096] == 32) | ((raw[end : end + 4096] >= 9) & (raw[end : end + 4096] <= 13)))
            if len(gap):
                end += int(gap[0])
                break
            end += 4096
        yield raw[at:end]
        at = end


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the words, their offsets by row) of slices of a batch of texts, A-Z lower-cased."""
    raw, offsets = text_bytes(column)
    for a, b in slices(offsets):
        text = np.frombuffer(raw[offsets[a] : offsets[b]].tobytes().translate(_LOWER), np.uint8)
        if b - a == 1 and len(text) > 1 << 21:
            parts = []
            for piece in _pieces(text):
                starts, ends, _ = word_spans(piece, np.array([0, len(piece)]))
                parts.append(span_hashes(piece, starts, ends))
            h = np.concatenate(parts)
            yield a, h, np.array([0, len(h)])
        else:
            starts, ends, rows = word_spans(text, offsets[a : b + 1] - offsets[a])
            yield a, span_hashes(text, starts, ends), np.searchsorted(rows, np.arange(b - a + 1))


def shingle_sets(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the different shingles of each text, ascending. Fewer words than a shingle has are one shingle; no words give none."""
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = np.repeat(offsets[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    taken = np.minimum(n, size)[row]
    h = mix(taken.astype(np.uint64))
    for j in range(size):
        inside = j < taken
        h[inside] = mix(h[inside] * _GOLD + words[at[inside] + j])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], np.searchsorted(row[first], np.arange(len(n) + 1))


def sketches(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """A row of bin values for each set that isn't empty, empty bins filled from others."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = row * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # the high half names the bin
    value = mix(hashes ^ _GOLD)
    order = np.lexsort((value, place))
    place, value = place[order], value[order]
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    out, full = np.zeros(len(sizes) * bins, np.uint64), np.zeros(len(sizes) * bins, bool)
    out[place[first]] = value[first]
    full[place[first]] = True
    left = np.flatnonzero(~full)
    left = left[(sizes > 0)[left // bins]]
    attempt = 0
    while len(left):
        attempt += 1
        bin_ = (left % bins).astype(np.uint64)
        other = left // bins * bins + (mix(bin_ + np.uint64(int(_GOLD) * attempt % (1 << 64))) % np.uint64(bins)).astype(np.int64)
        found = full[other]
        out[left[found]] = out[other[found]]
        left = left[~found]
    return out.reshape(len(sizes), bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; keys of different bands differ."""
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), 1))
    for j in range(rows):
        out = mix(out * _GOLD + sketch[:, j::rows])
    return out


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """One bit of each of the first BITS bins, as two longs: equal bins agree, others in half of all cases."""
    taken = sketch[:, :BITS]
    bits = np.zeros((len(sketch), BITS), np.uint8)
    bits[:, : taken.shape[1]] = mix(taken + _GOLD * np.arange(1, taken.shape[1] + 1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(len(sketch), 2)


def budget(percent: int, bits: int) -> int:
    """The fewest differing bits that sets at the similarity exceed with odds below one in a million."""
    p, tail = (100 - percent) / 200, 1.0
    for k in range(bits + 1):
        tail -= math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if tail < 1e-6:
            return k
    return bits


def _nodes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits that stand for a set."""
    return mix(sums(mix(hashes + _GOLD), offsets, np.uint64) ^ mix(np.diff(offsets).astype(np.uint64)))


def sign(docs: DataFrame, words: int, percent: int, bands: int, rows: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null for an empty set), b0 and b1 (bits of its sketch) and keys (of its buckets; none for a set so small that only an equal one
    is near)."""
    least = math.ceil(percent / max(100 - percent, 1)) if percent < 100 else 1 << 62  # shingles of the smaller of two different sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, bits, keys = [], [], [], []
            for _, w, at in word_hashes(batch.column(2)):
                h, ends = shingle_sets(w, at, words)
                size = np.diff(ends)
                n.append(size)
                node.append(_nodes(h, ends))
                sketch = sketches(h, ends, bands * rows)
                bits.append(sketch_bits(sketch))
                found = band_keys(sketch, bands, rows).view(np.int64)
                keys += [x if s >= least else () for x, s in zip(found, size, strict=True)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            node = np.concatenate(node) if node else np.zeros(0, np.uint64)
            bits = np.concatenate(bits) if bits else np.zeros((0, 2), np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(node.view(np.int64), mask=n == 0), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "node", "b0", "b1", "keys"])

    own, (key, text) = plain(docs, key, text)
    read = own.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return read.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, b0 long, b1 long, keys array<long>")


def _members(rows: DataFrame, words: int, bands: int, band_rows: int) -> DataFrame:
    """node, its set as sorted 64-bit hashes, the bits of its sketch and its buckets' keys, of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, bits, keys = [], [], []
            for _, w, at in word_hashes(batch.column(1)):
                h, ends = shingle_sets(w, at, words)
                sketch = sketches(h, ends, bands * band_rows)
                sets += [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                bits += [x.tobytes() for x in sketch_bits(sketch)]
                keys += [x.tobytes() for x in band_keys(sketch, bands, band_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (sets, bits, keys))], ["node", "members", "bits", "keys"])

    return rows.mapInArrow(run, "node long, members binary, bits binary, keys binary")


class _Group:
    """The members of a bucket, or of two blocks of one: which of them are linked across components."""

    def __init__(self, bucket: int, rows: list[tuple], percent: int, most: int):
        block, node, root, members, bits, keys = zip(*rows, strict=True)
        self.percent, self.most, self.node = percent, most, np.array(node)
        self.block, self.crossed = np.array(block), len(set(block)) > 1
        self.sets = [np.frombuffer(m, np.uint64) for m in members]
        self.size = np.array([len(x) for x in self.sets])
        self.bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(rows), 2)
        keys = np.frombuffer(b"".join(keys), np.int64).reshape(len(rows), -1)
        self.before = keys[:, : int(np.argmax(keys[0] == bucket))]  # of the bands that come first
        self.root = np.unique(np.array(root), return_inverse=True)[1]
        self.index: tuple | None = None

    def worth(self, i: int) -> np.ndarray:
        """Later members of other components that may be near i."""
        j = np.arange(i + 1, len(self.node))
        j = j[self.root[j] != self.root[i]]
        j = j[self.block[j] != self.block[i]] if self.crossed else j
        j = j[100 * np.minimum(self.size[j], self.size[i]) >= self.percent * np.maximum(self.size[j], self.size[i])]
        j = j[np.bitwise_count(self.bits[j] ^ self.bits[i]).sum(axis=1) <= self.most]
        return j[~(self.before[j] == self.before[i]).any(axis=1)]

    def shared(self, i: int, j: np.ndarray) -> np.ndarray:
        """How many shingles i has in common with each of j."""
        if len(j) < 8:
            own = self.sets[i]
            out = []
            for x in j:
                place = np.searchsorted(own, self.sets[x])
                place[place == len(own)] = 0
                out.append((own[place] == self.sets[x]).sum())
            return np.array(out)
        if self.index is None:  # which members have each shingle
            flat = np.concatenate(self.sets)
            _, which = np.unique(flat, return_inverse=True)
            order = np.argsort(which, kind="stable")
            owner = np.repeat(np.arange(len(self.sets)), self.size)[order]
            self.index = which, owner, np.concatenate(([0], np.cumsum(np.bincount(which)))), np.concatenate(([0], np.cumsum(self.size)))
        which, owner, ends, at = self.index
        own = which[at[i] : at[i + 1]]
        n = ends[own + 1] - ends[own]
        met = owner[np.repeat(ends[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.bincount(met, minlength=len(self.sets))[j]

    def edges(self) -> Iterator[tuple[int, int]]:
        for i in range(len(self.node) - 1):
            j = self.worth(i)
            if not len(j):
                continue
            same = self.shared(i, j)
            for x in j[100 * same >= self.percent * (self.size[i] + self.size[j] - same)].tolist():
                if self.root[x] != self.root[i]:
                    self.root[self.root == self.root[x]] = self.root[i]
                    yield int(self.node[i]), int(self.node[x])


def _groups(percent: int, most: int):
    """Rows (bucket, i, j, block, node, root, members, bits, keys) sorted by the first three: edges of each group's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> pa.RecordBatch:
            found = list(_Group(current[0], held, percent, most).edges()) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            heads = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            columns = [batch.column(c).to_pylist() for c in range(3, 9)]
            for head, row in zip(heads, zip(*columns, strict=True), strict=True):
                if head != current:
                    if len(held) > 1:
                        yield done()
                    current, held = head, []
                held.append(row)
        if held:
            yield done()

    return run


def _confirm(percent: int):
    """Rows (centre, part, node, members) sorted so that a centre's own set comes first in each part: those whose sets are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            members = batch.column(3)
            for i, (centre, part, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                other = np.frombuffer(members[i].as_buffer(), np.uint64)
                if node is None:
                    at, own = (centre, part), other.copy()
                    continue
                if at != (centre, part):
                    raise RuntimeError(f"the set of centre {centre} is missing")
                place = np.searchsorted(own, other)
                place[place == len(own)] = 0
                same = int((own[place] == other).sum())
                if 100 * same >= percent * (len(own) + len(other) - same):
                    a.append(centre)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(candidates: DataFrame, sets: DataFrame, percent: int, star: int = STAR) -> DataFrame:
    """The candidates (centre, node) whose sets (node, members) have the similarity, as a, b. A centre's candidates are dealt `star` to a part, by hash, each with the
    centre's set."""
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = candidates.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / star).cast("int").alias("parts"))
    dealt = candidates.join(parts, "centre").select("centre", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")
    heads = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = heads.join(sets.withColumnRenamed("node", "centre"), "centre").select("centre", "part", F.lit(None).cast("long").alias("node"), "members")
    rows = rows.unionByName(dealt.join(sets, "node").select("centre", "part", "node", "members"))
    placed = rows.repartition(n, "centre", "part").sortWithinPartitions("centre", "part", F.col("node").asc_nulls_first())
    return placed.mapInArrow(_confirm(percent), "a long, b long")


def _links(docs: DataFrame, nodes: DataFrame, store: Store, words: int, percent: int, shape: tuple[int, int], key: str, text: str, also: DataFrame | None) -> DataFrame:
    """node and root of every node that is linked with a smaller one. shape: bands and their rows; also: more candidates (centre, node)."""
    most = budget(percent, min(BITS, shape[0] * shape[1]))
    near = f"100 * least(n_shingles, n) >= {percent} * greatest(n_shingles, n)"
    alike = f"bit_count(b0 ^ c0) + bit_count(b1 ^ c1) <= {most}"
    of_centre = [F.col("n_shingles").alias("n"), F.col("b0").alias("c0"), F.col("b1").alias("c1")]

    placed = nodes.select(F.explode("keys").alias("bucket"), "node")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = store.keep(placed.join(sizes, "bucket"), "members")
    neighbours = members.groupBy("node").agg(F.sum("size").alias("neighbours"))
    shared = store.keep(members.join(neighbours.join(nodes.select("node", "n_shingles", "b0", "b1"), "node"), "node"), "buckets")

    order = F.struct("neighbours", (-F.col("node")).alias("low"), "n_shingles", "b0", "b1")
    centres = shared.groupBy("bucket").agg(F.max(order).alias("c")).select("bucket", (-F.col("c.low")).alias("centre"), F.col("c.neighbours").alias("weight"), *[F.col(f"c.{x}").alias(y) for x, y in (("n_shingles", "n"), ("b0", "c0"), ("b1", "c1"))])
    stars = shared.join(centres, "bucket").filter(f"node != centre AND {near} AND {alike}")
    candidates = stars.groupBy("node").agg(F.max(F.struct("weight", (-F.col("centre")).alias("low"))).alias("c")).select((-F.col("c.low")).alias("centre"), "node")
    wanted = neighbours.select("node")
    if also is not None:
        size = nodes.select(F.col("node").alias("centre"), *of_centre)
        also = store.keep(also.join(nodes.select("node", "n_shingles", "b0", "b1"), "node").join(size, "centre").filter(f"node != centre AND {near} AND {alike}").select("centre", "node").distinct(), "also")
        candidates = candidates.unionByName(also).distinct()
        wanted = wanted.unionByName(also.select("node")).unionByName(also.select(F.col("centre").alias("node"))).distinct()

    wanted = wanted.join(nodes.select("node", "rep"), "node").select("node", F.col("rep.none").alias("none"), F.col("rep.k").alias("k"), F.col("rep.h").alias("h"))
    rows = docs.select(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sets = store.keep(_members(rows.join(wanted, ["none", "k", "h"]).select("node", "text"), words, *shape).dropDuplicates(["node"]), "sets")

    links = store.keep(confirmed(store.keep(candidates, "candidates"), sets.select("node", "members"), percent), "links")
    roots = store.keep(connected_components(links), "roots")
    tied = shared.select("bucket", "node", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks")
    apart = tied.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), blocks).filter("x != y").select("bucket", "blocks")
    rest = tied.join(apart, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    dealt = rest.select("bucket", F.explode(pairs).alias("p"), "block", "node", "root").join(sets, "node")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.select("bucket", "p.i", "p.j", "block", "node", "root", "members", "bits", "keys").repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    more = store.keep(placed.mapInArrow(_groups(percent, most), "a long, b long"), "links")
    return roots if more.isEmpty() else store.keep(connected_components(links.unionByName(more)), "roots")


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text", groups: DataFrame | None = None
) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null for an empty set), component and component_id (the smallest doc_id reachable) of every row: texts are linked if
    100 * shared shingles >= percent * all shingles of both.

    A text with fewer words than a shingle has one; a null text, or one without words, has none and is linked with nothing: its component_id is its own id. A
    null id takes part but is no smallest id unless its class has no other. Repeated rows share a class; other columns are ignored. An empty table gives no
    rows. Two different texts just at the similarity share none of 32 bands of 5 with odds of 3 in a million, so less the nearer they are; links
    are exact but for equal 64-bit hashes of different shingles. groups: classes of another operator (doc_id, text_hash, component) whose members are candidates too."""
    store = Store(docs.sparkSession)
    own, (key, text) = plain(docs, key, text)
    signed = Store(docs.sparkSession).keep(sign(own, words, percent, bands, rows, key=key, text=text), "signed")  # stays: the result reads it
    rep = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("text_hash").alias("h"))
    nodes = store.keep(signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(rep).alias("rep"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n_shingles", "b0", "b1", "keys")]), "nodes")
    also = None
    if groups is not None:
        place = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), F.col("text_hash").alias("h")]
        known = groups.select(*place, F.col("component").alias("group")).distinct().join(signed.filter("node IS NOT NULL").select(*place, "node").distinct(), ["none", "k", "h"])
        known = store.keep(known.select("group", "node").distinct(), "groups")
        also = known.join(known.groupBy("group").agg(F.min("node").alias("centre")), "group").select("centre", "node")
    roots = _links(own, nodes, store, words, percent, (bands, rows), key, text, also)
    tied = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("component"))
    smallest = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = Store(docs.sparkSession).keep(tied.select("node", "component").join(smallest, "component"), "classes")
    store.clear()
    found = signed.drop("b0", "b1", "keys").join(classes, "node", "left")
    return found.select("doc_id", "text_hash", "n_shingles", "node", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, *, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs for one row of each class of near duplicates, as simhash.keep_first() chooses it; every text without words stays. SimHash groups over the same
    shingles are candidates beside the buckets; all links are confirmed on full sets. No column is added, so no name clashes; an empty table gives no rows."""
    shown = docs.columns
    docs, (key, text) = plain(docs, key, text)
    groups = simhash.near_duplicates(docs, words=words, key=key, text=text)
    found = near_duplicates(docs, words=words, percent=percent, key=key, text=text, groups=groups)
    return simhash.first_of_each(docs, found, key, text).toDF(*shown)

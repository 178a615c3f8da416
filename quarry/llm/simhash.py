"""SimHash fingerprints, and their near-duplicate classes by a binary-trie self-join.

A fingerprint has 64 bits; those with at most two differing bits are linked. Equal fingerprints are one class from the
start. Two linked fingerprints agree in at least two of their four 16-bit blocks, so every fingerprint goes, once for each of the six pairs
of blocks, to the group that has the same 32 bits there. The fingerprints of a group are a binary trie; it is joined
with itself from the root, pairs of nodes together: each step goes down one bit, a pair whose bits differ there spends one
of the budget of differing bits, and a pair over the budget is dropped with everything below it. All groups of a task's rows go down
together, one numpy pass for each bit. A group too large for a task is dealt again by more bits. A group's links are folded into a forest at once, so a task sends at most one edge for each
fingerprint, however dense the group; no link between classes is lost. The edges' components are found by stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage, plain
from quarry.llm.components import connected_components

SHINGLE = 3
SEED = 42
BUDGET = 2
_PART = 1 << 16  # shingles whose bits are counted at once
_PAIRS = 1 << 19  # node pairs that go down together
_ROWS = 1 << 18  # rows of whole groups that are joined together
MOST = 1 << 18  # fingerprints of one group that a task holds


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the hashes of the shingles, repeats included. Fewer words than a shingle has
    are one shingle; no word (or null) gives 0."""
    from xxhash import xxh64_digest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not found:
        return 0
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(found))
    a, b = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(a), _PART):
        hashes = b"".join([xxh64_digest(line[x:y], seed) for x, y in zip(a[i : i + _PART], b[i : i + _PART], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(a)).tobytes(), "big")


def trie_links(fingerprints: np.ndarray, groups: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each row the first row that it reaches by links within its group. `groups`: starts of the groups and the end; a group's
    fingerprints are different and ascending."""
    n = len(fingerprints)
    root = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def count(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fingerprints >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return ones[bit]

    lo, hi = groups[:-1], groups[1:]
    several = hi - lo > 1
    # A stack of bundles of node pairs: bit to go down next, both nodes as ranges of rows, bits spent.
    stack = [(63, lo[several], hi[several], lo[several], hi[several], np.zeros(several.sum(), np.int8))]
    while stack:
        bit, al, ah, bl, bh, spent = stack.pop()
        if len(al) > _PAIRS:
            for i in range(0, len(al), _PAIRS):
                stack.append((bit, *(x[i : i + _PAIRS] for x in (al, ah, bl, bh, spent))))
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = (i != j) & (np.bitwise_count(fingerprints[i] ^ fingerprints[j]) <= budget)
            _fold(root, i[near], j[near])
            rest = ~single
            al, ah, bl, bh, spent = al[rest], ah[rest], bl[rest], bh[rest], spent[rest]
        if not len(al) or bit < 0:
            continue
        c = count(bit)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl
        down = (  # the four pairs of children; a node with itself has one mixed pair
            (al, am, bl, bm, spent),
            (am, ah, bm, bh, spent),
            (al, am, bm, bh, spent + 1),
            (am[~same], ah[~same], bl[~same], bm[~same], spent[~same] + 1),
        )
        parts = []
        for a, b, x, y, s in down:
            alive = (b > a) & (y > x) & (s <= budget) & ~((a == x) & (b - a == 1))
            parts.append([z[alive] for z in (a, b, x, y, s)])
        stack.append((bit - 1, *(np.concatenate(z) for z in zip(*parts, strict=True))))
    return root


def _fold(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j, each to the smaller root; every entry points at its root again after."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _edges(most: int):
    """Rows (group, fingerprint) sorted by both; edges of each group's forest, `group` null. A group of more than `most` fingerprints goes out
    as it came, with its number, so no task holds more than that (all of it where `most` is 0)."""

    def join(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        bounds = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
        root = trie_links(fp, bounds)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return _turned(pa.nulls(len(tied), pa.int64()), fp[tied], fp[root[tied]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held, large = 0, None
        for batch in batches:
            # Spark orders signed numbers; within a group the sign bit is the first to go down, so it is turned here and there.
            group, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            if large is not None:
                end = int(np.searchsorted(group, large, "right")) if len(group) and group[0] == large else 0
                if end:
                    yield _turned(pa.array(group[:end]), fp[:end], fp[:end])
                    group, fp = group[end:], fp[end:]
                if not len(group):
                    continue
                large = None
            kept.append((group, fp))
            held += len(group)
            if held >= _ROWS:
                group, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
                last = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if last:
                    yield join(group[:last], fp[:last])
                kept, held = [(group[last:], fp[last:])], len(group) - last
                if most and held > most:
                    large = group[-1]
                    yield _turned(pa.array(group[last:]), fp[last:], fp[last:])
                    kept, held = [], 0
        if held:
            yield join(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def _turned(group: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    sign = np.uint64(1 << 63)
    return pa.RecordBatch.from_arrays([group, *(pa.array((x ^ sign).view(np.int64)) for x in (a, b))], ["group", "a", "b"])


def fingerprints(docs: DataFrame, *, words: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's 64 bits as a signed long) of every whole text, over shingles of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    docs, (key, text) = plain(docs, key, text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """Edges a, b between different fingerprints that tie all that are linked; `classes` has a row for each fingerprint (fp). A group of more than
    `most` is dealt again, by three parts of the bits that its fingerprints may differ in: linked ones have one of the parts in common,
    and what then remains free are 22 bits at most, so no group grows with the table."""
    blocks = [F.shiftright("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    groups = F.array(*(F.lit(n << 32).bitwiseOR(F.shiftleft(blocks[i], 16)).bitwiseOR(blocks[j]) for n, (i, j) in enumerate(pairs)))
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = classes.select(F.explode(groups).alias("group"), "fp").repartition(n, "group").sortWithinPartitions("group", "fp")
    found = cut_lineage(placed.mapInArrow(_edges(most), "group long, a long, b long"))
    # Of a large group the two free blocks, as 32 bits, and the three parts of those.
    free = F.lit(None)
    for number, own in enumerate(pairs):
        x, y = (i for i in range(4) if i not in own)
        free = F.when(F.shiftright("group", 32) == number, F.shiftleft(blocks[x], 16).bitwiseOR(blocks[y])).otherwise(free)
    parts = [F.shiftright("free", at).bitwiseAND((1 << bits) - 1) for at, bits in ((21, 11), (10, 11), (0, 10))]
    again = found.filter("group IS NOT NULL").select("group", F.col("a").alias("fp")).withColumn("free", free)
    # group has 35 bits, a part 11 and its number 2
    dealt = again.select(F.explode(F.array(*(F.shiftleft("group", 13).bitwiseOR(F.lit(k << 11)).bitwiseOR(p) for k, p in enumerate(parts)))).alias("group"), "fp")
    small = dealt.repartition(n, "group").sortWithinPartitions("group", "fp").mapInArrow(_edges(0), "group long, a long, b long")
    return found.filter("group IS NULL").select("a", "b").unionByName(small.select("a", "b"))


def near_duplicates(docs: DataFrame, *, words: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component (a fingerprint that stands for the class) and component_id (the smallest doc_id reachable), a row for
    each row. A null text has no words; texts without words share fingerprint 0. A null key takes part but is no
    smallest id unless its class has no other. Repeated rows share a class. Empty tables give no rows."""
    printed = cut_lineage(fingerprints(docs, words=words, key=key, text=text))
    classes = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes.select("fp")))
    tied = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component"))
    smallest = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = tied.select("fp", "component").join(smallest, "component")
    return printed.join(of_class, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs for one row of each near-duplicate class: the smallest key's (of equal keys that of the least text
    hash; a null key only if there is no other; of repeated rows one). No column is added, so no name clashes. A null text has no words; an
    empty table gives no rows."""
    shown = docs.columns
    docs, (key, text) = plain(docs, key, text)
    return first_of_each(docs, near_duplicates(docs, key=key, text=text), key, text).toDF(*shown)


def first_of_each(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs (columns named by plain()) that keep_first() keeps, for found classes: doc_id, text_hash and component; a null component is of one row alone."""
    # A null key is told from every other by a flag, so no value stands for it.
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("text_hash").alias("h"))
    first = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(own).alias("f"))
    alone = found.filter("component IS NULL").select(own.alias("f"))
    stay = first.select("f").unionByName(alone).select("f.none", "f.k", "f.h").distinct()
    rows = docs.withColumns({"none": F.col(key).isNull(), "k": F.coalesce(F.col(key).cast("long"), F.lit(0)), "h": F.xxhash64(text)})
    return rows.join(stay, ["none", "k", "h"], "left_semi").dropDuplicates(["none", "k", "h"]).drop("none", "k", "h")

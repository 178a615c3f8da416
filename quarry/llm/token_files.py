"""Token-id files of patched frame-of-reference blocks.

A file is one segment: whole documents in ascending order of id, closed at the first document that reaches
SEGMENT_IDS ids. A document longer than that makes a longer segment. Layout, big-endian:

    "PFOR" | partition u32 | segment u32 | documents u32 | ids u64 | four columns | line feed

The columns (has-id flags, document ids, ids per document, ids) are PFOR columns with a u64 length before each.
A PFOR column has its values in blocks of 128: each block's minimum is subtracted, and the rest is packed at the
width that PERCENTILE of the block's values need. A value that needs more bits is an exception: its low bits are
packed, its place in the block and its high bits stand in an exception list. An index holds each block's minimum,
width, start in the payload and count of exceptions, so that a block can be read alone.

Spark's text writer writes the files (its commit protocol keeps the result whole when a task is repeated; the
line feed is its row end) and its binaryFile source reads them, so the folder can be in any store that Spark reaches.
A manifest (parquet) holds each segment's counts and the ids before it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import plain
from quarry.llm.encoding import encoder

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 20
WORDS_KEPT = 900_000  # per worker
_HEAD = struct.Struct(">4sIIIQ")
_COLUMN = struct.Struct(">QQB")
_CHUNK = 1024  # blocks packed at once


def _weave(diff: np.ndarray, w: int) -> np.ndarray:
    """Bytes of rows of BLOCK values of w bits each; eight values take w bytes."""
    v = diff.reshape(-1, 8)
    words = np.zeros((len(v), -(-w // 8)), np.uint64)
    for j in range(8):
        q, r = divmod(j * w, 64)
        words[:, q] |= v[:, j] << np.uint64(r)
        if r + w > 64:
            words[:, q + 1] |= v[:, j] >> np.uint64(64 - r)
    return words.astype("<u8", copy=False).view(np.uint8)[:, :w].reshape(len(diff), -1)


def _unweave(packed: np.ndarray, w: int) -> np.ndarray:
    rows, n = packed.reshape(-1, w), -(-w // 8)
    words = np.zeros((len(rows), 8 * n), np.uint8)
    words[:, :w] = rows
    words = words.view("<u8")
    v = np.empty((len(rows), 8), np.uint64)
    mask = np.uint64(2**w - 1)
    for j in range(8):
        q, r = divmod(j * w, 64)
        x = words[:, q] >> np.uint64(r)
        if r + w > 64:
            x |= words[:, q + 1] << np.uint64(64 - r)
        v[:, j] = x & mask
    return v.reshape(len(packed), BLOCK)


def pfor_pack(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A PFOR column of 64-bit integers."""
    values = np.asarray(values, np.int64)
    n = len(values)
    nb = -(-n // BLOCK)
    if not n:
        return _COLUMN.pack(0, 0, 0)
    grid = np.concatenate((values, np.full(nb * BLOCK - n, values[-1], np.int64))).reshape(nb, BLOCK)
    low = grid.min(axis=1)
    diff = grid.view(np.uint64) - low.view(np.uint64)[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = _bits(np.partition(diff, at, axis=1)[:, at])
    mask = np.where(width == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(width, 63).astype(np.uint64)) - np.uint64(1))[:, None]
    out = diff > mask
    high = (diff >> np.minimum(width, 63).astype(np.uint64)[:, None])[out]
    size = next(k for k in (1, 2, 4, 8) if not len(high) or int(high.max()) < 1 << 8 * k)
    diff &= mask
    start = np.zeros(nb + 1, np.int64)
    np.cumsum(width.astype(np.int64) * (BLOCK // 8), out=start[1:])
    payload = np.zeros(start[-1], np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w) if w else []
        for i in range(0, len(rows), _CHUNK):
            r = rows[i : i + _CHUNK]
            payload[start[r][:, None] + np.arange(int(w) * BLOCK // 8)] = _weave(diff[r], int(w))
    return b"".join((_COLUMN.pack(n, len(high), size), low.astype(">i8").tobytes(), width.tobytes(), start.astype(">u8").tobytes(), out.sum(axis=1).astype(np.uint8).tobytes(), np.nonzero(out)[1].astype(np.uint8).tobytes(), high.astype(f">u{size}").tobytes(), payload.tobytes()))


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs, exactly."""
    out = np.zeros(len(x), np.uint8)
    x = x.copy()
    for k in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1 << k)
        out[big] += k
        x[big] >>= np.uint64(k)
    return out + (x > 0).astype(np.uint8)


def pfor_unpack(data: bytes, blocks: tuple[int, int] | None = None) -> np.ndarray:
    """The values, or those of blocks [first, end) alone."""
    n, exceptions, size = _COLUMN.unpack_from(data)
    nb, at = -(-n // BLOCK), _COLUMN.size
    if not n:
        return np.zeros(0, np.int64)
    low = np.frombuffer(data, ">i8", nb, at).astype(np.int64)
    width = np.frombuffer(data, np.uint8, nb, at := at + 8 * nb)
    start = np.frombuffer(data, ">u8", nb + 1, at := at + nb).astype(np.int64)
    each = np.frombuffer(data, np.uint8, nb, at := at + 8 * (nb + 1))
    place = np.frombuffer(data, np.uint8, exceptions, at := at + nb)
    high = np.frombuffer(data, f">u{size or 1}", exceptions, at := at + exceptions)
    payload = np.frombuffer(data, np.uint8, start[-1], at + exceptions * (size or 1))
    a, b = blocks or (0, nb)
    diff = np.zeros((b - a, BLOCK), np.uint64)
    for w in np.unique(width[a:b]):
        rows = np.flatnonzero(width[a:b] == w) if w else []
        for i in range(0, len(rows), _CHUNK):
            r = rows[i : i + _CHUNK]
            diff[r] = _unweave(payload[start[a + r][:, None] + np.arange(int(w) * BLOCK // 8)], int(w))
    block = np.repeat(np.arange(nb), each)
    own = (block >= a) & (block < b)
    diff[block[own] - a, place[own]] |= high[own].astype(np.uint64) << width[block[own]].astype(np.uint64)
    return (diff + low[a:b].view(np.uint64)[:, None]).view(np.int64).ravel()[: min(n, b * BLOCK) - a * BLOCK]


def pack_segment(partition: int, segment: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    counts = np.array([len(x) // 4 for x in ids], np.int64)
    columns = [pfor_pack(np.array([x is not None for x in doc_ids], np.int64)), pfor_pack(np.array([x or 0 for x in doc_ids], np.int64)), pfor_pack(counts), pfor_pack(np.frombuffer(b"".join(ids), "<u4").astype(np.int64))]
    return _HEAD.pack(b"PFOR", partition, segment, len(ids), int(counts.sum())) + b"".join(struct.pack(">Q", len(c)) + c for c in columns)


def unpack_segment(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """(partition, segment, document ids, ids per document, ids)."""
    magic, partition, segment, _, _ = _HEAD.unpack_from(data)
    if magic != b"PFOR":
        raise ValueError("not a token file")
    at, columns, view = _HEAD.size, [], memoryview(data)
    for _ in range(4):
        (size,) = struct.unpack_from(">Q", data, at)
        columns.append(pfor_unpack(view[at + 8 : at + 8 + size]))
        at += 8 + size
    has, doc_ids, counts, ids = columns
    return partition, segment, [int(d) if h else None for h, d in zip(has, doc_ids, strict=True)], counts, ids


def _segments(path: str, end_id: int):
    end = struct.pack("<I", end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, segment, doc_ids, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        encode = encoder(path, WORDS_KEPT).encode
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = encode(text.as_py()) + end
                doc_ids.append(key)
                ids.append(x)
                held += len(x) // 4
                if held >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_segment(partition, segment, doc_ids, ids)], pa.binary())], ["value"])
                    segment, doc_ids, ids, held = segment + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack_segment(partition, segment, doc_ids, ids)], pa.binary())], ["value"])

    return pack


def _header(first: int, size: int) -> Column:
    """An unsigned number of the header, read without Python."""
    return F.conv(F.hex(F.substring("content", first + 1, size)), 16, 10).cast("long")


def write_token_files(docs: DataFrame, out_dir: str, path: str, *, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text and writes `out_dir`/data (the files, in ascending order of the key) and
    `out_dir`/manifest. Equal keys are ordered by text, null keys come first, null texts count as empty, and other
    columns are ignored. An empty table makes no segment. One range exchange of the texts (by the start of the text too, so that rows with
    one key, or none, don't all go to one task); ids are never shuffled."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs, (key, text) = plain(docs, key, text)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("key"), F.substring("text", 1, 32)).sortWithinPartitions("key", "text")
    packed = ordered.mapInArrow(_segments(path, end_id), "value binary")
    packed.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{out_dir}/data")
    heads = _files(spark, out_dir).select(_header(4, 4).alias("partition"), _header(8, 4).alias("segment"), _header(12, 4).alias("n_docs"), _header(16, 8).alias("n_ids"))
    # Totals of partitions first, so that the one running sum over all is over as many rows as tasks wrote.
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("partition").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = heads.groupBy("partition").agg(F.sum("n_ids").alias("total")).select("partition", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    starts = heads.join(bases, "partition").withColumn("start", F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    starts.drop("base").write.parquet(f"{out_dir}/manifest")


def _files(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out_dir}/data").filter("length > 24")


def _documents(derive: tuple[tuple[str, str, Callable[[memoryview], int]], ...]):
    names = ["partition", "segment", "doc_id", "ahead", "n_tokens", *([n for n, _, _ in derive] or ["ids"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                partition, segment, doc_ids, counts, ids = unpack_segment(content.as_buffer())
                ends = np.cumsum(counts)
                raw, n = ids.astype("<u4").tobytes(), len(doc_ids)
                arrays = [pa.array(np.full(n, partition, np.int64)), pa.array(np.full(n, segment, np.int64)), pa.array(doc_ids, pa.int64()), pa.array(ends - counts), pa.array(counts)]
                if derive:
                    view, bounds = memoryview(raw), [0, *(ends * 4).tolist()]
                    for _, _, f in derive:
                        arrays.append(pa.array([f(view[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]))
                else:
                    offsets = pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32).tobytes())
                    arrays.append(pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(raw)]))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def read_token_files(spark: SparkSession, out_dir: str, derive: tuple[tuple[str, str, Callable[[memoryview], int]], ...] = ()) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the
    files. derive: (name, type, function of a document's ids) for columns made where the ids are read, in place of the ids. The manifest has
    a row for each segment; Spark broadcasts it only under its own size threshold."""
    made = ", ".join(f"{n} {t}" for n, t, _ in derive) or "ids binary"
    docs = _files(spark, out_dir).select("content").mapInArrow(_documents(derive), f"partition long, segment long, doc_id long, ahead long, n_tokens long, {made}")
    manifest = spark.read.parquet(f"{out_dir}/manifest").select("partition", "segment", F.col("start").alias("base"))
    return docs.join(manifest, ["partition", "segment"]).select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", *([n for n, _, _ in derive] or ["ids"]))

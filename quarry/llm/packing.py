"""Vector bin packing of training examples by the dot-product heuristic.

An example makes demands in several dimensions at once: tokens, one segment, loss-bearing tokens. One sequence is
filled at a time: of the waiting pieces that fit into all that is left of it, the one with the greatest weighted dot
product of its demand and the room left comes next, the earliest of equals. Weights are the mean demands over the
room, so that the scarce dimension counts most.

Texts are encoded and packed in one pass without a shuffle: a task holds at most WINDOW waiting pieces, and packs them
when so many wait or its rows end. What a task has packed depends on its own rows alone, so that a repeated task gives
the same result; sequence ids carry the task's number.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import plain
from quarry.llm.encoding import encoder

WINDOW = 4096  # waiting pieces that a task packs together
WORDS_KEPT = 300_000  # per worker


def fill(demand: np.ndarray, room: np.ndarray) -> list[list[int]]:
    """Sequences as lists of rows of `demand` (pieces x dimensions), each within `room`. Every piece must fit alone."""
    demand = np.asarray(demand, np.float64)
    room = np.asarray(room, np.float64)
    if (demand > room).any():
        raise ValueError("a piece exceeds the limits of a sequence")
    n = len(demand)
    if not n:
        return []
    share = demand / room
    weighted = share * share.mean(axis=0)
    # Descending by the first dimension: what fits into the room left is a suffix of it.
    order = np.lexsort((np.arange(n), -demand[:, 0]))
    d, s, w = demand[order], share[order], weighted[order]
    down, waiting, left = -d[:, 0], np.ones(n, bool), n
    columns = np.ascontiguousarray(d.T)
    out = []
    while left:
        free, rest, own = room.copy(), np.ones(len(room)), []
        lo = 0
        while True:
            lo = max(lo, int(np.searchsorted(down, -free[0], "left")))
            fits = waiting[lo:].copy()
            for j in range(1, len(room)):
                fits &= columns[j][lo:] <= free[j]
            score = np.where(fits, w[lo:] @ rest, -1.0)
            k = lo + int(score.argmax()) if len(score) else n
            if k >= n or score[k - lo] < 0:
                break
            own.append(int(order[k]))
            waiting[k] = False
            left -= 1
            free = free - d[k]
            rest = rest - s[k]
            if free[0] <= 0:
                break
        if left * 2 < n:
            order, d, s, w, down = order[waiting], d[waiting], s[waiting], w[waiting], down[waiting]
            columns, waiting, n = np.ascontiguousarray(d.T), np.ones(left, bool), left
        out.append(own)
    return out


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, segments long, loss_tokens long, sequence_id long, offset long"


def _packer(encode_rows: Callable[[pa.RecordBatch], Iterator[tuple[int | None, bytes, np.ndarray | None]]], max_tokens: int, max_segments: int, max_loss: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        made, waiting = 0, []
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        types = [pa.binary() if x.split()[1] == "binary" else pa.int64() for x in _SCHEMA.split(", ")]

        def emit() -> pa.RecordBatch:
            nonlocal made, waiting
            demand = np.array([(len(ids) // 4, 1, loss) for _, _, ids, _, loss in waiting], np.int64).reshape(-1, 3)
            rows = []
            for own in fill(demand, np.array([max_tokens, max_segments, max_loss])):
                offset = 0
                for k in own:
                    doc_id, start, ids, total, loss = waiting[k]
                    rows.append((doc_id, start, len(ids) // 4, ids, total, 1, loss, base + made, offset))
                    offset += len(ids) // 4
                made += 1
            waiting = []
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for doc_id, ids, loss in encode_rows(batch):
                total, start = len(ids) // 4, 0
                for start, end in pieces(total, loss, max_tokens, max_loss):
                    waiting.append((doc_id, start, ids[4 * start : 4 * end], total, int(end - start if loss is None else loss[start:end].sum())))
                    if len(waiting) >= WINDOW:
                        yield emit()
        if waiting:
            yield emit()

    return pack


def pieces(total: int, loss: np.ndarray | None, max_tokens: int, max_loss: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of an example of `total` ids; loss: 1 for a loss-bearing id (none given: all are).
    Cut at the last id before a limit, so every id lies in exactly one piece."""
    most = min(max_tokens, max_loss) if loss is None else max_tokens
    before = None if loss is None else np.concatenate(([0], np.cumsum(loss)))
    start = 0
    while start < total:
        end = min(total, start + most)
        if before is not None:
            end = min(end, int(np.searchsorted(before, before[start] + max_loss, "right")) - 1)
        yield start, end
        start = end


def pack_documents(docs: DataFrame, path: str, *, end_id: int, max_tokens: int = 2048, max_segments: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text, encoded, closed with `end_id`, cut at the limits and packed. A row for each piece: doc_id, start (the
    document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens, segments, loss_tokens (all ids
    bear loss), sequence_id, offset (place in the sequence; gapless from 0).

    A null text counts as empty (its end id alone), null and repeated keys are kept as they are, other columns are
    ignored, an empty table gives no rows."""
    end = struct.pack("<I", end_id)

    def rows(batch):
        encode = encoder(path, WORDS_KEPT).encode
        for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield doc_id, encode(t.as_py()) + end, None

    docs, (key, text) = plain(docs, key, text)
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(_packer(rows, max_tokens, max_segments, max_tokens), _SCHEMA)


def pack_examples(examples: DataFrame, path: str, *, end_id: int, max_tokens: int = 2048, max_segments: int = 16, max_loss: int = 1536, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Instruction data: columns conv_id and turns (array of structs role, text, in order). Each turn is encoded and closed with
    `end_id`; the ids of turns of `loss_roles` bear loss. Same columns as pack_documents, doc_id holding conv_id.
    Null turns, roles and texts count as empty ones that bear no loss; an example without turns gives no row. Other columns are ignored,
    null and repeated ids are kept, an empty table gives no rows."""
    end = struct.pack("<I", end_id)

    def rows(batch):
        encode = encoder(path, WORDS_KEPT).encode
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids, marks = [], []
            for turn in turns.as_py() or []:
                x = encode((turn or {}).get("text")) + end
                ids.append(x)
                marks.append(np.full(len(x) // 4, (turn or {}).get("role") in loss_roles, np.int64))
            if ids:
                yield conv_id, b"".join(ids), np.concatenate(marks)

    examples, (key, turns) = plain(examples, "conv_id", "turns")
    chosen = examples.select(F.col(key).cast("long"), F.col(turns))
    return chosen.mapInArrow(_packer(rows, max_tokens, max_segments, max_loss), _SCHEMA)

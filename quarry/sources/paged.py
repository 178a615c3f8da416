"""Paged remote catalogues as a Spark data source: a partition for each page (for a run of pages, where there are more than PARTITIONS), filters that the service understands pushed to
it, and offsets to go on from.

A transport is what talks to the service. It is named by an importable path (`package.module:Class`) and made in each task from the source's options, so
clients and connections are never sent. Register the source once for each session with register().

    spark.read.format("paged").option("transport", "my.client:Catalogue").option("page_size", 100).load().filter("year >= 2020")
    spark.readStream.format("paged").option("transport", ...).option("pages_per_batch", 10).load()
"""

from __future__ import annotations

import importlib
import json
import os
import time
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, islice
from typing import Protocol
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

PARTITIONS = 512  # most partitions of a scan or micro-batch; more pages share them, in runs
MOST_PAGES = 4096  # of a micro-batch that has grown
BLOCK = 1024  # lines of a block that is read at once
BLOCKS = "_blocks"  # the folder of a table of blocks, beside the lines

#: How a filter is called in a request.
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Transport(Protocol):
    """conditions: (column, sign, value) that all hold. Pages are numbered from 0 and mustn't change while a job reads them."""

    schema: str
    filters: dict[str, tuple[str, ...]]  # signs that the service understands, by column

    def __init__(self, options: dict): ...

    def count(self, conditions: list[tuple]) -> int: ...

    def page(self, number: int, size: int, conditions: list[tuple]) -> list[tuple]: ...


@dataclass
class Pages(InputPartition):
    first: int
    end: int


def runs(first: int, end: int) -> list[Pages]:
    """Pages from first to end, each alone or in PARTITIONS runs."""
    step = max(1, -(-(end - first) // PARTITIONS))
    return [Pages(i, min(i + step, end)) for i in range(first, end, step)]


def transport(options: dict) -> Transport:
    module, name = options["transport"].split(":")
    return getattr(importlib.import_module(module), name)(options)


def fetch(options: dict, number: int, conditions: list[tuple]) -> list[tuple]:
    """One page; after a failure the call is repeated, with a wait that doubles, `retries` times at most."""
    size, retries, wait = int(options.get("page_size", 100)), int(options.get("retries", 3)), float(options.get("wait", 0.5))
    for attempt in range(retries + 1):
        try:
            return transport(options).page(number, size, conditions)
        except (OSError, TimeoutError):
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.conditions = options, []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes what the service understands; the others come back and are Spark's."""
        known = transport(self.options).filters
        for f in filters:
            sign = _SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and sign in known.get(f.attribute[0], ()):
                self.conditions.append((f.attribute[0], sign, f.value))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        size = int(self.options.get("page_size", 100))
        return runs(0, -(-transport(self.options).count(self.conditions) // size))

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        if partition is not None:  # Spark asks so where there are no pages
            for number in range(partition.first, partition.end):
                yield from fetch(self.options, number, self.conditions)


class PagedStream(DataSourceStreamReader):
    """Offsets are full pages read; a last page that isn't full yet is left for later, unless the option `partial` is set. A micro-batch has `pages_per_batch` pages at most; with the
    option `growth` each one of a run may have so many times the pages of the one before, up to MOST_PAGES, so that a long catalogue needs few. A run that takes what there is now
    (availableNow) is one micro-batch; run_pages() goes on to the end."""

    def __init__(self, options: dict):
        self.options, self.last, self.step = options, None, int(options.get("pages_per_batch", 10))

    def initialOffset(self) -> dict:
        return {"page": int(self.options.get("from_page", 0))}

    def latestOffset(self) -> dict:
        size = int(self.options.get("page_size", 100))
        count = transport(self.options).count([])
        whole = -(-count // size) if self.options.get("partial") == "true" else count // size
        start = self.last if self.last is not None else self.initialOffset()["page"]
        self.last = max(start, min(whole, start + self.step))
        if self.last > start:
            self.step = max(self.step, min(MOST_PAGES, self.step * int(self.options.get("growth", 1))))
        return {"page": self.last}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.last = end["page"]  # after a restart the offsets come from the checkpoint
        return runs(start["page"], end["page"])

    def commit(self, end: dict) -> None:
        self.last = end["page"]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for number in range(partition.first, partition.end):
            yield from fetch(self.options, number, [])


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return transport(self.options).schema

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known and lets Spark push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def run_pages(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over a paged source, as one query of many micro-batches, until nothing is new; a repeated call goes on from the checkpoint."""
    query = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _files(path: str) -> tuple[tuple[str, int], ...]:
    """Files of lines in the order of their names, with their sizes."""
    return tuple((x, os.path.getsize(f"{path}/{x}")) for x in sorted(os.listdir(path)) if x.endswith(".json"))


def _blocks_of(path: str, name: str, by: tuple[str, ...]) -> Iterator[dict]:
    """Blocks of a file: where they start, bytes, rows, and of each column in `by` the least and greatest value and the number of nulls."""
    start = 0
    with open(f"{path}/{name}", "rb") as lines:
        while held := list(islice(lines, BLOCK)):
            rows = [json.loads(x) for x in held] if by else []
            values = {c: [r[c] for r in rows if r.get(c) is not None] for c in by}
            size = sum(map(len, held))
            yield {"file": name, "start": start, "size": size, "rows": len(held), "of": {c: [min(v, default=None), max(v, default=None), len(held) - len(v)] for c, v in values.items()}}
            start += size


def index_lines(spark: SparkSession, path: str, by: str = "") -> None:
    """Writes the table of blocks of a folder of JSON lines, each file by a task of its own. Columns in `by` are those that are filtered by."""
    at, columns = urlparse(path).path, tuple(c for c in by.split(",") if c)
    files = _files(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(b) for b in _blocks_of(at, name, columns)], pa.string())], ["value"])

    names = spark.createDataFrame([(x,) for x, _ in files], "file string").repartitionByRange(max(1, len(files)), "file")
    names.mapInArrow(run, "value string").write.mode("overwrite").text(f"{path}/{BLOCKS}")


@lru_cache(maxsize=8)
def _table(path: str, files: tuple, by: tuple[str, ...]) -> list[dict]:
    """Blocks of all files in order, once for each process: those that index_lines() wrote of these very files, else by reading them."""
    found: dict[str, list[dict]] = {}
    folder = f"{path}/{BLOCKS}"
    for f in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
        if f.endswith(".txt"):
            with open(f"{folder}/{f}", encoding="utf-8") as lines:
                for block in map(json.loads, lines):
                    found.setdefault(block["file"], []).append(block)
    out: list[dict] = []
    for name, size in files:
        own = sorted(found.get(name, []), key=lambda b: b["start"])
        known = own and sum(b["size"] for b in own) == size and all(c in own[0]["of"] for c in by)
        out += own if known else _blocks_of(path, name, by)
    return out


_HOLDS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def _read(path: str, block: dict, conditions: tuple) -> list[dict]:
    """The rows of a block that all conditions hold for."""
    with open(f"{path}/{block['file']}", "rb") as f:
        f.seek(block["start"])
        rows = [json.loads(x) for x in f.read(block["size"]).split(b"\n") if x]
    return [r for r in rows if all(r.get(c) is not None and _HOLDS[s](r[c], v) for c, s, v in conditions)]


@lru_cache(maxsize=64)
def _counted(path: str, files: tuple, by: tuple[str, ...], conditions: tuple) -> tuple[list[dict], list[int]]:
    """Blocks with a row that the conditions hold for, and the number of such rows up to each one's end. A block is read only if its ranges leave it open."""
    kept, sizes = [], []
    for block in _table(path, files, by):
        ranges = [(block["of"][c], s, v) for c, s, v in conditions]
        if any(low is None or (s in ("=", ">", ">=") and not _HOLDS[">=" if s == "=" else s](high, v)) or (s in ("=", "<", "<=") and not _HOLDS["<=" if s == "=" else s](low, v)) for (low, high, _), s, v in ranges):
            continue
        if all(nulls == 0 and _HOLDS[s](low, v) and _HOLDS[s](high, v) for (low, high, nulls), s, v in ranges):
            n = block["rows"]
        else:
            n = len(_read(path, block, conditions))
        if n:
            kept.append(block)
            sizes.append(n)
    return kept, list(accumulate(sizes))


class JsonLines:
    """A transport over a folder of JSON lines that all executors reach, in the order of file names: option `path`, `columns` (a Spark schema of integer, double and string columns)
    and `by` (the columns that it filters by). A page is read from the blocks that it lies in; index_lines() writes the table of blocks, which else each process makes by reading
    the folder once."""

    def __init__(self, options: dict):
        self.path, self.schema = urlparse(options["path"]).path, options["columns"]
        self.filters = {c: ("=", ">", ">=", "<", "<=") for c in options.get("by", "").split(",") if c}

    def _found(self, conditions: list[tuple]) -> tuple[list[dict], list[int]]:
        return _counted(self.path, _files(self.path), tuple(self.filters), tuple(conditions))

    def count(self, conditions: list[tuple]) -> int:
        return next(reversed(self._found(conditions)[1]), 0)

    def page(self, number: int, size: int, conditions: list[tuple]) -> list[tuple]:
        names = [c.split()[0] for c in self.schema.split(",")]
        blocks, ends = self._found(conditions)
        first, last, out = number * size, (number + 1) * size, []
        for i in range(bisect_right(ends, first), len(blocks)):
            before = ends[i - 1] if i else 0
            if before >= last:
                break
            own = _read(self.path, blocks[i], tuple(conditions))
            out += [tuple(r.get(c) for c in names) for r in own[max(0, first - before) : last - before]]
        return out

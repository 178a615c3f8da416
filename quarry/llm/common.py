"""What the corpus operators share: the documents table, the shared folder, and byte views of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a vectorised kernel takes at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to Python, about; a longer row goes alone.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on rows of this session reach Python in batches of about BATCH_BYTES, where the session sets no size of its own: Spark's 10,000 rows are tens of MB of
    text, which the JVM and each Python worker hold once or more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset, as in
    tests on one machine, a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = spark.sparkContext.getCheckpointDir()
        found = made or tempfile.mkdtemp(prefix="quarry-")
        if not made:
            spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of the application that is deleted when the driver's JVM ends; discard() deletes
    a path before that."""
    own = f"{shared_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}"
    fs, where = _file_system(spark, own)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that nothing reads any more."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later reads survive the loss of any executor, and it goes with the application."""
    return Store(df.sparkSession).keep(df, "cut")


class Store:
    """Tables written to the shared folder and read again, deleted when they are read no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self, but: int = 0) -> None:
        """Deletes all but the last few."""
        while len(self.paths) > but:
            discard(self.spark, self.paths.pop(0))


def plain(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, ... by place, and what `names` are called there. So no name of a caller's column, in whatever case
    and with whatever signs, can clash with a name that an operator uses. A name that several columns have but for their case is the one
    that is written exactly so."""
    found = []
    for name in names:
        same = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
        if len(same) != 1:
            raise ValueError(f"{len(same)} columns are called {name!r}")
        found.append(f"c{same[0]}")
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), found


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kept_columns(docs: DataFrame, results: list[str]) -> list[int]:
    """Places of the columns of docs that a result doesn't take the name of; Spark tells no names apart by case."""
    taken = {r.lower() for r in results}
    return [i for i, c in enumerate(docs.columns) if c.lower() not in taken]


def fields(df: DataFrame, own: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{quoted(c)} {types[c]}" for c in own)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy where Arrow allows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose texts have about `most` bytes together; each has one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def sums(values: np.ndarray, offsets: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i. A segment's sum depends on that segment alone."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=dtype)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Two primes below 2^31 and a base for each, of no special form.
_PRIMES = ((2147483647, 1288490189), (2147483629, 1622650073))
_POWERS: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _PRIMES]


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo its prime, and their inverses, grown on demand by doubling."""
    if n > len(_POWERS[which][0]):
        p, base = _PRIMES[which]
        grown = []
        for x, b in zip(_POWERS[which], (base, pow(base, -1, p)), strict=True):
            while len(x) < max(n, 1 << 16):
                x = np.concatenate((x, x * np.uint64(pow(b, len(x), p)) % np.uint64(p)))
            grown.append(x)
        _POWERS[which] = (grown[0], grown[1])
    return _POWERS[which][0][:n], _POWERS[which][1][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes wherever they stand: polynomials of the bytes modulo two primes. One pass
    over the bytes for each. Different spans of n bytes agree with odds of about (n / 2^31)^2; where that matters, compare them."""
    n = len(raw)
    out = np.zeros(len(starts), np.uint64)
    for which, (p, _) in enumerate(_PRIMES):
        prime = np.uint64(p)
        up, down = _powers(which, n + 1)
        terms = (raw.astype(np.uint64) + np.uint64(1)) * up[:n]  # below 2^40
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(terms if n < 1 << 23 else terms % prime, out=total[1:])
        out = (out << np.uint64(31)) ^ ((total[ends] - total[starts]) % prime * down[starts] % prime)
    return mix(out ^ mix((ends - starts).astype(np.uint64)))


def same_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw[a:a+size] equals raw[b:b+size], for each."""
    out = np.ones(len(size), bool)
    for i, j in slices(np.concatenate(([0], np.cumsum(size)))):
        n = size[i:j]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unlike = raw[np.repeat(a[i:j], n) + within] != raw[np.repeat(b[i:j], n) + within]
        out[i:j] = sums(unlike, np.concatenate(([0], np.cumsum(n)))) == 0
    return out


#: ASCII white space as the word patterns take it: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each text, and the row of each word."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(ink & (first | ~np.concatenate(([False], ink[:-1]))))
    last = np.zeros(len(raw), bool)
    last[:-1] = first[1:]
    last[-1] = True
    ends = np.flatnonzero(ink & (last | ~np.concatenate((ink[1:], [False])))) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows

"""Tables in hash buckets, of which a change rewrites those it touches.

Layout under root/name: `data/<id>/_bucket=B/` has rows of bucket B as one change wrote them, `manifest/vN` names the folder of every bucket in version N. A change
reads and writes the buckets of its keys alone and publishes a manifest that takes the others from the version before; the write of the manifest is the one moment
at which readers see it, and of two writers the second finds it there and fails. Earlier versions stay readable until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import storage

BUCKET = "_bucket"


class BucketedTable:
    """One table by its key. `buckets` and `by` (the bucket of a key, by default its hash) hold for the table's life; a bucket's rows are written by one task, so
    take as many as leave some hundred MB in each. Rows with a null key share a bucket."""

    def __init__(self, spark: SparkSession, root: str, name: str, key: str, buckets: int = 256, by: Callable[[Column], Column] | None = None):
        self.spark, self.root, self.key, self.buckets = spark, f"{root.rstrip('/')}/{name}", key, buckets
        self.by = by or (lambda c: F.xxhash64(c))
        self._known: dict[int, list] = {}  # manifests, which never change

    # ---- versions

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Published versions; a manifest without its mark of success was never published."""
        found = [n for n in self._names(f"{self.root}/manifest") if n.startswith("v")]
        return sorted(int(n[1:]) for n in found if "_SUCCESS" in self._names(f"{self.root}/manifest/{n}"))

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows: one row for each bucket, whatever the table's size."""
        return {r.bucket: r.path for r in self._manifest(version) if r.bucket >= 0}

    def _manifest(self, version: int | None) -> list:
        if version not in self._known:
            known = self.versions()
            if not known or (version is not None and version not in known):
                raise KeyError(f"{self.root}: version {version}")
            version = known[-1] if version is None else version
            if version not in self._known:
                self._known[version] = self.spark.read.schema("bucket int, path string").parquet(f"{self.root}/manifest/v{version}").collect()
        return self._known[version]

    def _schema(self, version: int | None = None) -> StructType:
        return next(StructType.fromJson(json.loads(r.path)) for r in self._manifest(version) if r.bucket < 0)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets."""
        rows = self._manifest(version)
        schema = next(StructType.fromJson(json.loads(r.path)) for r in rows if r.bucket < 0)
        wanted = None if buckets is None else set(buckets)
        paths = sorted(r.path for r in rows if r.bucket >= 0 and (wanted is None or r.bucket in wanted))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def find(self, value, version: int | None = None) -> DataFrame:
        """Rows of one key: its bucket alone is read."""
        kind = self._schema(version)[self.key].dataType
        own = self.spark.createDataFrame([(value,)], StructType().add(self.key, kind))
        return self.read(version, self._touched(own)).filter(F.col(self.key) == F.lit(value).cast(kind))

    # ---- changes

    def _bucket(self) -> Column:
        return F.coalesce(F.pmod(self.by(F.col(self.key)), F.lit(self.buckets)), F.lit(0)).cast("int").alias(BUCKET)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # numbers of buckets

    def _publish(self, rows: DataFrame, touched: list[int] | None) -> int:
        """Writes the rows of the touched buckets (of all where None) and a manifest."""
        if BUCKET in rows.columns:
            raise ValueError(f"a column is called {BUCKET}")
        known = self.versions()
        kept = {} if touched is None else {b: p for b, p in self.manifest().items() if b not in set(touched)}
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        if touched is None or touched:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            parts = min(self.buckets if touched is None else len(touched), max(n, 1))
            rows.withColumn(BUCKET, self._bucket()).repartition(parts, BUCKET).write.partitionBy(BUCKET).parquet(data)
            kept |= {int(n.split("=")[1]): f"{data}/{n}" for n in self._names(data) if n.startswith(f"{BUCKET}=")}
        number = (known or [0])[-1] + 1
        entries = [(-1, rows.schema.json()), *sorted(kept.items())]
        self.spark.createDataFrame(entries, "bucket int, path string").coalesce(1).write.parquet(f"{self.root}/manifest/v{number}")
        return number

    def write(self, rows: DataFrame) -> int:
        """All rows anew, as the next version."""
        return self._publish(rows, None)

    def change(self, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """step(old rows of the buckets that the changes' keys fall into, changes) replaces the rows of those buckets. The changes are read twice; keep them cheap to read."""
        touched = self._touched(changes)
        old = self.read(buckets=touched)
        return self._publish(step(old, changes).select(old.columns), touched)

    def upsert(self, new: DataFrame) -> int:
        """storage.upsert on the touched buckets; the first call makes the table."""
        return self.change(new, lambda old, rows: storage.upsert(old, rows, self.key)) if self.versions() else self.write(new)

    def delete(self, keys: DataFrame) -> int:
        return self.change(keys, lambda old, gone: storage.delete(old, gone, self.key))

    def update_from(self, changes: DataFrame, columns: list[str]) -> int:
        return self.change(changes, lambda old, new: storage.update_from(old, new, self.key, columns))

    def merge_payload(self, changes: DataFrame, column: str = "metadata") -> int:
        return self.change(changes, lambda old, new: storage.merge_payload(old, new, self.key, column))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last `keep` versions, and the folders that none of those names."""
        known = self.versions()
        used = {p for v in known[-keep:] for p in self.manifest(v).values()}
        for v in known[:-keep]:
            fs, where = self._path(f"{self.root}/manifest/v{v}")
            fs.delete(where, True)
            self._known.pop(v, None)
        for data in self._names(f"{self.root}/data"):
            for bucket in self._names(f"{self.root}/data/{data}"):
                path = f"{self.root}/data/{data}/{bucket}"
                if bucket.startswith(BUCKET) and path not in used:
                    fs, where = self._path(path)
                    fs.delete(where, True)

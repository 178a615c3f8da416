"""Tables kept as parquet snapshots: upsert, update, delete, point reads, paging, counts.

A change makes a new snapshot (new rows, and old rows that the change doesn't touch) and is published by one rename of the
pointer, so a reader sees the old table or the new one. Keys are compared by equality joins; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as L


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key; the columns are the old table's, those that new rows lack become null."""
    missing = {c: F.lit(None).cast(t) for c, t in old.dtypes if c not in new.columns}
    rows = new.withColumns(missing).select(old.columns)
    return rows.unionByName(old.join(new.select(key), key, "left_anti"))


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet are added; existing ones stay."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(old.columns))


def update(rows: DataFrame, condition: Column, values: dict[str, Column], stamp: Column | None = None) -> DataFrame:
    """Sets columns where the condition holds, and updated_at if a stamp is given."""
    values = values | ({"updated_at": stamp} if stamp is not None else {})
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets columns from a table of changes with unique keys (citations, paths, statuses, vectors); null is no change."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    both = rows.join(c, key, "left")
    return both.withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).select(rows.columns)


def merge_payload(rows: DataFrame, changes: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """Map entries of the changes override those of the same name."""
    c = changes.select(key, F.col(column).alias("_m"))
    both = rows.join(c, key, "left")
    old, new = F.coalesce(column, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.col("_m")
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return both.withColumn(column, F.when(new.isNull(), F.col(column)).otherwise(F.map_concat(kept, new))).select(rows.columns)


def merge_variant(rows: DataFrame, changes: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """merge_payload for JSON payloads kept as VARIANT: top-level fields of the changes' object override those of the same name, whatever they hold. A null or absent payload
    counts as an empty object, a null change as none. Keys of the changes are unique."""
    fields = "map<string,variant>"
    both = rows.join(changes.select(key, F.col(column).alias("_v")), key, "left")
    none = F.create_map().cast(fields)
    old, new = F.coalesce(F.col(column).cast(fields), none), F.col("_v").cast(fields)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return both.withColumn(column, F.when(F.col("_v").isNull(), F.col(column)).otherwise(F.to_variant_object(F.map_concat(kept, new)))).select(rows.columns)


def merge_nested(rows: DataFrame, changes: DataFrame, key: str, column: str, inner: str) -> DataFrame:
    """merge_variant one level down: fields of the object at `inner` are merged, all else stays."""
    fields = "map<string,variant>"
    changed = changes.select(key, F.col(column).alias("_v"))
    own = rows.join(changed, key, "inner").select(key, F.try_variant_get(column, F.lit(f"$.{inner}"), fields).alias("old"), F.col("_v").cast(fields).alias("new"))
    old = F.coalesce("old", F.create_map().cast(fields))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key("new", k)), F.col("new"))
    whole = own.filter("new IS NOT NULL").select(key, F.to_variant_object(F.create_map(F.lit(inner), F.to_variant_object(merged))).alias(column))
    return merge_variant(rows, whole, key, column)


def where_path(rows: DataFrame, path: str, kind: str, condition, column: str = "metadata") -> DataFrame:
    """Rows whose payload has a value of the type at the path for which condition(value) holds; what isn't there or is of another type is no match."""
    return rows.filter(F.coalesce(condition(F.try_variant_get(column, F.lit(path), kind)), F.lit(False)))


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], keys: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents and every child table without the keys."""
    return delete(parents, keys, key), {n: delete(c, keys, key) for n, c in children.items()}


def mark_unparsable(papers: DataFrame) -> DataFrame:
    """Papers without markup (null or empty path) fail."""
    return update(papers, F.coalesce(F.col("latex_path"), F.lit("")) == "", {"status": F.lit("failed")})


# ---- reads


def find(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value)


def exists(rows: DataFrame, key: str, value) -> bool:
    return bool(rows.filter(F.col(key) == value).limit(1).count())


def multiget(rows: DataFrame, ids: list, key: str, ordered: bool = True) -> DataFrame:
    """Rows of a list of keys; ordered: in the list's order with repeats kept and missing keys skipped."""
    wanted = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos long, {key} {dict(rows.dtypes)[key]}")
    if not ordered:
        return rows.join(wanted.select(key).distinct(), key, "left_semi")
    return wanted.join(rows, key).orderBy("pos")


def scroll(rows: DataFrame, filters: dict | None = None, limit: int | None = None, offset: int = 0, key: str = "chunk_id") -> DataFrame:
    """Equality filters (a None value is no condition), by key, with offset and limit."""
    conditions = [F.col(c) == v for c, v in (filters or {}).items() if v is not None]
    out = (rows.filter(reduce(lambda a, b: a & b, conditions)) if conditions else rows).orderBy(key).offset(offset)
    return out if limit is None else out.limit(limit)


#: Columns that a paper listing may be sorted by.
SORTABLE = ("citation_count", "published_date", "created_at", "updated_at", "title", "arxiv_id")


def query_papers(papers: DataFrame, fields: list[str] | None = None, *, status: str | None = None, require_abstract: bool = False, order_by: str = "citation_count", desc: bool = True, offset: int = 0, limit: int | None = None, key: str = "arxiv_id") -> DataFrame:
    """Projection, filters and a page, nulls last; an unknown sort column gives way to citation_count."""
    order_by = order_by if order_by in SORTABLE else "citation_count"
    out = papers if status is None else papers.filter(F.col("status") == status)
    if require_abstract:
        out = out.filter(F.col("abstract").isNotNull())
    out = out.orderBy((F.desc_nulls_last if desc else F.asc_nulls_last)(order_by), key).offset(offset)
    out = out if limit is None else out.limit(limit)
    return out.select(*fields) if fields else out


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, int]:
    """(rows of the page from 1, total)."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), rows.count()


def parse_ready(papers: DataFrame) -> DataFrame:
    """Pending papers with a PDF or markup, most cited first."""
    return papers.filter((F.col("status") == "pending") & (F.col("pdf_path").isNotNull() | F.col("latex_path").isNotNull())).orderBy(F.desc_nulls_last("citation_count"), "arxiv_id")


def chunks_of(chunks: DataFrame, paper: str) -> DataFrame:
    return chunks.filter(F.col("paper_id") == paper).orderBy(F.asc_nulls_last("chunk_index"), "chunk_id")


def without_chunks(papers: DataFrame, chunks: DataFrame, key: str = "paper_id", status: str | None = "parsed") -> DataFrame:
    rows = papers if status is None else papers.filter(F.col("status") == status)
    return rows.join(chunks.select(key), key, "left_anti")


def lacking(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    out = rows.filter(F.col(column).isNull())
    return out if limit is None else out.limit(limit)


def unenriched(chunks: DataFrame, column: str = "metadata", flag: str = "enriched") -> DataFrame:
    """Chunks not enriched yet, those without the flag among them."""
    return chunks.filter(F.coalesce(F.try_element_at(column, F.lit(flag)), F.lit("false")) != "true")


# ---- counts


def status_histogram(papers: DataFrame, status: str = "status", known: tuple[str, ...] = L.STATUSES) -> DataFrame:
    """A row for each known status, zero counts included, unknown ones left out, and one `total` over all rows."""
    names = papers.sparkSession.createDataFrame([(s,) for s in known], "status string")
    counts = papers.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    each = names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("count"))
    return each.unionByName(papers.agg(F.lit("total").alias("status"), F.count(F.lit(1)).alias("count")))


def paper_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select("paper_id").distinct().orderBy("paper_id")


def union_ids(*tables: DataFrame, key: str = "paper_id") -> DataFrame:
    return reduce(lambda a, b: a.union(b), [t.select(key) for t in tables]).distinct()


def coverage(wanted: DataFrame, present: DataFrame, key: str = "paper_id") -> DataFrame:
    """One row: total, covered, missing, percent."""
    have = present.select(key).distinct().withColumn("_h", F.lit(1))
    both = wanted.select(key).distinct().join(have, key, "left")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count("_h").alias("covered")).select("total", "covered", (F.col("total") - F.col("covered")).alias("missing"), F.when(F.col("total") > 0, F.col("covered") * 100.0 / F.col("total")).otherwise(0.0).alias("percent"))


class Snapshots:
    """A named table as numbered parquet snapshots under a root folder that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in found if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        v = self._versions(name)
        if not v:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{v[-1] if version is None else version}")

    def write(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        """Publishes a new snapshot; earlier ones stay as backups until vacuum()."""
        number = (self._versions(name) or [0])[-1] + 1
        w = rows.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{name}/v{number}")
        return number

    def vacuum(self, name: str, keep: int = 2) -> None:
        for v in self._versions(name)[:-keep]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upsert(self, name: str, new: DataFrame, key: str) -> int:
        return self.write(name, upsert(self.read(name), new, key) if self._versions(name) else new)

    def delete(self, name: str, keys: DataFrame, key: str) -> int:
        return self.write(name, delete(self.read(name), keys, key))


def latest_per_key(log: DataFrame, key: str, version: str) -> DataFrame:
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).filter("_r = 1").drop("_r")

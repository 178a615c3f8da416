"""Readers and writers of the formats a corpus comes in. All go through Spark's sources, so any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.parsing import DOCUMENT_SCHEMA

#: Normalised names of keyword categories, by a part of their header.
CATEGORY_NAMES = {"robot": "robotics", "vision": "computer_vision", "medical": "medical", "speech": "speech_audio", "audio": "speech_audio", "graph": "graph", "time": "time_series", "reinforcement": "reinforcement_learning"}


def read_records(spark: SparkSession, path: str, schema: str, wrapper: str | None = None) -> DataFrame:
    """JSON files that hold a list of records, or an object with the list under `wrapper`."""
    if wrapper is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    inner = spark.read.schema(f"`{wrapper}` array<struct<{_fields(schema)}>>").json(path, multiLine=True)
    return inner.select(F.explode(wrapper).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    depth, out, part = 0, [], ""
    for c in schema + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, kind = part.strip().split(None, 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ",".join(out)


def read_parsed(spark: SparkSession, path: str, paper_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Parsed documents, one JSON file each, in order of id; malformed files are dropped."""
    docs = spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True, mode="DROPMALFORMED").filter(F.col("paper_id").isNotNull())
    docs = (docs if paper_id is None else docs.filter(F.col("paper_id") == paper_id)).orderBy("paper_id")
    return docs if limit is None else docs.limit(limit)


def write_parsed(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_archives(spark: SparkSession, path: str, suffix: str = r"\.(tar\.gz|tgz|zip|gz|tex)$") -> DataFrame:
    """(paper_id, source): file names without their ending, and bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), suffix, "")
    return files.filter(F.col("path").rlike(suffix)).select(name.alias("paper_id"), F.col("content").alias("source"))


def category_name(header: Column) -> Column:
    low = F.lower(F.trim(header))
    out = F.regexp_replace(low, r"[^a-z0-9]+", "_")
    for part, name in reversed(CATEGORY_NAMES.items()):
        out = F.when(F.contains(low, F.lit(part)), F.lit(name)).otherwise(out)
    return out


def read_keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """(category, keyword) of a text file whose lines `* Header` open a category. Of a repeated header the last part holds. A keyword file is one small
    file: its lines are numbered in one task."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    lines = text.withColumn("line", F.trim("line")).filter("line <> ''")
    w = Window.orderBy("i")
    marked = lines.withColumn("header", F.when(F.col("line").startswith("*"), F.regexp_replace("line", r"^\*+\s*", "")))
    run = marked.withColumn("category", category_name(F.last("header", ignorenulls=True).over(w))).withColumn("part", F.count("header").over(w))
    words = run.filter(F.col("header").isNull() & F.col("category").isNotNull())
    last = run.filter(F.col("header").isNotNull()).groupBy("category").agg(F.max("part").alias("part"))
    return words.join(last, ["category", "part"]).select("category", F.lower("line").alias("keyword")).distinct()


def read_keyword_store(spark: SparkSession, path: str) -> DataFrame:
    """(category, keyword) of a store file: an object with categories, a map from names to lists. A store that isn't there is empty."""
    try:
        raw = spark.read.schema("version string, categories map<string,array<string>>").json(path, multiLine=True)
        raw.limit(0).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], "version string, categories map<string,array<string>>")
    return raw.select(F.explode("categories").alias("category", "k")).select("category", F.explode("k").alias("keyword")).select("category", F.lower("keyword").alias("keyword"))


def add_keywords(store: DataFrame, new: list[str], category: str) -> tuple[DataFrame, DataFrame]:
    """(store, log): keywords that no category has yet, lower-cased; those repeated within one call are added once. The log has a row for each."""
    rows = store.sparkSession.createDataFrame([(category, k.strip().lower()) for k in new if k.strip()], "category string, keyword string").dropDuplicates(["keyword"])
    added = rows.join(store.select("keyword"), "keyword", "left_anti").select("category", "keyword")
    return store.unionByName(added), added.withColumn("action", F.lit("add"))


def remove_keywords(store: DataFrame, gone: list[str]) -> tuple[DataFrame, DataFrame]:
    keys = [k.strip().lower() for k in gone]
    return store.filter(~F.col("keyword").isin(keys)), store.filter(F.col("keyword").isin(keys)).withColumn("action", F.lit("remove"))


def keyword_stats(store: DataFrame) -> DataFrame:
    return store.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def read_id_file(spark: SparkSession, path: str) -> DataFrame:
    """(pos, paper_id) of a text file: lines in order, without blank ones and those that start with #."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    return lines.select("pos", F.trim("line").alias("paper_id")).filter("paper_id <> '' AND NOT startswith(paper_id, '#')")


def write_review(rows: DataFrame, path: str) -> None:
    """Review files: abstracts of at most 500 characters and a mark after a cut."""
    from quarry.functions.text import shorten

    rows.withColumn("abstract", shorten(F.col("abstract"), 500)).write.mode("overwrite").json(path)


def figure_store_stats(spark: SparkSession, path: str) -> DataFrame:
    """(extension, files, megabytes) of a folder of images."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"), (F.sum("length") / 1e6).alias("megabytes"))

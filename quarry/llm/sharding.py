"""Contiguous shards of near-equal bytes, by global prefix sums from per-partition totals.

DataFrame functions only. The rows are ordered by key (range exchange of key, size and checksum; the texts are never
shuffled), every range sums its sizes and counts, one running sum over those totals gives each range the bytes and
rows before it, and a running sum inside the range completes both. The byte axis is cut at equal targets: a row belongs to
the shard in whose stretch its middle byte lies, so no shard differs from its target by more than the largest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage, plain


def text_size(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of a text (null: none) and a fixed part for each row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def assign_shards(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """key, size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard), a row for each row.

    Law `bytes`: sums of sizes near equal, shards contiguous in order of key, then checksum and size. Null keys come first,
    a null text has no bytes and checksum 0, equal rows take successive slots, other columns are ignored. A shard stays empty where
    one row is larger than a shard's target. An empty table gives no rows. Equal texts may lie in different shards: a
    group of copies can exceed a shard's target.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs, (key, text) = plain(docs, key, text)
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        text_size(F.col(text), overhead).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["key", "text_crc32", "size"]
    # The range of a row depends on a sample; the checkpoint fixes it for all that follows.
    placed = cut_lineage(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    # One row for each range: the only running sum that isn't inside a range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    middle = (start * 2 + F.col("size")).cast("decimal(38,0)")  # twice the middle byte
    cut = (
        placed.join(bases, "part")
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (F.col("all_bytes") * 2)).cast("int")))
    )
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select("key", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))

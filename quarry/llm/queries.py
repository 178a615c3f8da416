"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bm25, byte_bpe, clustering, langid, minhash, packing, pii, quality, resampling, secrets, simhash
from quarry.llm.common import documents, scratch
from quarry.llm.sharding import assign_shards
from quarry.llm.token_files import read_token_files, write_token_files


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "token-files")
    write_token_files(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, out, derive=(("ids_crc32", "long", zlib.crc32),))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = assign_shards(documents(spark, sf_dir), 40)
    return shards.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, model)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, decoded=True)
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *digests)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan_documents(documents(spark, sf_dir)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of the documents whose id is divisible by 100."""
    return bm25.search(documents(spark, sf_dir), F.col("doc_id") % 100 == 0, 10)


#: The key of the registered query. A production run gives its own, from a secret store.
PII_KEY = b"public key of the registered query"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pii.pseudonymise(documents(spark, sf_dir), PII_KEY)
    return masked.select("doc_id", "text", F.size("pii_spans").alias("n_pii"), pii.spans_text(F.col("pii_spans")).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 40, 5, size=64, scale=256, seed=2)
    return found.withColumnRenamed("key", "vec_id")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, ngrams=1, buckets=10000, least_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words to a shingle, as the query's contract has it; the operator takes five unless told otherwise."""
    found = minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clusters": clustering.lloyd_sql(40, 5)}

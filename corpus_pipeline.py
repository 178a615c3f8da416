"""The corpus pipeline: quality rules, language identification, near-duplicate removal, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. run() applies them in order. Texts reach Python in batches bounded in bytes. Empty tables pass every stage and give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, minhash, packing, pii, quality
from quarry.llm.common import discard, plain, scratch, small_batches
from quarry.llm.queries import PII_KEY

#: Least posterior probability of a predicted language that a document needs.
LEAST_SURE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or fall below the learned threshold go: null and short texts among them. Repeated rows and null ids
    are judged like any other row."""
    small_batches(spark)
    own, (key, text) = plain(docs, "doc_id", "text")
    model = quality.fit(own, spark.read.parquet(f"{sf_dir}/labels.parquet"), key=key, text=text)
    return quality.judge(own, model, key=key, text=text, carry=True).filter("kept").select(own.columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, those whose best language has a probability below LEAST_SURE, and those that are less like their best
    language than its own texts are (langid.least_likeness): other languages and gibberish. Without a row that has a language all go."""
    small_batches(spark)
    own, (key, text, lang) = plain(docs, "doc_id", "text", "lang")
    names = {"key": key, "text": text}
    model = langid.fit(own, **names, lang=lang)
    found = langid.predict(own, model, **names, carry=True, likeness=True)
    alike = F.col("likeness") >= langid.least_likeness(own, model, **names, lang=lang)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SURE) & alike).select(own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words to a shingle, a similarity of 0.8 or more of the whole texts' sets) the document with the smallest id stays (of repeated
    rows one, a null id if there is no other). SimHash groups and MinHash buckets give the candidates; a text without words is no duplicate."""
    small_batches(spark)
    return minhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts get pseudonyms; n_chars follows the new text. Null and empty texts stay as they are."""
    small_batches(spark)
    own, (text,) = plain(docs, "text")
    masked = pii.pseudonymise(own, PII_KEY, text=text).select(own.columns)
    lengths = [f"c{i}" for i, c in enumerate(docs.columns) if c.lower() == "n_chars"]
    return masked.withColumns({c: F.length(text).cast("long") for c in lengths}).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as pieces in sequences of at most 2048 tokens: digests of the ids, and where each piece lies. A null text is packed as an
    empty one; ids may be null or repeat. Other columns are ignored."""
    small_batches(spark)
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Learned thresholds, fingerprints and encodings aren't expressible in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage but the last is written as Parquet in the shared folder and read again. What no later stage
    reads is deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if last:
            discard(spark, last)
        docs, last = spark.read.parquet(out), out
    return STAGES[-1][1](spark, docs, sf_dir)

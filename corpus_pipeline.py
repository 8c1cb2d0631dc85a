"""The corpus pipeline: stages that each take and return documents, written as Parquet between them.

Every stage gives an empty table for an empty one, reads the columns of documents alone, whatever others there are, and keeps rows that repeat,
but for the second, which keeps one of each group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontam, langid, minhash, mixing, suffixes
from quillstream.llm.shared import let_go, shared_dir, small_batches

#: A text is rejected by language identification if it has no letter, or no language has that much of the posterior.
SURE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null ones, those without a letter, and unsure ones. Rows without an id or a language of their own are judged like others; clean texts stay as they are."""
    let_go(spark)
    small_batches(spark)
    d = langid.identify(docs.select(*COLUMNS), langid.fitted(docs))
    return d.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each group of near copies; of its rows with equal text one.

    A row without a doc_id is a document of its own text, after all others. Of rows with equal id and text the one with the
    smallest lang, source and n_chars stays.
    """
    let_go(spark)
    small_batches(spark)
    keyed = docs.select(*COLUMNS, minhash.key_of(F.col("doc_id"), F.col("text")).alias("key"))
    keep = minhash.classes(docs.select("doc_id", "text")).filter("kept").select("key").distinct()
    rest = F.struct("lang", "source", "n_chars")
    one = keyed.join(keep, "key").groupBy("key", "doc_id", "text").agg(F.min(rest).alias("rest"))
    return one.select("doc_id", "text", "rest.*").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out byte strings that start earlier elsewhere; a text that this leaves without a letter or digit is dropped.

    A cut can fall inside a character; its remaining bytes are dropped with it. A null text counts as empty, and texts that lose nothing stay whatever they hold;
    rows of one id are ordered by their texts' digests, equal ones lose the same.
    """
    let_go(spark)
    small_batches(spark)
    d = suffixes.dedup(docs.select(*COLUMNS)).withColumn("cut", F.size("spans") > 0)
    whole, rest = F.col("kept").cast("string"), F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    d = d.withColumn("text", F.when(F.col("cut"), rest).otherwise(whole))
    d = d.filter(~F.col("cut") | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy, edited or not, of a test item; null and empty texts and items match nothing, without items all stay."""
    let_go(spark)
    small_batches(spark)
    out = decontam.check(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.filter(~F.col("contaminated")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null texts have none, rows without a source are one, ties are as in llm/mixing.py."""
    let_go(spark)
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_copies", benchmark_copies),
    ("source_mix", mixed),
]
#: Trained models and alignments are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""A corpus pipeline of five stages, each of which calls one operator of sievedeck.llm.

Toxic documents go; repeated passages of lines go (and documents of which nothing is left);
one document of each near-duplicate group stays; repeated passages go; what is left is packed.
All but the last return the columns of documents. A text that a stage changes gets its new n_chars.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievedeck.llm import lines, neardup, packing, substrings, toxicity
from sievedeck.session import discard, ensure_importable, release, small_batches, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxic_rows(docs, model, out_col="__toxic").where("NOT __toxic").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = lines.line_dedup(docs, drop_emptied=True, passages=True)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = substrings.substring_dedup(docs).where("dedup.n_removed = 0 OR dedup.n_removed < dedup.n_words")
    changed = F.col("dedup.n_removed") > 0
    left = left.withColumn("n_chars", F.when(changed, F.char_length("dedup.text").cast("long")).otherwise(F.col("n_chars")))
    return left.withColumn("text", F.when(changed, F.col("dedup.text")).otherwise(F.col("text"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def _stage(function):
    """The stage in a session whose Python batches are small, for long documents."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        release(spark)
        return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("line_dedup", _stage(drop_repeated_lines)),
    ("near_dedup", _stage(drop_near_duplicates)),
    ("substring_dedup", _stage(drop_repeated_passages)),
    ("packing", _stage(pack)),
]
#: Trained scores and hashes of several stages have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    ensure_importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        after = staged(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

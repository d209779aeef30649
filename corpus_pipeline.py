"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  Stages work on all rows that the stage before kept:

1. quality rules     rows outside the base rules or the limits of their language and source go;
2. exact dedup       one row per text stays (equal after deleting white space);
3. n-gram join       one document per component of near copies stays, the one with the smallest id;
4. secret scans      secrets are masked in the text (n_chars follows), no row goes;
5. packing           the texts become sequences of at most 4096 tokens, one row per piece.

Null texts fail the quality rules, as texts without words do.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from carrierbook.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from carrierbook.llm.queries import tokenizer_file
from carrierbook.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("ngram_join", near_copies),
          ("secret_scans", mask_secrets), ("packing", pack_sequences)]

# Vocabulary files and reachability have no SQL form; tests use a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's rows are in the shared folder of the session."""
    folder = scratch_path(spark, f"corpus-pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        place = os.path.join(folder, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs

"""The corpus pipeline: filter, identify, deduplicate, redact and pack documents.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``; each stage works on all rows
that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkfeat.llm.jaccard_join import keep_one
from sparkfeat.llm.language import keep_known
from sparkfeat.llm.quality import keep_good
from sparkfeat.llm.secrets import redact_secrets
from sparkfeat.llm.window_packing import pack_windows
from sparkfeat.sources.store import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs calibrated on the labels.

    Missing and empty texts fail the base rules; a missing language is a stratum of its own; equal
    texts pass or fail together and are one trial of the calibration; a missing doc_id has no
    label. An empty table gives no rows.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Missing texts and texts without a letter go; a missing lang or doc_id plays no part; repeated
    rows stay or go together; if nothing teaches a language, all texts with a letter stay. An
    empty table gives no rows.
    """
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the least doc_id.

    Of equal rows one stays; a missing doc_id comes after all others; texts without words, missing
    ones too, are no duplicates of anything and all stay. An empty table gives no rows.
    """
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts hidden and n_chars counted anew where they were.

    Missing and empty texts, rows without secrets and all other columns are as before; repeated
    rows are changed alike. An empty table gives no rows.
    """
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 1024 ids.

    A missing or empty text is its end id alone; repeated rows are packed each; a missing doc_id
    stays missing; a very long text is cut at the ends of sentences and, where it has none, freely.
    An empty table gives no rows.
    """
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return pack_windows(docs, *map(public_tokenizers.path, names), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("language", language),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]

#: Cutoffs from exact bounds, a fitted classifier and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the table ``documents``; every stage's rows are stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

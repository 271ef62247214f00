"""Figures of merit from tables of scored rows, for many models at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column
from sparkfeat.operators.ranking import running_counts


def grouped_auc(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve of every group, equal scores counted half.

    Returns the columns ``by``, ``positives``, ``negatives`` and ``auc``, which is NULL where a
    class is missing. One pass serves all groups, such as models, folds and parts of the rows; a
    group of any size is spread over many tasks. Pairs are counted exactly and divided once, so
    the result does not depend on the order of rows. Rows with a missing score or label are left
    out.
    """
    if {"positives", "negatives", "auc"} & set(by):
        raise ValueError("group columns may not be called positives, negatives or auc")
    known = df.where(as_column(label).isNotNull())
    yes = as_column(label) == 1
    found = running_counts(known, by, score, {"__yes": yes, "__no": ~yes})
    # Twice the pairs in the right order: a tie is half of one.
    pairs = F.col("__yes").cast("decimal(18,0)") * (2 * F.col("__no_below") + F.col("__no")).cast("decimal(19,0)")
    counted = found.groupBy(*[as_column(c) for c in by]).agg(
        F.sum("__yes").alias("positives"),
        F.sum("__no").alias("negatives"),
        F.sum(pairs).cast("double").alias("__pairs"),
    )
    every = 2.0 * F.col("positives").cast("double") * F.col("negatives").cast("double")
    return counted.select(
        *[as_column(c) for c in by],
        "positives",
        "negatives",
        F.when(every > 0, F.col("__pairs") / every).alias("auc"),
    )

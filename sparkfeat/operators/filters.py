"""Row filters with pandas-style handling of missing values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from sparkfeat.functions.missing import as_column, differs_or_missing


def keep_different(df: DataFrame, column: str, excluded) -> DataFrame:
    """Drop rows whose value equals ``excluded``; a missing value stays."""
    return df.where(differs_or_missing(column, excluded))


def keep_below(df: DataFrame, column: str, limit) -> DataFrame:
    """Keep rows whose value is below ``limit``; a missing value goes."""
    return df.where(as_column(column) < limit)


def keep_category(df: DataFrame, column: str, level: str) -> DataFrame:
    return df.where(as_column(column) == level)


def clean_training_rows(
    train: DataFrame, excluded: Mapping[str, object], below: Mapping[str, object]
) -> DataFrame:
    """Row cleaning of the training table only; the table to be scored keeps all its rows."""
    for column, value in excluded.items():
        train = keep_different(train, column, value)
    for column, limit in below.items():
        train = keep_below(train, column, limit)
    return train

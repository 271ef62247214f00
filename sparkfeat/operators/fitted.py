"""Transforms with statistics that are fitted once and applied to any table.

``fit_*`` runs one job and returns plain numbers per column; ``apply_*`` puts them into the
plan as literals, so applying costs neither a join nor a second pass. ``stats_table`` and
``read_stats`` store fitted numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column, finite_or_zero, nan_to_null
from sparkfeat.operators.profile import float_class, float_columns
from sparkfeat.operators.ranking import median

Stats = dict[str, dict[str, float | None]]


def _one_row(df: DataFrame, columns: Sequence[str], functions: Mapping) -> Stats:
    """Several statistics of several columns from one aggregate without a group key."""
    if not columns:
        return {}
    row = df.agg(
        *[f(as_column(c)).alias(f"{name}_{i}") for i, c in enumerate(columns)
          for name, f in functions.items()]
    ).first()
    return {c: {name: row[f"{name}_{i}"] for name in functions} for i, c in enumerate(columns)}


def stats_table(spark: SparkSession, stats: Stats) -> DataFrame:
    """Fitted statistics as rows (column, statistic, value)."""
    rows = [(c, s, None if v is None else float(v)) for c, e in stats.items() for s, v in e.items()]
    return spark.createDataFrame(rows, "column string, statistic string, value double")


def read_stats(table: DataFrame) -> Stats:
    stats: Stats = {}
    for row in table.collect():
        stats.setdefault(row["column"], {})[row["statistic"]] = row["value"]
    return stats


# --- sigma clip -----------------------------------------------------------------------------


_MEAN_STD = {"mean": lambda c: nan_to_null(F.avg(c)), "std": lambda c: nan_to_null(F.stddev_samp(c))}


def fit_mean_std(df: DataFrame, columns: Sequence[str]) -> Stats:
    """Mean and sample standard deviation of the present values."""
    return _one_row(df, columns, _MEAN_STD)


def fit_sigma_clip(df: DataFrame, key_part: str = "SK_ID_") -> Stats:
    """Mean and deviation of the columns that are clipped, in one pass over the table.

    These are the float columns whose range needs 32 bits, except keys; integers and floats of
    a small range are never clipped.
    """
    candidates = [c for c in float_columns(df) if key_part not in c]
    found = _one_row(df, candidates, {"low": F.min, "high": F.max, **_MEAN_STD})
    return {
        c: {"mean": s["mean"], "std": s["std"]}
        for c, s in found.items()
        if float_class(s["low"], s["high"]) == "float32"
    }


def apply_sigma_clip(
    df: DataFrame, stats: Stats, *, trigger: float = 3.0, clamp: float = 3.0
) -> DataFrame:
    """Values more than ``trigger`` deviations from the mean become mean +- ``clamp`` deviations."""
    clipped = {}
    for c, s in stats.items():
        if s["mean"] is None or s["std"] is None:
            continue
        value, mean, std = as_column(c), s["mean"], s["std"]
        clipped[c] = (
            F.when(value - F.lit(mean) > F.lit(trigger * std), F.lit(mean + clamp * std))
            .when(F.lit(mean) - value > F.lit(trigger * std), F.lit(mean - clamp * std))
            .otherwise(value)
        )
    return df.withColumns(clipped) if clipped else df


def sigma_clip(df: DataFrame, *, trigger: float = 3.0, clamp: float = 3.0) -> DataFrame:
    """Clip all eligible columns of a table by its own statistics."""
    return apply_sigma_clip(df, fit_sigma_clip(df), trigger=trigger, clamp=clamp)


# --- imputation -----------------------------------------------------------------------------


def fit_mean(df: DataFrame, columns: Sequence[str]) -> Stats:
    return _one_row(df, columns, {"fill": lambda c: nan_to_null(F.avg(c))})


def fit_median(df: DataFrame, columns: Sequence[str], **options) -> Stats:
    """Exact medians of several columns. The column is the group, so one search serves all."""
    pairs = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("column"), as_column(c).cast("double").alias("value"))
                for i, c in enumerate(columns)
            ]
        )
    )
    found = median(df.select(pairs), ["column"], "value", **options).collect()
    fills = {r["column"]: r["median"] for r in found}
    return {c: {"fill": fills.get(i)} for i, c in enumerate(columns)}


def apply_fill(df: DataFrame, stats: Stats) -> DataFrame:
    """Replace missing values by the fitted fill value."""
    return df.withColumns(
        {c: F.coalesce(as_column(c), F.lit(s["fill"])) for c, s in stats.items()
         if s["fill"] is not None}
    )


# --- min-max scaling ------------------------------------------------------------------------


def fit_min_max(df: DataFrame, columns: Sequence[str] | None = None, label: str = "TARGET") -> Stats:
    """Minimum and maximum of the float columns, missing and infinite values counted as 0."""
    columns = columns or [c for c in float_columns(df) if c != label]
    return _one_row(
        df,
        columns,
        {"low": lambda c: F.min(finite_or_zero(c)), "high": lambda c: F.max(finite_or_zero(c))},
    )


def apply_min_max(df: DataFrame, stats: Stats) -> DataFrame:
    """``(x - min) / (max - min)`` with missing and infinite as 0; a constant column gives 0.

    As with any fitted scaler, values outside the fitted range land outside [0, 1].
    """
    scaled = {}
    for c, s in stats.items():
        if s["low"] is None:
            continue
        shifted = finite_or_zero(c) - F.lit(s["low"])
        width = s["high"] - s["low"]
        scaled[c] = shifted / F.lit(width) if width else shifted
    return df.withColumns(scaled)

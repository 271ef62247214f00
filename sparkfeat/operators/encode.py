"""Category levels, one-hot columns and train/test alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column, quoted, text_literal
from sparkfeat.operators.aggregate import level_name
from sparkfeat.operators.columns import check_distinct_names
from sparkfeat.operators.profile import string_columns
from sparkfeat.sources.store import materialize

MAX_LEVELS = 1000


def column_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, level) pairs of all columns; repeats are dropped before the shuffle."""
    pairs = F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), as_column(c).alias("level")) for c in columns])
    )
    return df.select(pairs).where(F.col("level").isNotNull()).distinct()


def levels(
    df: DataFrame, columns: Sequence[str] | None = None, max_levels: int = MAX_LEVELS
) -> dict[str, list[str]]:
    """Sorted levels of each category column, from one job over all columns.

    A column with more than ``max_levels`` levels is an error, so the driver never receives
    more than that bound allows.
    """
    columns = list(columns) if columns is not None else string_columns(df)
    if not columns:
        return {}
    bound = max_levels * len(columns)
    rows = column_levels(df, columns).limit(bound + 1).collect()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        found[row["column"]].append(row["level"])
    wide = [c for c in columns if len(found[c]) > max_levels]
    if wide or len(rows) > bound:
        raise ValueError(f"more than {max_levels} levels in {wide or columns}")
    return {c: sorted(v) for c, v in found.items()}


def level_catalogue(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Levels as a table (column, level, ordinal), ordinals from 0 in sort order.

    Fitted on the table as read, so it keeps levels that later filters remove. One scan, any
    number of levels: they are stored in ranges of (column, level), and an ordinal is a level's
    place in its part plus the column's levels in the parts before.
    """
    columns = list(columns) if columns is not None else string_columns(df)
    found = column_levels(df, columns).repartitionByRange("column", "level")
    parts = materialize(found.withColumn("part", F.spark_partition_id()), "levels")
    sizes = parts.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "column", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("column", "part").orderBy("level"))
    return parts.join(starts, ["column", "part"]).select(
        "column", "level", (F.col("start") + inside - 1).cast("int").alias("ordinal")
    )


def one_hot(
    df: DataFrame,
    found: Mapping[str, Sequence[str | None]],
    *,
    null_level: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Replace each category column by one 0/1 column per level; also returns the new names.

    With ``null_level`` every column also gets ``COLUMN_nan``, even without missing values;
    without it a missing value is 0 in every level. A value outside the levels is 0 throughout.
    """
    dummies = {}
    for c, known in found.items():
        for v in [*known, None] if null_level else known:
            test = "IS NULL" if v is None else f"= {text_literal(v)}"
            dummies[level_name(c, v)] = f"CASE WHEN {quoted(c)} {test} THEN 1 ELSE 0 END"
    kept = [quoted(c) for c in df.columns if c not in found]
    out = df.selectExpr(*kept, *[f"{e} AS {quoted(name)}" for name, e in dummies.items()])
    check_distinct_names(out.columns)
    return out, list(dummies)


def shared_levels(
    train: Mapping[str, Sequence[str]], test: Mapping[str, Sequence[str]]
) -> dict[str, list[str]]:
    """Levels that occur on both sides, for the columns that both sides have."""
    return {c: [v for v in train[c] if v in set(test[c])] for c in train if c in test}


def align(
    train: DataFrame,
    test: DataFrame,
    label: str,
    train_levels: Mapping[str, Sequence[str]] | None = None,
    test_levels: Mapping[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One-hot encode both sides to the same columns; only train keeps the label.

    Columns and levels that one side lacks are dropped from the other.
    """
    in_both = shared_levels(
        levels(train) if train_levels is None else train_levels,
        levels(test) if test_levels is None else test_levels,
    )
    common = [c for c in train.columns if c in test.columns and c != label]
    categories = {c: in_both[c] for c in common if c in in_both}
    left, _ = one_hot(
        train.select(*[as_column(c) for c in common], as_column(label)), categories, null_level=False
    )
    right, _ = one_hot(test.select(*[as_column(c) for c in common]), categories, null_level=False)
    if [c for c in left.columns if c != label] != right.columns:
        raise ValueError("train and test columns differ")
    return left, right

"""Column selection, dropping, renaming and the final fill."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.missing import INFINITY, as_column, quoted, sentinel_to_null
from sparkfeat.operators.profile import float_columns, numeric_columns


def drop_strict(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; a name that is not there is an error."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise KeyError(f"no such columns: {unknown}")
    return df.drop(*names)


def drop_lenient(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the columns of a list that are there; case-sensitive."""
    unwanted = set(names)
    return df.select(*[as_column(c) for c in df.columns if c not in unwanted])


def names_containing(df: DataFrame, part: str, without: Iterable[str] = ()) -> list[str]:
    """Columns whose name holds ``part`` and none of the texts in ``without``."""
    return [c for c in df.columns if part in c and not any(w in c for w in without)]


def names_of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def split_label(df: DataFrame, label: str, *keys: str) -> tuple[list[str], str]:
    """Feature names (everything but keys and label) and the label name."""
    return [c for c in df.columns if c != label and c not in keys], label


def with_new_columns(
    df: DataFrame, operator: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, list[str]]:
    """Apply an operator and report which columns it added."""
    out = operator(df)
    return out, [c for c in out.columns if c not in df.columns]


def sentinels_to_null(df: DataFrame, columns: Iterable[str], sentinel) -> DataFrame:
    return df.withColumns({c: sentinel_to_null(c, sentinel) for c in columns})


def infinite_to_zero(df: DataFrame) -> DataFrame:
    """Replace +inf and -inf in every float column by 0; missing values stay."""
    return df.withColumns(
        {
            c: F.when(F.abs(as_column(c)) == F.lit(INFINITY), F.lit(0.0)).otherwise(as_column(c))
            for c in float_columns(df)
        }
    )


def missing_to_zero(df: DataFrame) -> DataFrame:
    """Replace missing values of every numeric column by 0."""
    numbers = set(numeric_columns(df))
    return df.withColumns({c: F.coalesce(as_column(c), F.lit(0)) for c in numbers})


def fill_final(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Infinite and missing values of all numeric columns become 0, in one projection."""
    floats, numbers = set(float_columns(df)) - set(keep), set(numeric_columns(df)) - set(keep)

    def filled(c):
        name = quoted(c)
        if c in floats:
            finite = f"{name} > DOUBLE('-Infinity') AND {name} < DOUBLE('Infinity')"
            return f"CASE WHEN {finite} THEN {name} ELSE 0 END AS {name}"
        return f"coalesce({name}, 0) AS {name}" if c in numbers else name

    return df.selectExpr(*[filled(c) for c in df.columns])


def check_distinct_names(names: Iterable[str]) -> None:
    """Raise if two names are equal when upper and lower case are not told apart."""
    seen: dict[str, str] = {}
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"column names collide: {seen[name.lower()]!r} and {name!r}")
        seen[name.lower()] = name


def plain_names(df: DataFrame) -> DataFrame:
    """Rename columns to letters, digits and underscores, as the trainers need."""
    plain = [re.sub(r"\W", "_", c) for c in df.columns]
    check_distinct_names(plain)
    return df.toDF(*plain)

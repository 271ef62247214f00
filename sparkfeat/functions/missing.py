"""Column expressions for the missing-value rules.

NULL is the only missing value. NaN never leaves an expression; +inf and -inf are
ordinary values until the final fill.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def quoted(name: str) -> str:
    """Column name as an identifier, safe for names with dots, blanks or backticks."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str | None) -> str:
    """A string as a SQL literal."""
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_column(value) -> Column:
    """A column from a column name, a Column, or a number."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(quoted(value))
    return F.lit(value)


def nan_to_null(value) -> Column:
    c = as_column(value)
    return F.when(~F.isnan(c), c)


def ieee_div(numerator, denominator) -> Column:
    """``a / b``: +-inf for x/0, NULL for 0/0 and for a missing operand; never raises."""
    a = as_column(numerator).cast("double")
    b = as_column(denominator).cast("double")
    by_zero = F.when(a > 0, F.lit(INFINITY)).when(a < 0, F.lit(-INFINITY))
    return F.when(b == 0, by_zero).otherwise(nan_to_null(a / b))


def sentinel_to_null(value, sentinel) -> Column:
    return F.nullif(as_column(value), F.lit(sentinel))


def differs_or_missing(value, excluded) -> Column:
    """Predicate ``value != excluded`` that keeps rows whose value is missing."""
    return ~as_column(value).eqNullSafe(F.lit(excluded))


def positive_part(value) -> Column:
    """The value where it is above zero, else 0; a missing value gives 0."""
    c = as_column(value)
    return F.when(c > 0, c).otherwise(F.lit(0))


def finite_or_zero(value) -> Column:
    """Missing, NaN and infinite values become 0."""
    c = as_column(value)
    return F.when((c > F.lit(-INFINITY)) & (c < F.lit(INFINITY)), c).otherwise(F.lit(0))

"""Horizontal statistics and pair features of one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column, ieee_div

# Fixed value: second and fourth moments below this count as zero in the row kurtosis.
MOMENT_EPSILON = 1e-14


def _total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts)


def _present(columns) -> Column:
    return _total([as_column(c).isNotNull().cast("int") for c in columns])


def row_sum(columns) -> Column:
    """Sum of the present values; 0 if none is present."""
    if not columns:
        return F.lit(0)
    return _total([F.coalesce(as_column(c), F.lit(0)) for c in columns])


def row_mean(columns) -> Column:
    """Mean of the present values; NULL if none is present."""
    if not columns:
        return F.lit(None).cast("double")
    n = _present(columns)
    return F.when(n > 0, row_sum(columns) / n)


def row_product(columns) -> Column:
    """Product of all values; NULL if any is missing."""
    return reduce(mul, [as_column(c) for c in columns])


def offset_ratio(numerator, denominator, fill: float = -1.0, offset: float = 0.1) -> Column:
    """Ratio of two columns after filling the missing values and adding an offset."""

    def shifted(value):
        return F.coalesce(as_column(value), F.lit(fill)) + F.lit(offset)

    return ieee_div(shifted(numerator), shifted(denominator))


def missing_interaction(indicator, value) -> Column:
    """``value`` (0 if missing) on rows where ``indicator`` is missing, else 0."""
    return F.when(
        as_column(indicator).isNull(), F.coalesce(as_column(value), F.lit(0.0))
    ).otherwise(F.lit(0.0))


def with_row_stats(
    df: DataFrame, columns: Sequence[str], *, std: str | None = None, kurtosis: str | None = None
) -> DataFrame:
    """Add the sample standard deviation and/or the bias-corrected excess kurtosis of a row.

    Missing values are skipped. The deviation needs two values and the kurtosis four,
    otherwise NULL; the kurtosis of equal values is 0. The steps are separate projections
    so that the mean is computed once per row and not once per input column.
    """
    if not columns:
        return df.withColumns({o: F.lit(None).cast("double") for o in (std, kurtosis) if o})
    n, mean, m2, m4 = (F.col(f"__row_{s}") for s in ("n", "mean", "m2", "m4"))
    out = df.withColumns(
        {"__row_n": _present(columns).cast("double"), "__row_mean": row_mean(columns)}
    )

    def moment(power: int) -> Column:
        terms = []
        for c in columns:
            square = (as_column(c) - mean) * (as_column(c) - mean)
            terms.append(F.coalesce(square if power == 2 else square * square, F.lit(0.0)))
        return _total(terms)

    out = out.withColumn("__row_m2", moment(2))
    if kurtosis:
        out = out.withColumn("__row_m4", moment(4))
    results = {}
    if std:
        results[std] = F.when(n >= 2, F.sqrt(m2 / (n - 1)))
    if kurtosis:
        scaled = n * (n + 1) * (n - 1) * m4 / ((n - 2) * (n - 3) * m2 * m2)
        correction = 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
        results[kurtosis] = F.when(
            n >= 4,
            F.when(m2 < F.lit(MOMENT_EPSILON), F.lit(0.0)).otherwise(scaled - correction),
        )
    return out.withColumns(results).drop("__row_n", "__row_mean", "__row_m2", "__row_m4")

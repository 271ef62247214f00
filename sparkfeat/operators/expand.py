"""Columns derived from other columns of the same row: bins and polynomial terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + i * ((high - low) / bins) for i in range(bins)] + [high]


def bin_labels(low: float, high: float, bins: int) -> list[str]:
    """Interval texts such as ``(20.0, 25.0]`` in bin order."""
    edges = bin_edges(low, high, bins)
    return [f"({a}, {b}]" for a, b in zip(edges[:-1], edges[1:])]


def equal_width_bin(value, low: float, high: float, bins: int) -> Column:
    """Number (from 1) of the right-closed bin; NULL outside ``(low, high]``."""
    c = as_column(value)
    above = [(c > F.lit(edge)).cast("int") for edge in bin_edges(low, high, bins)[:-1]]
    return F.when((c > F.lit(low)) & (c <= F.lit(high)), reduce(add, above))


def bin_label(number: Column, labels: Sequence[str]) -> Column:
    # The guard matters: element_at takes a NULL position in an array of literals for the last.
    return F.when(number.isNotNull(), F.element_at(F.array(*[F.lit(t) for t in labels]), number))


def polynomial_terms(values: Mapping[str, Column], degree: int, lowest: int = 2) -> dict[str, Column]:
    """All products of ``lowest`` to ``degree`` of the named values, named like ``a^2 b``."""
    terms = {}
    for size in range(lowest, degree + 1):
        for factors in combinations_with_replacement(values, size):
            powers = Counter(factors).items()
            name = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers)
            terms[name] = reduce(mul, [values[c] for c in factors])
    return terms


def with_polynomials(df: DataFrame, columns: Sequence[str], degree: int = 3) -> DataFrame:
    return df.withColumns(polynomial_terms({c: as_column(c) for c in columns}, degree))

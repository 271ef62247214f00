"""Statistics gathered while a table is stored, so that they cost no scan of their own.

``observe`` rides on the write: ranges, means, deviations and the number of rows of a table are
known when its parquet files are, and what is fitted later (type classes, sigma clip, mean fill,
row guards) reads these few numbers. Spark counts a task's part once, when the task ends; a task
that is lost or repeated leaves no trace in them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column, finite_or_zero, nan_to_null
from sparkfeat.operators.fitted import Stats
from sparkfeat.operators.profile import (
    classes_of_ranges, float_class, float_columns, integer_columns, numeric_columns, profile_rows,
)
from sparkfeat.sources.schemas import TABLE_FILES, known_types
from sparkfeat.sources.store import materialize
from sparkfeat.sources.tables import csv_texts, kind_of, text_checks

_METRICS: dict[str, Callable[[Column], Column]] = {
    "low": F.min,
    "high": F.max,
    "mean": lambda c: nan_to_null(F.avg(c)),
    "std": lambda c: nan_to_null(F.stddev_samp(c)),
    "present": F.count,
    "fill_low": lambda c: F.min(finite_or_zero(c)),
    "fill_high": lambda c: F.max(finite_or_zero(c)),
}


@dataclass(frozen=True)
class Statistics:
    """Numbers on a stored table; every method here works without a job."""

    rows: int
    columns: Stats
    integers: tuple[str, ...]
    floats: tuple[str, ...]

    def classes(self) -> dict[str, str]:
        """Type class of every numeric column, as ``profile.type_classes`` finds by a scan."""
        ranges = {c: (s["low"], s["high"]) for c, s in self.columns.items()}
        return classes_of_ranges(ranges, set(self.integers))

    def profile(self, spark: SparkSession) -> DataFrame:
        """Name, minimum, maximum and type class as rows, like ``profile.range_profile``."""
        ranges = {c: (s["low"], s["high"]) for c, s in self.columns.items()}
        return profile_rows(spark, ranges, set(self.integers))

    def clip(self, key_part: str = "SK_ID_") -> Stats:
        """Means and deviations of the columns that ``fitted.apply_sigma_clip`` clips."""
        return {
            c: {"mean": self.columns[c]["mean"], "std": self.columns[c]["std"]}
            for c in self.floats
            if key_part not in c
            and float_class(self.columns[c]["low"], self.columns[c]["high"]) == "float32"
        }

    def means(self, columns) -> Stats:
        """What ``fitted.apply_fill`` puts in place of missing values."""
        return {c: {"fill": self.columns[c]["mean"]} for c in columns}

    def min_max(self, label: str = "TARGET") -> Stats:
        """Ranges of the float columns as ``fitted.apply_min_max`` takes them; an empty table has none."""
        return {
            c: {"low": self.columns[c]["fill_low"], "high": self.columns[c]["fill_high"]}
            for c in self.floats
            if c != label
        }

    def check_rows(self, other: "Statistics | int") -> int:
        """Raise unless another table, such as a join of this one, has as many rows."""
        got = other if isinstance(other, int) else other.rows
        if got != self.rows:
            raise ValueError(f"row count changed from {self.rows} to {got}")
        return got


def _metrics(values: Mapping[str, Column]) -> dict[str, Column]:
    return {
        f"{name}_{i}": metric(value)
        for i, value in enumerate(values.values())
        for name, metric in _METRICS.items()
    }


def store_observed(
    df: DataFrame, metrics: Mapping[str, Column], label: str = "observed"
) -> tuple[DataFrame, dict]:
    """Store a table and return it with aggregates over its rows, all from one pass."""
    if not metrics:
        return materialize(df, label), {}
    seen = Observation()
    stored = materialize(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), label)
    return stored, seen.get


def with_statistics(
    df: DataFrame, cleaned: Mapping[str, Column] | None = None, label: str = "observed"
) -> tuple[DataFrame, Statistics]:
    """Store a table and return it with the statistics of its numeric columns.

    ``cleaned`` names columns whose statistics are those of an expression in their place, such as
    one without the numbers that stand for "unknown".
    """
    names = numeric_columns(df)
    values = {c: (cleaned or {}).get(c, as_column(c)) for c in names}
    metrics = {"rows": F.count(F.lit(1)), **_metrics(values)}
    stored, found = store_observed(df, metrics, label)
    return stored, _statistics(found, names, integer_columns(df), float_columns(df))


def _statistics(found: Mapping, names, integers, floats) -> Statistics:
    columns = {c: {m: found[f"{m}_{i}"] for m in _METRICS} for i, c in enumerate(names)}
    return Statistics(found["rows"], columns, tuple(integers), tuple(floats))


def convert_observed(
    texts: DataFrame,
    types: Mapping[str, str],
    cleaned: Mapping[str, Column] | None = None,
    label: str = "csv",
) -> tuple[DataFrame, Statistics]:
    """Store a table of texts in its types, with its statistics, in the one pass that parses it.

    Unlisted columns are stored as text; whether they read as numbers, and the statistics of
    their numbers, come from the same pass, and they are cast when they are read.
    """
    unlisted = [c for c in texts.columns if c not in types]
    typed = texts.select(*[as_column(c).cast(types.get(c, "string")).alias(c) for c in texts.columns])
    values = {c: as_column(c) for c in numeric_columns(typed)}
    values |= {c: as_column(c).try_cast("double") for c in unlisted}
    values |= {c: e for c, e in (cleaned or {}).items() if c in values}
    checks = {f"check_{n}": e for n, e in text_checks(unlisted).items()}
    metrics = {"rows": F.count(F.lit(1)), **_metrics(values), **checks}
    stored, found = store_observed(typed, metrics, label)
    kinds = {
        c: kind_of({n: found[f"check_{n}_{i}"] for n in ("missing", "no_int", "no_num")})
        for i, c in enumerate(unlisted)
    }
    table = stored.select(*[as_column(c).cast(kinds[c]).alias(c) if c in kinds else as_column(c)
                            for c in stored.columns])
    every = _statistics(found, values, integer_columns(table), float_columns(table))
    numbers = numeric_columns(table)
    return table, replace(every, columns={c: every.columns[c] for c in numbers})


def load_loan_observed(
    spark: SparkSession, directory: str, name: str, cleaned: Mapping[str, Column] | None = None
) -> tuple[DataFrame, Statistics]:
    """One of the eight loan-history CSV tables and its statistics, from the pass that converts it."""
    texts = csv_texts(spark, f"{directory}/{TABLE_FILES[name]}")
    return convert_observed(texts, known_types(name), cleaned, name)

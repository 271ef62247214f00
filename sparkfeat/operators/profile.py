"""Column ranges, type classes, type narrowing and shape guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions.missing import as_column

# A column gets the first class whose open interval holds its minimum and maximum.
INTEGER_BOUNDS = {
    "int8": (-128, 127),
    "int16": (-32768, 32767),
    "int32": (-2147483648, 2147483647),
    "int64": (-9223372036854775808, 9223372036854775807),
}
FLOAT_BOUNDS = {"float16": 65504.0, "float32": 3.4028234663852886e38}

NARROW_TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint"}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _INTEGERS)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _FLOATS)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _class_of(low, high, integer: bool):
    """Type class as an expression over the observed minimum and maximum."""
    label = F.when(F.lit(False), F.lit(""))
    if integer:
        for name, (floor, ceiling) in INTEGER_BOUNDS.items():
            label = label.when((low > F.lit(floor)) & (high < F.lit(ceiling)), name)
        return label.otherwise("int64")
    for name, bound in FLOAT_BOUNDS.items():
        label = label.when((low > F.lit(-bound)) & (high < F.lit(bound)), name)
    return label.otherwise("float64")


def float_class(low: float | None, high: float | None) -> str:
    """Type class of a float column with a known range."""
    for name, bound in FLOAT_BOUNDS.items():
        if low is not None and high is not None and low > -bound and high < bound:
            return name
    return "float64"


def range_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: name, minimum, maximum and type class.

    One aggregate over all columns, then one small row is turned into rows.
    """
    integers = set(integer_columns(df))
    columns = columns or [c for c in df.columns if c in integers or c in float_columns(df)]
    bounds = df.agg(
        *[f(as_column(c)).alias(f"{n}_{i}") for i, c in enumerate(columns)
          for n, f in (("low", F.min), ("high", F.max))]
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"low_{i}").cast("double").alias("min_value"),
            F.col(f"high_{i}").cast("double").alias("max_value"),
            _class_of(F.col(f"low_{i}"), F.col(f"high_{i}"), c in integers).alias("type_class"),
        )
        for i, c in enumerate(columns)
    ]
    return bounds.select(F.inline(F.array(*entries)))


def classes_of_ranges(
    ranges: dict[str, tuple[float | None, float | None]], integers: set[str]
) -> dict[str, str]:
    """Type class of columns with known minimum and maximum."""

    def class_of(c, low, high):
        if c not in integers:
            return float_class(low, high)
        fits = [n for n, (a, b) in INTEGER_BOUNDS.items() if low is not None and a < low and high < b]
        return fits[0] if fits else "int64"

    return {c: class_of(c, *ends) for c, ends in ranges.items()}


def profile_rows(spark: SparkSession, ranges: dict, integers: set[str]) -> DataFrame:
    """The rows of :func:`range_profile` from known ranges."""
    number = lambda x: None if x is None else float(x)
    classes = classes_of_ranges(ranges, integers)
    rows = [(c, number(low), number(high), classes[c]) for c, (low, high) in ranges.items()]
    schema = "column_name string, min_value double, max_value double, type_class string"
    return spark.createDataFrame(rows, schema)


def type_classes(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Type class per numeric column; one job, one row per column on the driver."""
    return {r["column_name"]: r["type_class"] for r in range_profile(df, columns).collect()}


def narrow(df: DataFrame, classes: dict[str, str] | None = None) -> DataFrame:
    """Cast integer columns to the smallest type that holds them; floats stay double."""
    classes = classes if classes is not None else type_classes(df, integer_columns(df))
    casts = {c: NARROW_TYPES[k] for c, k in classes.items() if k in NARROW_TYPES}
    return df.withColumns({c: as_column(c).cast(kind) for c, kind in casts.items()})


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def check_same_rows(before: DataFrame, after: DataFrame) -> int:
    """Raise unless a join left the number of rows unchanged; returns the count."""
    expected, got = before.count(), after.count()
    if expected != got:
        raise ValueError(f"row count changed from {expected} to {got}")
    return got

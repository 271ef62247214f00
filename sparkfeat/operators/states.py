"""Aggregate states that merge: appended history costs a scan of what was appended.

A state has one row per key and part of the history, and for every column the number of present
values, their sum, least and largest value, and the sum of squared distances from their mean.
States of several parts merge into that of all rows; minimum, maximum, mean, sum, variance,
counts and category rates come from the merged state alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column, nan_to_null
from sparkfeat.operators.aggregate import Levels, Spec, level_name, output_name
from sparkfeat.operators.columns import check_distinct_names
from sparkfeat.operators.profile import integer_columns

ROWS = "__rows"


def _moments(value: Column, kind: str) -> Column:
    value = value if kind == "bigint" else nan_to_null(value.cast("double"))
    return F.struct(
        F.count(value).alias("n"),
        F.coalesce(F.sum(value), F.lit(0)).cast(kind).alias("sum"),
        F.min(value).cast(kind).alias("low"),
        F.max(value).cast(kind).alias("high"),
        F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("spread"),
    )


def partial_state(
    df: DataFrame, key: str, columns: Sequence[str], levels: Levels | None = None
) -> DataFrame:
    """The state of one part of a history: one scan, combined before the shuffle.

    ``levels`` adds the number of rows with each category level (``None`` is a missing value).
    Rows without a key are left out. Sums of integer columns stay integers.
    """
    integers = set(integer_columns(df))
    kinds = {c: "bigint" if c in integers else "double" for c in columns}
    hits = {
        level_name(c, v): F.count_if(as_column(c).isNull() if v is None else as_column(c) == F.lit(v))
        for c, found in (levels or {}).items()
        for v in found
    }
    check_distinct_names([key, ROWS, *kinds, *hits])
    present = df.where(as_column(key).isNotNull())
    return present.groupBy(as_column(key)).agg(
        F.count(F.lit(1)).alias(ROWS),
        *[_moments(as_column(c), kind).alias(c) for c, kind in kinds.items()],
        *[count.alias(n) for n, count in hits.items()],
    )


def _merged(parts: Column, kind: str) -> Column:
    """The moments of all rows from those of the parts, added in the order of the parts."""
    nothing = F.struct(
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast(kind).alias("sum"),
        F.lit(None).cast(kind).alias("low"),
        F.lit(None).cast(kind).alias("high"),
        F.lit(0.0).alias("spread"),
    )

    def add(a: Column, b: Column) -> Column:
        both = a["n"] + b["n"]
        apart = b["sum"] / b["n"] - a["sum"] / a["n"]
        between = F.when((a["n"] > 0) & (b["n"] > 0), apart * apart * a["n"] * b["n"] / both)
        return F.struct(
            both.alias("n"),
            (a["sum"] + b["sum"]).alias("sum"),
            F.least(a["low"], b["low"]).alias("low"),
            F.greatest(a["high"], b["high"]).alias("high"),
            (a["spread"] + b["spread"] + F.coalesce(between, F.lit(0.0))).alias("spread"),
        )

    return F.aggregate(parts, nothing, add)


def merge_states(states: Sequence[DataFrame], key: str) -> DataFrame:
    """One state from those of disjoint parts, in their order; columns must agree.

    A key's states, one a part, meet in one row; to keep them few, store merged states.
    """
    tagged = [s.withColumn("__part", F.lit(f"{i:09d}")) for i, s in enumerate(states)]
    return _merge(reduce(DataFrame.unionByName, tagged), key)


def _merge(rows: DataFrame, key: str) -> DataFrame:
    kinds = {
        f.name: f.dataType["sum"].dataType.simpleString()
        for f in rows.schema
        if f.dataType.typeName() == "struct"
    }
    counts = [c for c in rows.columns if c not in (key, "__part", *kinds)]
    listed = {
        c: F.array_sort(F.collect_list(F.struct("__part", as_column(c).alias("state")))) for c in kinds
    }
    grouped = rows.groupBy(as_column(key)).agg(
        *[F.sum(as_column(c)).alias(c) for c in counts], *[e.alias(c) for c, e in listed.items()]
    )
    order = [c for c in rows.columns if c != "__part"]
    return grouped.withColumns(
        {c: _merged(as_column(c)["state"], kind) for c, kind in kinds.items()}
    ).select(*[as_column(c) for c in order])


def finish(
    state: DataFrame, key: str, spec: Spec, *, prefix: str = "", levels: Levels | None = None,
    count_as: str | None = None,
) -> DataFrame:
    """The columns that ``aggregate`` gives for a specification, from a state alone.

    Sums over no values are 0, other aggregates of none are NULL, and so are results that
    infinite values leave undefined.
    """

    def result(c: str, function: str) -> Column:
        m = as_column(c)
        if function == "size":
            return as_column(ROWS)
        made = {
            "min": m["low"],
            "max": m["high"],
            "sum": m["sum"],
            "mean": F.when(m["n"] > 0, m["sum"] / m["n"]),
            "var": F.when(m["n"] > 1, m["spread"] / (m["n"] - 1)),
        }
        if function not in made:
            raise ValueError(f"a state does not hold {function}")
        value = made[function]
        is_float = state.schema[c].dataType["sum"].dataType.simpleString() == "double"
        return nan_to_null(value) if is_float or function in ("mean", "var") else value

    outputs = [
        result(c, f).alias(output_name(prefix, c, f)) for c, functions in spec.items() for f in functions.split()
    ]
    for c, found in (levels or {}).items():
        for v in found:
            rate = as_column(level_name(c, v)) / as_column(ROWS)
            outputs.append(rate.alias(output_name(prefix, level_name(c, v), "mean")))
    if count_as:
        outputs.append(as_column(ROWS).alias(count_as))
    return state.select(as_column(key), *outputs)


def append_state(state: DataFrame, folder: str, part: str) -> None:
    """Store the state of a part under its name; storing it again replaces it, so a run that was
    lost half-way may simply be repeated."""
    state.write.mode("overwrite").parquet(f"{folder}/part={part}")


def merged_state(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The state of all parts that a folder holds, merged in the order of their names."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/part=*")
    return _merge(rows.withColumn("__part", F.col("part").cast("string")).drop("part"), key)

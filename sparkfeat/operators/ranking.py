"""Exact order statistics of groups of any size, without one task for a group.

The distinct values of all groups, with their numbers of rows, are dealt out by ranges of
(group, value) and stored with the number of their range. A large group then spans many parts, a
small one shares a part. Sums per group and part say what lies before a part. From rank to value,
a running count is made only inside the parts that hold a wanted rank; from value to rank, inside
every part. Two shuffles for any size, type and distribution of values, and nothing goes through
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column
from sparkfeat.sources.store import materialize

Ranks = Callable[[Column], Sequence[Column]]


def _in_parts(rows: DataFrame, by: list[str], totals: list[Column]) -> DataFrame:
    """Distinct values with ``totals`` over their rows and the ``part``, the range they lie in."""
    counted = rows.groupBy(*by, "value").agg(*totals)
    dealt = counted.repartitionByRange(*by, "value")
    return materialize(dealt.withColumn("part", F.spark_partition_id()), "ranked")


def _before(*by: str):
    """All rows of a group that come before a part."""
    return Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def values_at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: Ranks) -> DataFrame:
    """The values at given ranks of each group: columns ``by``, ``slot``, ``value``.

    ``ranks`` turns the group's number of present values into 1-based ranks; ``slot`` is the
    position in that list. Ranks outside the group give no row. Values keep their type. Rows
    with a missing group or value are left out.
    """
    if {"slot", "value"} & set(by):
        raise ValueError("group columns may not be called slot or value")
    names = {f"__group_{i}": c for i, c in enumerate(by)}
    by = list(names)
    rows = df.select(
        *[as_column(c).alias(g) for g, c in names.items()], as_column(value).alias("value")
    )
    for c in [*by, "value"]:
        rows = rows.where(as_column(c).isNotNull())
    parts = _in_parts(rows, by, [F.count(F.lit(1)).alias("weight")])
    # One row for each part and each end of a group inside a part.
    sums = parts.groupBy(*by, "part").agg(F.sum("weight").alias("inside"))
    wanted = F.posexplode(F.array(*[r.cast("bigint") for r in ranks(F.col("n"))]))
    holding = (
        sums.withColumns(
            {
                "before": F.coalesce(F.sum("inside").over(_before(*by)), F.lit(0)),
                "n": F.sum("inside").over(Window.partitionBy(*by)),
            }
        )
        .select(*by, "part", "before", "inside", wanted.alias("slot", "rank"))
        .withColumn("rank", F.col("rank") - F.col("before"))
        .where(F.col("rank").between(F.lit(1), F.col("inside")))
        .groupBy(*by, "part")
        .agg(F.collect_list(F.struct("slot", "rank")).alias("ranks"))
    )
    order = Window.partitionBy("part", *by).orderBy("value")
    running = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        parts.join(holding, [*by, "part"])
        .withColumn("last", running)
        .select(*by, "value", "weight", "last", F.inline("ranks"))
        .where((F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("weight")))
        .select(*by, "slot", "value")
        .withColumnsRenamed(names)
    )


def median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact median per group, the mean of the two middle values: columns ``by``, ``median``."""

    def middle(n: Column) -> list[Column]:
        return [F.floor((n + 1) / 2), F.floor(n / 2) + 1]

    found = values_at_ranks(df, by, value, middle)
    return found.groupBy(*by).agg((F.sum("value").cast("double") / 2).alias("median"))


def running_counts(
    df: DataFrame, by: Sequence[str], value: str, counts: Mapping[str, Column]
) -> DataFrame:
    """How many rows of each group lie at every value and below it.

    ``counts`` names conditions. The result has the columns ``by``, ``value``, and for every name
    the group's rows at this value that meet its condition and, as ``NAME_below``, those at
    smaller values: with ``{"n": F.lit(True)}`` ranks run from ``n_below + 1`` to
    ``n_below + n``. Rows with a missing group or value are left out.
    """
    clashes = {"value", *counts, *(f"{n}_below" for n in counts)} & set(by)
    if clashes:
        raise ValueError(f"group columns may not be called {sorted(clashes)}")
    names = {f"__group_{i}": c for i, c in enumerate(by)}
    inner = {f"__count_{i}": n for i, n in enumerate(counts)}
    keys = list(names)
    rows = df.select(
        *[as_column(c).alias(g) for g, c in names.items()],
        as_column(value).alias("value"),
        *[counts[n].alias(c) for c, n in inner.items()],
    )
    for c in [*keys, "value"]:
        rows = rows.where(as_column(c).isNotNull())
    parts = _in_parts(rows, keys, [F.count_if(c).alias(c) for c in inner])
    sums = parts.groupBy(*keys, "part").agg(*[F.sum(c).alias(c) for c in inner])
    starts = sums.select(
        *keys, "part", *[F.coalesce(F.sum(c).over(_before(*keys)), F.lit(0)).alias(f"{c}_start") for c in inner]
    )
    inside = Window.partitionBy("part", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = [
        (F.col(f"{c}_start") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{n}_below")
        for c, n in inner.items()
    ]
    return parts.join(starts, [*keys, "part"]).select(
        *[F.col(g).alias(c) for g, c in names.items()],
        "value",
        *[F.col(c).alias(n) for c, n in inner.items()],
        *below,
    )

"""Left joins to tables with unique keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column, ieee_div, quoted
from sparkfeat.operators.columns import check_distinct_names
from sparkfeat.sources.store import materialize

# A key is hot if it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE.
HOT_SHARE = 1000
# Tasks that the rows of one hot key are dealt out to.
SALTS = 64
# A table with at least as many columns besides the key is joined as one struct.
PACKED_COLUMNS = 16


def _packed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns but the key as one struct if they are many, and what unpacks them."""
    columns = [c for c in df.columns if c != key]
    if len(columns) < PACKED_COLUMNS:
        return df, [quoted(c) for c in columns]
    whole = f"struct({', '.join(quoted(c) for c in columns)}) AS {name}"
    return df.selectExpr(quoted(key), whole), [f"{name}.{quoted(c)} AS {quoted(c)}" for c in columns]


def assemble(entities: DataFrame, key: str, features: Sequence[DataFrame]) -> DataFrame:
    """Left-join feature tables, one row per key each, to the entity table.

    The feature tables come out of an aggregation by the key, so they are already partitioned
    on it and only the entity table moves. A wide table goes through sorts and joins as one struct,
    so that no join of the chain copies hundreds of columns one by one. Overlapping column names
    are an error.
    """
    names = [*entities.columns, *[c for f in features for c in f.columns if c != key]]
    check_distinct_names(names)
    if not features:
        return entities
    tables, fields = zip(*[_packed(t, key, f"__table_{i}") for i, t in enumerate([entities, *features])])
    joined = reduce(lambda left, right: left.join(right, key, "left"), tables)
    return joined.selectExpr(quoted(key), *[f for table in fields for f in table])


def join_shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all column names that both sides have; they identify a row of ``right``."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no shared columns to join on")
    return lookup(left, right, shared)


def _without_nulls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(reduce(and_, [as_column(k).isNotNull() for k in keys]))


def join_counted(rows: DataFrame, table: DataFrame, key: str | Sequence[str], count: str) -> DataFrame:
    """Left-join a table with one row per key of ``rows`` and the number of rows it stands for.

    Rows without a key stay in place. The table's rows of hot keys, fewer than HOT_SHARE, are
    copied to every part of a hash of the row (``__salt``), so that a hot key is dealt out to
    many tasks; how both joins run follows from the sizes in bytes.
    """
    keys = [key] if isinstance(key, str) else list(key)
    table = materialize(table, "counted")
    sizes = table.agg(F.sum(count).alias("total"), F.max(count).alias("largest")).first()
    total, largest = sizes["total"] or 0, sizes["largest"] or 0
    present = _without_nulls(rows, keys)
    no_key = reduce(or_, [as_column(k).isNull() for k in keys])
    keyless = rows.where(no_key).withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name not in keys}
    )
    limit = total // HOT_SHARE
    if largest <= limit:
        return present.join(table, keys, "left").unionByName(keyless)
    is_hot = F.col(count) > F.lit(limit)
    names = table.where(is_hot).select(*keys)
    copies = table.where(is_hot).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = present.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    warm = salted.join(copies, [*keys, "__salt"], "inner").drop("__salt")
    others = present.join(F.broadcast(names), keys, "left_anti")
    joined = warm.unionByName(others.join(table.where(~is_hot), keys, "left"))
    return joined.unionByName(keyless)


def lookup(rows: DataFrame, table: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left-join a lookup table with unique keys.

    Spark chooses the join from the table's size, and splits the rows of a hot key between tasks
    where it meets them in a sorted join.
    """
    return rows.join(table, [key] if isinstance(key, str) else list(key), "left")


def with_group_rate(
    df: DataFrame,
    key: str,
    hits,
    *,
    total_as: str,
    hits_as: str,
    rate_as: str,
) -> DataFrame:
    """Add to every row its key's number of rows, number of rows with ``hits``, and their ratio.

    A key without hits has NULL in the hit count and the ratio, as after a left join to the
    filtered rows.
    """
    counts = (
        df.where(as_column(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias(total_as),
            F.nullif(F.count_if(hits), F.lit(0)).alias(hits_as),
        )
        .withColumn(rate_as, ieee_div(hits_as, total_as))
    )
    return join_counted(df, counts, key, total_as)


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps one row per key and task before the shuffle (a group limit below the window),
    so a key with many rows does not travel.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__position", F.row_number().over(first)).where(
        F.col("__position") == 1
    ).drop("__position")


def any_per_key(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row of each key, whichever; for rows that agree in all columns that matter."""
    return df.dropDuplicates([key] if isinstance(key, str) else list(key))

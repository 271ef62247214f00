"""Category levels beyond what columns can hold: numbered levels and one sparse vector per key.

Levels are numbered by a stored table that is joined to counted rows, so there may be any number
of them; nothing that grows with it passes the driver. A key's vector holds the share of each of
its levels among its rows, as the dense rate columns do for few levels.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column
from sparkfeat.operators.aggregate import rates_long
from sparkfeat.operators.encode import column_levels, level_catalogue
from sparkfeat.operators.profile import string_columns
from sparkfeat.sources.store import materialize


@dataclass(frozen=True)
class LevelIndex:
    """A stored table (``column``, ``level``, ``index``) and the number of its rows.

    Every column has its levels in sort order and one row for missing values after them.
    """

    table: DataFrame
    size: int


def wide_columns(df: DataFrame, most: int) -> list[str]:
    """String columns with more than ``most`` levels; one row a column comes to the driver."""
    names = string_columns(df)
    if not names:
        return []
    counts = column_levels(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    wide = {r["column"] for r in counts.where(F.col("n") > most).collect()}
    return [c for c in names if c in wide]


def level_index(levels: DataFrame) -> LevelIndex:
    """Numbers for a table of distinct levels as ``encode.level_catalogue`` gives it."""
    stored = materialize(levels, "levels")
    sizes = stored.groupBy("column").agg(F.max("ordinal").alias("last")).orderBy("column").collect()
    starts, size = [], 0
    for row in sizes:
        starts.append((row["column"], size, size + row["last"] + 1))
        size += row["last"] + 2
    offsets = stored.sparkSession.createDataFrame(starts, "column string, start int, missing int")
    known = stored.join(offsets, "column").select(
        "column", "level", (F.col("start") + F.col("ordinal")).alias("index")
    )
    missing = offsets.select("column", F.lit(None).cast("string").alias("level"), F.col("missing").alias("index"))
    return LevelIndex(materialize(known.unionByName(missing), "level-numbers"), size)


def _entry(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector in the form in which MLlib stores it."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).cast("int").alias("size"),
        indices.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )


def sparse_vectors(rates: DataFrame, key: str, index: LevelIndex, into: str = "levels") -> DataFrame:
    """One row per key with the sparse vector of its rates (rows of ``rates_long``).

    A level that the index lacks is left out. The vector has the stored form of a vector column;
    see ``store.materialize`` for reading it as one, and :func:`or_empty` for keys without rows.
    """
    same = (F.col("r.column") == F.col("i.column")) & F.col("r.level").eqNullSafe(F.col("i.level"))
    found = rates.alias("r").join(index.table.alias("i"), same)
    entries = F.sort_array(F.collect_list(F.struct("i.index", "r.rate")))
    grouped = found.groupBy(F.col(f"r.{key}").alias(key)).agg(entries.alias("__entries"))
    vector = _entry(index.size, F.col("__entries.index"), F.col("__entries.rate"))
    return grouped.select(as_column(key), vector.alias(into))


def or_empty(vector: Column, size: int) -> Column:
    return F.coalesce(vector, _entry(size, F.array(), F.array()))


def entries(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The entries of stored vectors as rows: key, ``index``, ``value``."""
    inner = F.unwrap_udt(as_column(vector))
    pairs = F.arrays_zip(inner.getField("indices").alias("index"), inner.getField("values").alias("value"))
    return df.select(as_column(key), F.inline(pairs).alias("index", "value"))


def wide_rates(
    tables: Mapping[str, DataFrame], wide: Mapping[str, list[str]], key: str
) -> tuple[DataFrame, DataFrame]:
    """Rates and levels of the wide columns of several tables, columns named ``TABLE.COLUMN``."""
    rates, levels = [], []
    for name, columns in wide.items():
        if columns:
            named = F.concat(F.lit(f"{name}."), F.col("column")).alias("column")
            rates.append(rates_long(tables[name], key, columns).select(as_column(key), named, "level", "rate"))
            levels.append(level_catalogue(tables[name], columns).select(named, "level", "ordinal"))
    return reduce(DataFrame.unionByName, rates), reduce(DataFrame.unionByName, levels)

"""Repeatable splits and folds that depend only on row ids and a seed.

A row's position is a 52-bit hash of ``seed:id``, so a split does not depend on partitioning,
file order or task retries. Exact shares per class come from the number at a given rank (see
``ranking``). The hash is xxHash64; with ``portable`` it is taken from the MD5
digest, which costs more but which any other engine can reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column
from sparkfeat.operators.ranking import Ranks, values_at_ranks
from sparkfeat.sources.store import materialize

# Fixed value: the seed of all splits.
SEED = 314
HASH_RANGE = 2**52
NUMBER, CLASS = "__number", "__class"


def hash_number(key, seed: int = SEED, portable: bool = False) -> Column:
    """Uniform number in [0, 2**52) of an id."""
    text = F.concat(F.lit(f"{seed}:"), as_column(key).cast("string"))
    if portable:
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(text), 12)


def hash_split(
    df: DataFrame,
    key: str,
    share: float,
    seed: int = SEED,
    into: str = "in_first",
    portable: bool = False,
) -> DataFrame:
    """Mark about ``share`` of the rows; no job, no shuffle."""
    return df.withColumn(into, hash_number(key, seed, portable) < F.lit(round(share * HASH_RANGE)))


def _numbered(df: DataFrame, key: str, seed: int, portable: bool) -> DataFrame:
    return df.withColumn(NUMBER, hash_number(key, seed, portable))


def _with_cuts(numbered: DataFrame, label: str, ranks: Ranks, cuts: int) -> DataFrame:
    """The rows with the hash numbers at the given ranks of their class, ``__cut_0`` and on.

    The cuts are one stored row for each class; how they are joined follows from their size.
    """
    classes = numbered.select(as_column(label).alias(CLASS), NUMBER)
    found = values_at_ranks(classes, [CLASS], NUMBER, ranks)
    wide = found.groupBy(CLASS).agg(
        *[F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"__cut_{i}") for i in range(cuts)]
    )
    table = materialize(wide, "cuts")
    return numbered.join(table, as_column(label) == F.col(CLASS), "left")


def _at_most(cut: int) -> Column:
    """True for rows whose number is at or below the cut of their class."""
    return F.coalesce(F.col(NUMBER) <= F.col(f"__cut_{cut}"), F.lit(False))


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    share: float = 0.2,
    seed: int = SEED,
    into: str = "is_test",
    portable: bool = False,
) -> DataFrame:
    """Mark exactly ``round(share * n)`` rows of each class, those with the lowest numbers.

    Rows that share an id fall on the same side.
    """

    def cut(n: Column) -> list[Column]:
        return [F.floor(n * F.lit(share) + F.lit(0.5))]

    rows = _with_cuts(_numbered(df, key, seed, portable), label, cut, 1)
    return rows.withColumn(into, _at_most(0)).select(*df.columns, into)


def k_fold(
    df: DataFrame,
    key: str,
    label: str,
    folds: int = 3,
    seed: int = SEED,
    into: str = "fold",
    portable: bool = False,
) -> DataFrame:
    """Number of the fold of each row; folds of a class differ by at most one row in size."""

    def ends(n: Column) -> list[Column]:
        return [F.floor(n * F.lit(i) / F.lit(folds)) for i in range(1, folds)]

    rows = _with_cuts(_numbered(df, key, seed, portable), label, ends, folds - 1)
    fold = F.lit(folds - 1)
    for i in reversed(range(folds - 1)):
        fold = F.when(_at_most(i), F.lit(i)).otherwise(fold)
    return rows.withColumn(into, fold.cast("int")).select(*df.columns, into)


def undersample(
    df: DataFrame, key: str, label: str, seed: int = SEED, portable: bool = False
) -> DataFrame:
    """All rows of the smallest class and equally many of every other class."""
    present = df.where(as_column(label).isNotNull())
    smallest = present.groupBy(label).count().agg(F.min("count")).first()[0]
    if smallest is None:
        return present
    numbered = _numbered(present, key, seed, portable)
    rows = _with_cuts(numbered, label, lambda n: [F.lit(smallest)], 1)
    return rows.where(_at_most(0)).select(*df.columns)

"""Bitmaps of hashed values, bounded in size: rows that cannot meet a join stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, and words of 64 bits in a row of it: at most 2^18 rows of 72 bytes.
BITS, WORDS = 1 << 27, 8


def _place(columns: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Row of the bitmap, word in the row and the word's bit that the values of the columns have."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(BITS))
    word = F.floor(bit / 64)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    return F.floor(word / WORDS), word % WORDS, mask


def bitmap(values: DataFrame, *columns: str) -> DataFrame:
    """Rows (chunk, w0, w1 ...): the bit at the hash of every value of the columns is set.

    Words are combined before they are dealt out, so a frequent value does not travel.
    """
    chunk, word, mask = _place(columns)
    words = [F.bit_or(F.when(word == i, mask).otherwise(F.lit(0))).alias(f"w{i}") for i in range(WORDS)]
    return values.groupBy(chunk.alias("chunk")).agg(*words)


def with_possible(rows: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """The rows with a column ``possible``, false only if no row of ``values`` has their values.

    Both tables have the columns. A row without a partner may be called possible, with the
    probability that its bit is set by another value: 0.04 at 5 million values. With far more values
    than bits all rows are possible and nothing is spared, so a join must follow in any case.
    """
    chunk, word, mask = _place(columns)
    held = F.coalesce(*(F.when(word == i, F.col(f"w{i}")) for i in range(WORDS)))
    return (
        rows.withColumn("chunk", chunk)
        .join(F.broadcast(bitmap(values, *columns)), "chunk", "left")
        .withColumn("possible", F.coalesce(held.bitwiseAND(mask) != 0, F.lit(False)))
        .drop("chunk", *(f"w{i}" for i in range(WORDS)))
    )

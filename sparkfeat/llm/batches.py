"""Arrow batches inside tasks: bounded slices of text, words as dictionary codes, bounded caches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task works on; a single longer text is a step of its own.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only ``doc_id``, ``text`` and the named columns, so that other columns cannot clash."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *columns)


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows as a struct ``row`` of all columns but the text, the ``text``, and more columns.

    Columns added beside them cannot clash with the table's own; see :func:`unwrapped`.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"), *more)


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(
        *(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns)
    )


def text_array(column: pa.Array) -> pa.Array:
    """The texts of a column, empty where missing."""
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES):
    """The batches cut into runs of rows with at most ``limit`` bytes in ``column``."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_slices(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    column: str = "text",
    prepare: Callable[[], None] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``function`` to bounded slices of rows inside the tasks, without a shuffle."""

    def run(batches):
        one_thread()
        if prepare is not None:
            prepare()
        for part in slices(batches, column, limit):
            yield function(part)

    return df.mapInArrow(run, schema)


def one_thread() -> None:
    """A task owns one core: keep the libraries inside it from starting threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    pa.set_cpu_count(1)


def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets, a code for every word, and the distinct words of a column of word lists."""
    encoded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def by_space(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What stands between single spaces, empty strings included."""
    return coded(pc.split_pattern(texts, " "))


def by_white_space(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words ``[^\\x20\\x09-\\x0D]+``."""
    offsets, codes, words = coded(pc.ascii_split_whitespace(texts))
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
        codes = codes[keep]
    return offsets, codes, words


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the values of every row; 0 for a row without values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the runs ``starts[i] : starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class Recent:
    """A mapping that forgets what has not been asked for among the latest new keys.

    It holds two generations; one ends with ``size`` keys or ``characters`` characters in them.
    """

    def __init__(self, size: int, characters: int):
        self.size, self.characters = size, characters
        self.young, self.old, self.held = {}, {}, 0

    def _add(self, key, value) -> None:
        if key not in self.young:
            self.held += len(key)
        self.young[key] = value

    def get_many(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of ``keys``; those not known come from one call of ``make``."""
        young, old = self.young, self.old
        values = [young.get(k) for k in keys]
        missing = []
        for i, value in enumerate(values):
            if value is None:
                value = old.get(keys[i])
                if value is None:
                    missing.append(i)
                else:
                    values[i] = value
                    self._add(keys[i], value)
        for i, value in zip(missing, make([keys[i] for i in missing])):
            values[i] = value
            self._add(keys[i], value)
        if len(young) > self.size or self.held > self.characters:
            self.old, self.young, self.held = young, {}, 0
        return values

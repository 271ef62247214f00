"""Operator 5: shards by jump consistent hashing, with a gapless place in every shard."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfeat.llm.batches import map_slices, text_array, texts_of
from sparkfeat.sources.store import materialize

#: The multiplier of the published jump hash, and bytes added to every row's size.
MULTIPLIER, ROW_BYTES = 2862933555777941757, 8
#: Stands for a missing key.
NO_KEY = -(2**63)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key, by the published recurrence, all keys at once.

    A key's place is a chain of jumps of its own random sequence; appending a shard changes only
    keys that jump exactly to it, an expected 1 / (shards + 1) of them.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(keys), np.int64)
    active = np.arange(len(keys))
    target = np.zeros(len(keys), np.int64)
    while len(active):
        out[active] = target[active]
        with np.errstate(over="ignore"):
            state[active] = state[active] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = (1 << 31) / ((state[active] >> np.uint64(33)).astype(np.float64) + 1)
        target[active] = np.floor((out[active] + 1) * step).astype(np.int64)
        active = active[target[active] < shards]
    return out


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and grown_shard of every row, from one scan."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_array(batch.column("text"))
        crc = [zlib.crc32(t.as_buffer() or b"") for t in texts]
        ids = batch.column("doc_id").cast(pa.int64())
        keys = pc.fill_null(ids, NO_KEY).to_numpy(zero_copy_only=False)
        return pa.record_batch(
            [
                ids, pc.add(pc.binary_length(texts).cast(pa.int64()), ROW_BYTES),
                pa.array(crc, pa.int64()),
                pa.array(jump_hash(keys, shards), pa.int32()),
                pa.array(jump_hash(keys, shards + 1), pa.int32()),
            ],
            names=["doc_id", "size", "text_crc32", "shard", "grown_shard"],
        )

    schema = "doc_id long, size long, text_crc32 long, shard int, grown_shard int"
    return map_slices(texts_of(docs), function, schema)


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Put every row into one of ``shards`` shards by its doc_id alone.

    ``slot`` counts the rows of a shard from 0 in the order of doc_id, size and checksum, equal
    rows in any order. ``grown_shard`` is the shard when one more is appended: the same shard or
    the new one. ``size`` is the UTF-8 bytes of the text (missing: none) plus 8.

    The rows without texts are stored, dealt by ranges of the sort key with a row number as its
    last part, so that a hot doc_id spreads over many tasks, and stored sorted. A slot is the
    row's place in its stored part plus the shard's rows in the parts before: one small count a
    part and shard, no shard passes through one task. A missing doc_id counts as the smallest
    key; repeated rows get slots of their own; an empty table gives no rows.
    """
    order = ["shard", "doc_id", "size", "text_crc32"]
    rows = materialize(
        assign(docs, shards).withColumn("row", F.monotonically_increasing_id()), "shard-rows"
    )
    placed = materialize(
        rows.repartitionByRange(*order, "row")
        .sortWithinPartitions(*order, "row")
        .drop("row")
        .withColumn("place", F.monotonically_increasing_id()),
        "shard-order",
    ).withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("shard", "part").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")
    )
    # one row for each part and each end of a shard inside a part
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return placed.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") + F.col("shift")).alias("slot"), "grown_shard",
    )

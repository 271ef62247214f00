"""Operator 1: best-fit-decreasing packing of token ids into fixed-length rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkfeat.llm.batches import one_thread, slices, text_array, texts_of
from sparkfeat.llm.tokens import TokenIds

#: Ids of a packed row, and ids that are packed together in one block of a task.
ROW_LENGTH, BLOCK_IDS = 2048, 2 << 20
#: Bytes of text tokenised at once.
TEXT_BYTES = 8 << 20

SCHEMA = (
    "sequence_id long, n_tokens int, n_segments int, ids binary, position_ids binary, "
    "cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"
)
ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()),
        ("ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
    ]
)


class Capacities:
    """A segment tree over the free space of open rows: the smallest space that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        node = space + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (space, row) with the least space of ``need`` or more."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        space = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return space, self.rows[space].pop()


def best_fit_decreasing(lengths: np.ndarray, row_length: int) -> tuple[np.ndarray, int]:
    """The row of every piece, longest pieces first, each into the fullest row that takes it."""
    rows = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == row_length).sum())
    rows[order[:full]] = np.arange(full)
    free, used = Capacities(row_length), full
    for i in order[full:].tolist():
        need = int(lengths[i])
        found = free.take(need)
        if found is None:
            found, used = (row_length, used), used + 1
        rows[i] = found[1]
        if found[0] > need:
            free.add(found[0] - need, found[1])
    return rows, used


def split_documents(lengths: np.ndarray, row_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start in the document and length of pieces of at most ``row_length``."""
    n = -(-lengths // row_length)
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * row_length
    return doc, start, np.minimum(row_length, lengths[doc] - start)


def pack_block(doc_ids, ids, ends, row_length: int, pad: int, first: int) -> pa.RecordBatch:
    """The packed rows of one block; ``ends`` are the documents' offsets among the ids."""
    doc, start, length = split_documents(np.diff(ends), row_length)
    rows, n = best_fit_decreasing(length, row_length)
    order = np.lexsort((start, doc, rows))
    doc, start, length, rows = doc[order], start[order], length[order], rows[order]
    filled = np.bincount(rows, length, minlength=n).astype(np.int64)
    place = np.cumsum(length) - length - np.repeat(np.cumsum(filled) - filled, np.bincount(rows, minlength=n))
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    target = np.repeat(rows * row_length + place, length) + inside
    matrix = np.full(n * row_length, pad, np.uint32)
    matrix[target] = ids[np.repeat(ends[:-1][doc] + start, length) + inside]
    positions = np.zeros(n * row_length, np.uint32)
    positions[target] = inside
    counts = np.bincount(rows, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    # cumulative lengths: a leading zero for every row
    cumulative = np.insert((place + length).astype(np.int32), offsets[:-1], 0)
    width = pa.binary(4 * row_length)

    def binary(array):
        return pa.Array.from_buffers(width, n, [None, pa.py_buffer(array)]).cast(pa.binary())

    return pa.record_batch(
        [
            pa.array(first + np.arange(n)), pa.array(filled.astype(np.int32)),
            pa.array(counts.astype(np.int32)), binary(matrix), binary(positions),
            pa.ListArray.from_arrays(offsets + np.arange(n + 1, dtype=np.int32), cumulative),
            pa.ListArray.from_arrays(offsets, doc_ids.take(pa.array(doc))),
            pa.ListArray.from_arrays(offsets, start),
        ],
        schema=ARROW,
    )


def pack_token_ids(
    docs: DataFrame,
    path: str,
    ranks_path: str,
    pattern: str,
    end_id: int,
    row_length: int = ROW_LENGTH,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Documents as rows of a packed id matrix, for training with segment masks.

    Every document is its ids and ``end_id``. Documents longer than a row are cut into pieces at
    multiples of the row length, nothing is lost. The pieces of a block of a task's documents
    (``block_ids`` ids, or one longer document) are packed by best fit, longest first; a segment
    tree finds the fullest row that still takes a piece. There is no shuffle: a task packs the
    documents that it reads, so only one row a block stays partly filled as a rule.

    A row: ``sequence_id`` (partition, then row within it), ``n_tokens``, ``n_segments``,
    ``ids`` (little-endian unsigned 32-bit, padded with ``end_id`` to the row length),
    ``position_ids`` (the same form; every segment counts from 0 again), ``cu_seqlens``
    (0 and the cumulative lengths of the segments), and the document and start in it of every
    segment. A missing or empty text is the end id alone; a missing doc_id stays missing;
    repeated rows are packed as often as they occur; an empty table gives no rows.
    """

    def run(batches):
        one_thread()
        tokens = TokenIds(path, ranks_path, pattern)
        base, done = TaskContext.get().partitionId() << 33, 0
        names, parts, sizes, held = [], [], [], 0

        def block():
            nonlocal names, parts, sizes, held, done
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            out = pack_block(
                pa.chunked_array(names).combine_chunks(), np.concatenate(parts), ends, row_length,
                end_id, base + done,
            )
            names, parts, sizes, held = [], [], [], 0
            done += out.num_rows
            return out

        for part in slices(batches, "text", TEXT_BYTES):
            ids, ends = tokens.encode(text_array(part.column("text")))
            names.append(part.column("doc_id").cast(pa.int64()))
            parts.append(np.insert(ids, ends[1:], end_id))
            sizes.append(np.diff(ends) + 1)
            held += len(parts[-1])
            if held >= block_ids:
                yield from parts_of(block())
        if held:
            yield from parts_of(block())

    return texts_of(docs).mapInArrow(run, SCHEMA)


def parts_of(batch: pa.RecordBatch, rows: int = 512):
    """A block in batches that are small enough to pass on."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files; a row group is an id matrix of fixed-length rows."""
    packed.write.mode("errorifexists").parquet(path)

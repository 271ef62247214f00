"""Operator 9: order-preserving packing by dynamic programming over possible cuts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkfeat.llm.batches import one_thread, slices, text_array, texts_of
from sparkfeat.llm.tokens import TokenIds

#: Ids of a window, and ids that one run of the dynamic program covers.
WINDOW, BLOCK_IDS = 1024, 1 << 20
#: In padded ids: the price of a window, of a cut after a sentence, of a cut anywhere else.
WINDOW_PRICE, SENTENCE_PRICE, INNER_PRICE = 6, 4, 12
#: Without an end of a sentence, a cut is possible after so many ids.
INNER_STEP = 32
TEXT_BYTES = 2 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long"
)


def sentence_ends(ids: np.ndarray, last: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Positions after an id that ends a sentence: a stop before white space, or a line's end."""
    stop = last[ids]
    follows = np.concatenate([blank[ids[1:]], [True]]) if len(ids) else np.zeros(0, bool)
    return np.flatnonzero((stop == 2) | ((stop == 1) & follows)) + 1


def id_classes(bytes_of: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every id: 1 if it ends with a stop, 2 if with a line feed; whether it starts blank."""
    last = np.array([2 if b[-1:] == b"\n" else int(b[-1:] in (b".", b"!", b"?")) for b in bytes_of])
    return last, np.array([b[:1] in (b" ", b"\n", b"\t", b"\r") for b in bytes_of])


def possible_cuts(doc_ends: np.ndarray, sentences: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in order, 0 first, and the price of each."""
    points = np.union1d(np.concatenate([[0], doc_ends]), sentences)
    more = (np.diff(points) - 1) // step
    inner = np.repeat(points[:-1], more) + step * (
        1 + np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    )
    cuts = np.union1d(points, inner)
    price = np.full(len(cuts), INNER_PRICE)
    price[np.searchsorted(cuts, sentences)] = SENTENCE_PRICE
    price[np.searchsorted(cuts, doc_ends)] = 0
    return cuts, price


def best_cuts(cuts: np.ndarray, price: np.ndarray, window: int) -> list[int]:
    """Indices of the cuts, from the first to the last, that cost least.

    A window costs its padding (none at a power of two), a fixed price and the price of its end.
    The sliding minimum over the starts within reach is kept in a monotone queue; starts at a
    power of two before the cut are looked up. Of equal costs the longest window wins.
    """
    n = len(cuts)
    exact: list[list[int]] = [[] for _ in range(n)]
    for bit in range(window.bit_length() - 1, -1, -1):  # longest first
        power = 1 << bit
        at = np.searchsorted(cuts, cuts - power)
        hit = np.flatnonzero((cuts >= power) & (cuts[at] == cuts - power))
        for j, i in zip(hit.tolist(), at[hit].tolist()):
            exact[j].append(i)
    places, prices = cuts.tolist(), price.tolist()
    cost, back = [0] * n, [0] * n
    queue, keys, head = [0], [0], 0
    for j in range(1, n):
        place = places[j]
        while places[queue[head]] < place - window:
            head += 1
        best, start = keys[head] + window - place, queue[head]
        for i in exact[j]:
            if cost[i] < best:
                best, start = cost[i], i
        cost[j] = best = best + WINDOW_PRICE + prices[j]
        back[j] = start
        key = best + place
        while len(queue) > head and keys[-1] > key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


def pieces_of(doc_ids, ids, ends, last, blank, window: int, first: int):
    """The pieces of one block of documents, and the number of its sequences."""
    sentences = sentence_ends(ids, last, blank)
    sentences = sentences[sentences < ends[-1]]
    cuts, price = possible_cuts(ends[1:], sentences, min(INNER_STEP, window))
    windows = cuts[best_cuts(cuts, price, window)]
    points = np.union1d(windows, ends)
    begin, stop = points[:-1], points[1:]
    doc = np.searchsorted(ends, begin, side="right") - 1
    sequence = np.searchsorted(windows, begin, side="right") - 1
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())]
    out = pa.record_batch(
        [
            doc_ids.take(pa.array(doc)), pa.array(begin - ends[doc]), pa.array(stop - begin),
            pa.array(crc, pa.int64()), pa.array(np.diff(ends)[doc]), pa.array(first + sequence),
            pa.array(begin - windows[sequence]),
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )
    return out, len(windows) - 1


def pack_windows(
    docs: DataFrame,
    path: str,
    ranks_path: str,
    pattern: str,
    end_id: int = 0,
    window: int = WINDOW,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Documents cut into windows of at most ``window`` ids without changing their order.

    The ids of a task's documents, each closed by ``end_id``, stand in the order of its rows. Per
    block (``block_ids`` ids, or one longer document) dynamic programming chooses the cuts at
    ends of documents and sentences that cost least: padding plus prices for a window and for
    cutting a document. Where a sentence is longer than 32 ids, a cut inside costs more. A
    window is padded to its full length unless its length is a power of two. No shuffle.

    One row a piece: its document, ``start`` there, ``length``, CRC-32 of its ids (little-endian
    unsigned 32-bit), ids of the document, its window and the ``offset`` there. A missing or
    empty text is the end id alone; a missing doc_id stays missing; repeated rows are packed as
    often as they occur; an empty table gives no rows.
    """

    def run(batches):
        one_thread()
        tokens = TokenIds(path, ranks_path, pattern)
        last, blank = id_classes(tokens.bytes_of)
        base, done = TaskContext.get().partitionId() << 33, 0
        names, parts, sizes, held = [], [], [], 0

        def block():
            nonlocal names, parts, sizes, held, done
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            out, n = pieces_of(
                pa.chunked_array(names).combine_chunks(), np.concatenate(parts), ends, last, blank,
                window, base + done,
            )
            names, parts, sizes, held = [], [], [], 0
            done += n
            return out

        for part in slices(batches, "text", TEXT_BYTES):
            ids, ends = tokens.encode(text_array(part.column("text")))
            names.append(part.column("doc_id").cast(pa.int64()))
            parts.append(np.insert(ids, ends[1:], end_id))
            sizes.append(np.diff(ends) + 1)
            held += len(parts[-1])
            if held >= block_ids:
                yield block()
        if held:
            yield block()

    return texts_of(docs).mapInArrow(run, SCHEMA)

"""Operator 10: n-gram Jaccard join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.batches import (
    by_white_space,
    map_slices,
    one_thread,
    text_array,
    unwrapped,
    wrapped,
)
from sparkfeat.llm.bitmaps import with_possible
from sparkfeat.llm.components import components
from sparkfeat.sources.store import materialize

#: Words of an n-gram; similarity, as a ratio of whole numbers, from which texts are linked.
WORDS, SIMILAR = 5, (4, 5)
#: Recall at that similarity, and how often texts of a low similarity may meet.
RECALL, LOW, LOW_MEETS = 0.9999, 0.3, 0.06
#: Classes and n-grams of a block of one bucket that are compared with another block at once.
BLOCK_ROWS, BLOCK_GRAMS = 256, 1_000_000
#: Columns of an incidence matrix at a time, and bytes of text of one step.
COLUMNS, TEXT_BYTES = 4096, 2 << 20


def band_shape(similar: float, recall: float, low: float, most: float) -> tuple[int, int]:
    """Bands and rows of a band: the fewest rows for which texts of low similarity seldom meet,
    and the bands that then give the recall."""
    rows = 1
    while True:
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))
        if 1 - (1 - low**rows) ** bands <= most:
            return bands, rows
        rows += 1


BANDS, ROWS = band_shape(SIMILAR[0] / SIMILAR[1], RECALL, LOW, LOW_MEETS)


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random odd factors and masks, one pair for each hash function."""
    random = np.random.Generator(np.random.PCG64(10))
    factors = random.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, random.integers(0, 1 << 32, n, dtype=np.uint32)


FACTORS, MASKS = multipliers(BANDS * ROWS)


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several in order."""
    out = np.full(len(hashes[0]), len(hashes), np.uint64)
    for h in hashes:
        out = (out + h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def gram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-grams of every text, and offsets of the texts.

    A text of fewer words than an n-gram has one, all its words; a text without words has none.
    """
    if len(texts) == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets, codes, words = by_white_space(texts)
    hashes = pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False)[codes]
    count = np.diff(offsets)
    grams = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), grams)
    ends = np.concatenate([[0], np.cumsum(grams)])
    begin = np.arange(ends[-1]) - ends[row] + offsets[row]
    short = count[row] < WORDS
    out = np.zeros(len(row), np.uint64)
    whole = begin[~short]
    out[~short] = fold([hashes[whole + i] for i in range(WORDS)]) if len(whole) else 0
    for at in np.flatnonzero(short).tolist():
        a, b = offsets[row[at]], offsets[row[at] + 1]
        out[at] = fold([hashes[i : i + 1] for i in range(a, b)])[0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    kept = np.bincount(row[new], minlength=len(count))
    return out[new], np.concatenate([[0], np.cumsum(kept)])


def class_keys(grams: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128-bit names of the sets; texts with equal sets are one class."""
    raw, cuts = memoryview(grams.tobytes()), (8 * ends).tolist()
    return [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(cuts, cuts[1:])]


def band_hashes(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows x bands hashes of the minima of all hash functions; rows without n-grams stay 0."""
    held = np.flatnonzero(np.diff(ends))
    out = np.zeros((len(ends) - 1, BANDS), np.uint64)
    if not len(held):
        return out
    small, starts = (grams >> np.uint64(32)).astype(np.uint32), ends[:-1][held]
    work = np.empty_like(small)
    minima = []
    for factor, mask in zip(FACTORS, MASKS):
        np.bitwise_xor(small, mask, out=work)
        np.multiply(work, factor, out=work)
        minima.append(np.minimum.reduceat(work, starts).astype(np.uint64))
    for band in range(BANDS):
        out[held, band] = fold(minima[band * ROWS : (band + 1) * ROWS])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """id, place, class key, number of n-grams and band hashes of every row."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, ends = gram_sets(text_array(batch.column("text")))
        bands = band_hashes(grams, ends).view(np.int64)
        n = batch.num_rows
        return pa.record_batch(
            [
                batch.column("id"), batch.column("place"),
                pa.array(class_keys(grams, ends), pa.binary()),
                pa.array(np.diff(ends).astype(np.int32)),
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, bands.ravel()),
            ],
            names=["id", "place", "class", "n", "bands"],
        )

    schema = "id long, place long, class binary, n int, bands array<long>"
    return map_slices(docs, function, schema, limit=TEXT_BYTES)


def full_sets(texts: DataFrame) -> DataFrame:
    """The n-gram set of every class, from one text of it."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, ends = gram_sets(text_array(batch.column("text")))
        raw, cuts = grams.tobytes(), (8 * ends).tolist()
        sets = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        keys = class_keys(grams, ends)
        right = [a == b for a, b in zip(keys, batch.column("class").to_pylist())]
        return pa.record_batch(
            [pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["class", "grams"]
        ).filter(pa.array(right))

    found = map_slices(texts, function, "class binary, grams binary", limit=TEXT_BYTES)
    return found.groupBy("class").agg(F.first("grams").alias("grams"))


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Common n-grams of every set before ``split`` with every set from there on.

    With ``split`` 0 all sets are compared with all. N-grams of one set alone are left out; the
    rest is an incidence matrix, multiplied a bounded number of columns at a time.
    """
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    left, right = (split or len(sets)), len(sets) - split
    out = np.zeros((left, right), np.float64)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[rows[a:b], column[a:b] - first] = 1
        out += part[:left] @ part[split:].T
    return out.astype(np.int64)


def linked_pairs(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Which sets before ``split`` are similar to which from there on; exact."""
    size = np.array([len(s) for s in sets])
    left, right = size[: split or len(sets), None], size[None, split:]
    common = overlaps(sets, split)
    return SIMILAR[1] * common >= SIMILAR[0] * (left + right - common)


def compare(group: pa.Table) -> list[tuple[bytes, int, bytes]]:
    """For every linked class of one pair of blocks: documents linked, and its group's least class.

    A pair that meets in several bands counts only in the first band where both have one hash.
    """
    first = group.slice(0, 1).to_pylist()[0]
    band, low, high = first["band"], first["low"], first["high"]
    order = np.argsort(group.column("block").to_numpy(), kind="stable")
    rows = group.take(pa.array(order)).combine_chunks()
    split = int((rows.column("block").to_numpy() == low).sum()) if low != high else 0
    if low != high and split in (0, len(rows)):
        return []
    keys = rows.column("class").to_pylist()
    copies = rows.column("copies").to_numpy()
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("grams")]
    linked = linked_pairs(sets, split)
    left = np.arange(len(keys))[: split or None]
    right = np.arange(len(keys))[split:]
    at, to = np.nonzero(linked)
    a, b = left[at], right[to]
    earlier = (bands[a, :band] == bands[b, :band]).any(axis=1) if band else np.zeros(len(a), bool)
    keep = ~earlier & (a < b if split == 0 else True)
    a, b = a[keep], b[keep]
    links = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
    root = list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(keys[i], int(links[i]), keys[find(i)]) for i in np.flatnonzero(links).tolist()]


def verified(rows: DataFrame) -> DataFrame:
    """Links and edges of all blocks; a task reads the groups of its partition one by one."""
    names = ["band", "hash", "low", "high"]

    def run(batches):
        one_thread()
        held: list[pa.Table] = []
        key = None
        out: list[tuple] = []

        def flush():
            done = pa.record_batch(
                [pa.array(list(x), t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))],
                names=["class", "links", "root"],
            )
            out.clear()
            return done

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            columns = [batch.column(n).to_numpy() for n in names]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                here = tuple(int(c[start]) for c in columns)
                if here != key and held:
                    out += compare(pa.concat_tables(held))
                    held = []
                key = here
                held.append(table.slice(start, stop - start))
            if len(out) > 10_000:
                yield flush()
        if held:
            out += compare(pa.concat_tables(held))
        if out:
            yield flush()

    dealt = rows.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "class binary, links long, root binary")


def shared_buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bucket memberships of all classes, and buckets with at least two classes.

    Buckets of different bands with the same members are kept once, in their first band.
    """
    members = classes.selectExpr("class", "n", "posexplode(bands) AS (band, hash)")
    buckets = (
        members.groupBy("band", "hash")
        .agg(
            F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"),
            F.bit_xor(F.xxhash64("class")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y"),
        )
        .where("m > 1")
        .groupBy("m", "total", "x", "y")
        .agg(F.min(F.struct("band", "hash")).alias("b"))
    )
    blocks = F.greatest(
        F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_GRAMS)
    ).cast("int")
    return members, buckets.select("b.band", "b.hash", blocks.alias("blocks"))


def order_of() -> Column:
    """Rows of a class by key, missing keys last; the place tells rows of one key apart."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "place")


def placed(docs: DataFrame) -> DataFrame:
    """The rows with the hash that tells key and text; equal rows share it."""
    return docs.withColumn("place", F.xxhash64("id", "text"))


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows of (id, text), and per class: links and component."""
    located = placed(docs.select("id", "text"))
    signed = materialize(signatures(located), "signatures")
    classes = materialize(
        signed.where("n > 0")
        .groupBy("class")
        .agg(
            F.min(order_of()).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
            F.first("place").alias("place"), F.first("bands").alias("bands"),
        ),
        "classes",
    )
    members, buckets = shared_buckets(classes)
    buckets = materialize(buckets, "buckets")
    shared = with_possible(members, buckets, "band", "hash").where("possible")
    met = materialize(
        shared.join(buckets, ["band", "hash"]).select("class", "band", "hash", "blocks"), "bucket-members"
    )
    candidates = materialize(
        met.select("class").distinct().join(classes.select("class", "place", "copies", "bands"), "class"),
        "candidates",
    )
    texts = with_possible(located.select("place", "text"), candidates, "place").where("possible")
    sets = full_sets(
        texts.join(candidates.select("place", "class"), "place").select("class", "text")
    )
    blocks = (
        met.withColumn("block", F.expr("int(pmod(xxhash64(class), blocks))"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "class", "band", "hash", "block", F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
        )
    )
    content = sets.join(candidates.select("class", "copies", "bands"), "class")
    found = materialize(verified(blocks.join(content, "class")), "links")
    near = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    grouped = (
        classes.select("class", "least", "copies")
        .join(near.toDF("class", "root"), "class", "left")
        .join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    return signed, materialize(grouped, "groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: its class of near duplicates and its number of links.

    Two documents are linked if the sets of their five-word n-grams have a Jaccard similarity of
    0.8 or more. ``class_id`` is the least key of the documents that are connected by links,
    ``n_links`` the number of documents linked to this one, copies included, ``copy_id`` the
    least key with the same n-grams.

    Documents with equal sets are one class from the start, so copies never make pairs. Classes
    that share a band hash are candidates; a large bucket is cut into blocks, and pairs of
    blocks are compared in tasks of their own on the full sets. Tasks return per class counts
    and one edge, never pairs. Bands and rows follow from the recall: at similarity 0.8 a pair
    is missed with probability 0.0001, above it less.

    A text of fewer than five words is one n-gram; a missing text or one without words is a
    class of its own without links. A missing key takes part and never names a class of others;
    repeated rows are copies; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")
    )
    signed, grouped = link_classes(rows)
    least = materialize(grouped.groupBy("root").agg(F.min("least").alias("first")), "least")
    named = grouped.join(least, "root").select(
        "class", F.col("first.id").alias("class_id"), F.col("least.id").alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return signed.select("id", "class").join(named, "class", "left").select(
        F.col("id").alias(key),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every class of near duplicates, that of the least doc_id, with all columns.

    Of equal rows, and of rows of a class that share the least doc_id, one stays; a missing doc_id
    comes after all others; rows without a word are classes of their own and all stay; an empty
    table gives no rows.
    """
    rows = placed(wrapped(docs, F.col("doc_id").cast("long").alias("id")))
    signed, grouped = link_classes(rows.select("id", "text"))
    first = grouped.groupBy("root").agg(F.min("least").alias("first")).select("first.place")
    of_classes = rows.join(first, "place", "left_semi").dropDuplicates(["place"])
    wordless = F.coalesce(F.regexp_like("text", F.lit("^[\\x20\\x09-\\x0D]*\\z")), F.lit(True))
    return unwrapped(of_classes.union(rows.select(of_classes.columns).where(wordless)), docs.columns)

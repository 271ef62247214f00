"""Operator 4: languages by a string kernel with Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkfeat.llm.batches import map_slices, text_array, texts_of, unwrapped, wrapped
from sparkfeat.sources.store import materialize

#: Bounds of the fitted sample: labelled rows in all, of one language, and landmarks in all.
SAMPLE, PER_LANGUAGE, LANDMARKS = 2048, 512, 192
#: Lengths of n-grams in bytes, bits of the n-gram space, and the ridge.
LENGTHS, BITS, RIDGE = (1, 2, 3, 4), 17, 1e-3
#: Bytes of text and rows that are scored in one matrix product.
TEXT_BYTES, ROWS = 2 << 20, 512
UNKNOWN = "und"
#: What a text needs to have a language.
LETTER = r"\p{L}"
#: Documents of this remainder of the checksum by FOLDS are held out.
FOLDS, HELD_OUT = 4, 2

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def byte_classes() -> np.ndarray:
    """Small letters and bytes of other scripts stay, everything else becomes a space."""
    table = np.full(256, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


CLASSES = byte_classes()


def grams(texts: pa.Array):
    """For every length: row and number of each n-gram; a text stands between two spaces."""
    lower = pc.utf8_lower(texts)
    _, offsets, data = lower.buffers()
    ends = np.frombuffer(offsets, np.int32)[lower.offset : lower.offset + len(lower) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends).astype(np.int64)
    starts = np.cumsum(size + 2) - (size + 2)
    padded = np.full(int((size + 2).sum()), 32, np.uint32)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size + 2)
    inside = np.ones(len(padded), bool)
    inside[starts] = inside[starts + size + 1] = False
    padded[inside] = CLASSES[raw]
    packed = np.zeros(len(padded), np.uint32)
    for n in LENGTHS:
        packed = (packed[: len(padded) - n + 1] << np.uint32(8)) | padded[n - 1 :]
        whole = row[: len(packed)] == row[n - 1 :]
        number = ((packed + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        yield row[: len(packed)][whole], number[whole]


def presence(texts: pa.Array, columns: np.ndarray, width: int) -> np.ndarray:
    """Which n-grams every text holds; ``columns`` maps n-grams to columns, -1 to none."""
    out = np.zeros((len(texts), width + 1), bool)
    for row, number in grams(texts):
        out[row, columns[number]] = True
    return out[:, :width]


class Model(NamedTuple):
    languages: list[str]
    columns: np.ndarray  # of every n-gram, -1 if no landmark holds it
    weights: np.ndarray  # columns x languages

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text; the scores of a batch are one matrix product."""
        names, scores = [], np.zeros(len(texts))
        lettered = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False)
        for i in range(0, len(texts), ROWS):
            held = presence(texts.slice(i, ROWS), self.columns, len(self.weights))
            norm = np.sqrt(np.maximum(held.sum(axis=1), 1))[:, None]
            found = held.astype(np.float32) @ self.weights / norm
            best = found.argmax(axis=1)
            scores[i : i + ROWS] = np.clip(found[np.arange(len(best)), best], 0, 1)
            names += [self.languages[b] for b in best.tolist()]
        scores[~lettered] = 0
        return [n if ok else UNKNOWN for n, ok in zip(names, lettered.tolist())], scores


def held_out(doc_id: str = "doc_id") -> Column:
    """By the checksum of the id as text; a missing id counts as empty text."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


def training_sample(docs: DataFrame) -> DataFrame:
    """At most SAMPLE labelled rows, at most PER_LANGUAGE of a language, chosen by a hash.

    Equal rows count once. Only hashes are ranked, after a threshold by the number of a
    language's distinct texts has left a few times the bound; the texts of the chosen come after.
    """
    told = docs.select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        held_out().alias("out"),
    ).where("text IS NOT NULL AND lang IS NOT NULL AND NOT out")
    rows = told.select("lang", F.xxhash64("lang", "text").alias("key"), "text")
    hashes = materialize(rows.select("lang", "key"), "language-hashes")
    sizes = materialize(
        hashes.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")), "language-sizes"
    )
    part = F.shiftrightunsigned("key", 1) / F.lit(float(1 << 63))
    rank = Window.partitionBy("lang").orderBy("key")
    chosen = (
        hashes.join(sizes, "lang")
        .where(part * F.col("n") < 3 * PER_LANGUAGE)
        .select("lang", "key")
        .distinct()
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= PER_LANGUAGE)
        .orderBy("rank", "key")
        .limit(SAMPLE)
    )
    keys = materialize(chosen, "language-keys")  # at most SAMPLE rows, so it may be broadcast
    return (
        rows.join(F.broadcast(keys), ["lang", "key"])
        .groupBy("lang", "key", "rank")
        .agg(F.first("text").alias("text"))
    )


def sample_presence(sample: DataFrame) -> list:
    """Language, rank and packed n-gram bits of the sampled texts: a fixed size for each."""
    every = np.arange(1 << BITS)

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_array(batch.column("text"))
        bits = [
            np.packbits(presence(texts.slice(i, 1), every, 1 << BITS)).tobytes()
            for i in range(len(texts))
        ]
        return pa.record_batch(
            [batch.column("lang"), batch.column("rank"), batch.column("key"), pa.array(bits, pa.binary())],
            names=["lang", "rank", "key", "bits"],
        )

    found = map_slices(sample, function, "lang string, rank int, key long, bits binary")
    return sorted(found.collect(), key=lambda r: (r.rank, r.key, r.lang))


def fit(docs: DataFrame) -> Model | None:
    """Kernel ridge regression, one language against the rest, on landmark kernels.

    The blended-spectrum presence kernel of two texts is the number of n-grams that both hold,
    over the root of the product of the numbers that each holds. Landmarks are the first sampled
    rows of every language; n-grams that no landmark holds are outside of the kernel's space.
    As the kernel is an inner product, landmark kernels and coefficients are kept multiplied.
    N-grams are told apart by a hash of 17 bits: those that share one count as one n-gram.
    """
    sample = sample_presence(training_sample(docs))
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    share = max(1, LANDMARKS // len(languages))
    marks = [i for i, r in enumerate(sample) if r.rank <= share][: max(LANDMARKS, len(languages))]

    def bits(i: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(sample[i].bits, np.uint8)).astype(bool)

    union = np.zeros(1 << BITS, bool)
    for i in marks:
        union |= bits(i)
    space = np.flatnonzero(union)
    columns = np.full(1 << BITS, -1, np.int64)
    columns[space] = np.arange(len(space))

    def rows(indices) -> np.ndarray:
        held = np.array([bits(i)[space] for i in indices], np.float32)
        return held / np.sqrt(np.maximum(held.sum(axis=1), 1))[:, None]

    landmarks = rows(marks)
    kernel = np.concatenate(
        [rows(range(i, min(i + 256, len(sample)))) @ landmarks.T for i in range(0, len(sample), 256)]
    ).astype(np.float64)
    wanted = np.array([[r.lang == name for name in languages] for r in sample], np.float64)
    between = (landmarks @ landmarks.T).astype(np.float64)
    left = kernel.T @ kernel + RIDGE * len(sample) * between + 1e-8 * np.eye(len(marks))
    coefficients = np.linalg.solve(left, kernel.T @ wanted)
    return Model(languages, columns, (landmarks.T @ coefficients).astype(np.float32))


def apply(rows: DataFrame, model: Model | None) -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` of their text."""
    schema = T.StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double")
    if model is None:
        return rows.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = model.predict(text_array(batch.column("text")))
        return pa.record_batch(
            [*batch.columns, pa.array(names, pa.string()), pa.array(scores)],
            names=[*batch.schema.names, "lang_pred", "score"],
        )

    return map_slices(rows, function, schema, limit=TEXT_BYTES)


def identify(docs: DataFrame) -> DataFrame:
    """Language of every whole text, learned from text and lang of rows that are not held out.

    ``score`` is the regression's value of the best language, cut to 0 to 1; of equal values the
    first language in code-point order counts. A missing text or
    one without letters is ``und`` with score 0, and so is all if no row teaches a language.
    A missing doc_id counts as empty text for the fold; rows without lang are only predicted;
    repeated rows are repeated; an empty table gives no rows.
    """
    rows = texts_of(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"
    )
    return apply(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """The rows whose text has a language with a score of ``least`` or more.

    If no row teaches a language, texts cannot be told apart, and all that have a letter stay.
    Missing texts and those without a letter go; missing values in other columns play no part;
    repeated rows stay or go together; an empty table gives no rows.
    """
    rows, model = wrapped(docs), fit(docs)
    if model is None:
        return unwrapped(rows.where(F.col("text").rlike(LETTER)), docs.columns)
    found = apply(rows, model)
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    return unwrapped(found.where(keep), docs.columns)

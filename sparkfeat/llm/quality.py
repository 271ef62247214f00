"""Operator 6: quality rules whose cutoffs bound the false rejections with stated confidence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.batches import (
    by_white_space,
    coded,
    map_slices,
    row_sums,
    text_array,
    unwrapped,
    wrapped,
)
from sparkfeat.sources.store import materialize

#: Words of a window, fewest words of a text, and most repeated words in a hundred.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A good document may be rejected with at most this probability, at this confidence.
FALSE_REJECTIONS, CONFIDENCE = 0.08, 0.95
#: Rejecting a good document counts as much as keeping so many bad ones.
GOOD_WEIGHT = 20
#: The measures, and their possible cutoffs from lenient to strict. A text above is rejected.
CUTOFFS = {
    "symbols": (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "same_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeats": (0.25, 0.2, 0.15, 0.1, 0.05),
}
#: Symbols, capitals, letters and white space as bytes.
SYMBOLS, CAPITALS = b"#*$%&|<>", bytes(range(65, 91))
LETTERS, BLANKS = CAPITALS + bytes(range(97, 123)), b" \t\n\v\f\r"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
    "n_letters",
)


#: 128 bits that tell equal texts.
SAME_TEXT = ("_same_text", "_same_text_too")


def byte_sums(texts: pa.Array, members: bytes) -> np.ndarray:
    """How many bytes of every text are members of a set."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    table = np.zeros(256, np.int64)
    table[list(members)] = 1
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return row_sums(table[raw], ends.astype(np.int64) - ends[0])


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of every text that lie in windows which the text holds twice or more.

    Windows with equal hashes are compared word by word, so the count is exact.
    """
    n = len(codes)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begin = np.arange(max(0, n - window + 1))
    begin = begin[row[begin] == row[begin + window - 1]]
    if not len(begin):
        return np.zeros(len(offsets) - 1, np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = row.astype(np.uint64)[begin] * np.uint64(0xBF58476D1CE4E5B9)
    for i in range(window):
        key = (key + mixed[begin + i]) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    begin = begin[order[twice]]
    if not len(begin):
        return np.zeros(len(offsets) - 1, np.int64)
    whole = np.column_stack([row[begin], *(codes[begin + i] for i in range(window))])
    _, group, size = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
    begin = begin[size[group.ravel()] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + window, -1)
    return row_sums(np.cumsum(cover)[:n] > 0, offsets)


def same_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the text, and all lines with a word."""
    offsets, codes, lines = coded(pc.split_pattern(texts, "\n"))
    worded = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = worded[codes] if len(codes) else np.zeros(0, bool)
    row, codes = row[keep], codes[keep].astype(np.int64)
    total = np.bincount(row, minlength=len(texts))
    first = np.unique(row * max(1, len(lines)) + codes) // max(1, len(lines))
    return total - np.bincount(first, minlength=len(texts)), total


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """The counts named in COUNTS for every text."""
    if len(texts) == 0:
        return [np.zeros(0, np.int64)] * len(COUNTS)
    offsets, codes, _ = by_white_space(texts)
    doubled, lines = same_lines(texts)
    chars = pc.utf8_length(texts).to_numpy().astype(np.int64)
    return [
        np.diff(offsets), chars - byte_sums(texts, BLANKS), byte_sums(texts, SYMBOLS), doubled,
        repeated_words(codes, offsets), lines, byte_sums(texts, CAPITALS),
        byte_sums(texts, LETTERS),
    ]


def add_counts(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """The rows with the counts of their texts and two hashes that tell equal texts, with or
    without the texts."""
    first, second = SAME_TEXT
    rows = rows.withColumns({first: F.xxhash64("text"), second: F.xxhash64(F.lit(1), F.col("text"))})
    held = [f.name for f in rows.schema if keep_text or f.name != "text"]
    schema = rows.select(held).schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = text_counts(text_array(batch.column("text")))
        return pa.record_batch(
            [*(batch.column(n) for n in held), *(pa.array(x, pa.int64()) for x in found)],
            names=[*held, *COUNTS],
        )

    return map_slices(rows, function, schema)


def base_failed() -> Column:
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def measures() -> dict[str, Column]:
    """The measures of CUTOFFS; 0 where there is nothing to divide by."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "symbols": share("n_symbols", "n_words"), "capitals": share("n_capitals", "n_letters"),
        "same_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }


def level(measure: Column, cutoffs: tuple[float, ...]) -> Column:
    """How many of the cutoffs the measure exceeds; lenient cutoffs come first."""
    return sum((measure > c).cast("int") for c in cutoffs)


def tail(n: int, most: int, p: float) -> float:
    """Exact probability that at most ``most`` of ``n`` events of probability ``p`` happen."""
    i = np.arange(most + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in i])
    return float(np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def choose(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> int:
    """Index of the chosen cutoff, -1 for none; arrays count documents by level.

    Cutoffs are tested from lenient to strict until the first whose exact binomial bound does
    not exclude a false rejection rate above ``risk`` at ``error``: a fixed sequence needs no
    correction of its own. Among those passed, the one with most bad documents rejected against
    weighted good ones is taken, the more lenient of equals, none if that is not positive.
    """
    n, steps, best, value = int(good.sum()), len(good) - 1, -1, 0.0
    for cut in range(steps):  # it rejects what exceeds it and all stricter ones
        wrong, right = int(good[steps - cut :].sum()), int(bad[steps - cut :].sum())
        if n == 0 or wrong >= n * risk or tail(n, wrong, risk) > error:
            break
        if right - GOOD_WEIGHT * wrong > value:
            best, value = cut, right - GOOD_WEIGHT * wrong
    return best


def needed(strata: int) -> int:
    """Fewest good documents with which a cutoff can pass, if so many strata are tested."""
    error = (1 - CONFIDENCE) / (strata * len(CUTOFFS))
    return math.ceil(math.log(error) / math.log1p(-FALSE_REJECTIONS / len(CUTOFFS)))


def pooling(sizes: dict[int, int]) -> tuple[int, int]:
    """From how many good documents on a stratum stands alone, and how many strata are tested.

    ``sizes`` has the number of strata for every number of good documents. The smaller strata
    are one more together, if they are enough for a cutoff. The fewest are pooled with which
    all others can pass.
    """
    for least in sorted(sizes):
        alone = sum(n for size, n in sizes.items() if size >= least)
        rest = sum(size * n for size, n in sizes.items() if size < least)
        tested = alone + (rest >= needed(alone + 1))
        if least >= needed(tested):
            return least, tested
    return max(sizes, default=0) + 1, 1


def calibrate(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a stratum with the cutoff of every rule (infinite where none is safe).

    Only labelled documents that pass the base rules count, and equal texts of a stratum are one
    trial, as repeats say nothing new of the texts to come; a text that has labels of both kinds
    is a good one, so that doubt never loosens a bound. Strata with too few good ones for
    any cutoff are pooled; their cutoffs and the bound are those of the pool as a whole. The
    pool follows from the numbers of good documents alone, so it does not weaken the bound. The
    allowed error is divided by the number of strata and rules, the allowed rate of false
    rejections by the number of rules.
    """
    told = labels.select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_good")
    ).where("_id IS NOT NULL AND _good IS NOT NULL")
    levels = [level(m, CUTOFFS[rule]).alias(rule) for rule, m in measures().items()]
    held = (
        counted.where(~base_failed())
        .join(told.distinct(), F.col("_doc") == F.col("_id"))
        .select("_stratum", "_good", *SAME_TEXT, *levels)
    )
    trials = held.groupBy("_stratum", *CUTOFFS, *SAME_TEXT).agg(F.max((F.col("_good") == 1).cast("int")).alias("_good"))
    long = trials.groupBy("_stratum", "_good", *CUTOFFS).count()
    stacked = ", ".join(f"'{rule}', {rule}" for rule in CUTOFFS)
    table = materialize(
        long.selectExpr(
            "_stratum", "_good", "count", f"stack({len(CUTOFFS)}, {stacked}) AS (rule, level)"
        )
        .groupBy("_stratum", "_good", "rule", "level")
        .agg(F.sum("count").alias("n")),
        "quality-levels",
    )
    good = (
        table.where((F.col("rule") == next(iter(CUTOFFS))) & (F.col("_good") == 1))
        .groupBy("_stratum")
        .agg(F.sum("n").alias("size"))
    )
    # distinct sizes: no more than the root of twice the number of labels
    least, strata = pooling({r["size"]: r["count"] for r in good.groupBy("size").count().collect()})
    error, risk = (1 - CONFIDENCE) / (strata * len(CUTOFFS)), FALSE_REJECTIONS / len(CUTOFFS)

    def cutoffs(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"_stratum": rows["_stratum"].unique()}
        for rule, steps in CUTOFFS.items():
            mine = rows[rows["rule"] == rule]
            by = [np.zeros(len(steps) + 1, np.int64) for _ in range(2)]
            for value, lvl, n in zip(mine["_good"], mine["level"], mine["n"]):
                by[int(value == 1)][lvl] += n
            chosen = choose(by[1], by[0], risk, error)
            out[f"_{rule}"] = steps[chosen] if chosen >= 0 else math.inf
        return pd.DataFrame(out)

    schema = "_stratum string, " + ", ".join(f"_{rule} double" for rule in CUTOFFS)
    alone = F.when(F.col("size") >= least, F.col("_stratum")).alias("alone")
    groups = table.join(good.select("_stratum", alone), "_stratum").groupBy("alone")
    return materialize(groups.applyInPandas(cutoffs, schema), "quality-cutoffs")


def stratum_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("_stratum")


def kept() -> Column:
    """No base rule failed and no measure above its cutoff."""
    above = F.lit(False)
    for rule, measure in measures().items():
        above = above | F.coalesce(measure > F.col(f"_{rule}"), F.lit(False))
    return ~base_failed() & ~above


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row, by base rules and calibrated cutoffs.

    Strata are the values of ``stratum``, missing ones a stratum of their own. Strata without
    enough good labelled documents share the cutoffs of their pool. If that has too few as well,
    or a stratum has none at all, nothing is rejected there beyond the base rules. A
    missing or empty text has no words and fails; missing labels or doc_ids tell nothing, equal
    label rows count once; repeated documents are repeated; empty tables give no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"),
        stratum_of(stratum),
    )
    counted = materialize(add_counts(rows), "quality-counts")
    return (
        counted.join(calibrate(counted, labels), "_stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", kept())
        .select(F.col("_doc").alias("doc_id"), *COUNTS[:5], "base_failed", "kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows that :func:`judge` keeps, with their own columns and repeats.

    The rows are stored once with their counts; calibration reads the counts alone, and the
    filter joins the few cutoffs, so that no text is shuffled.
    """
    rows = wrapped(docs, F.col("doc_id").cast("long").alias("_doc"), stratum_of(stratum))
    counted = materialize(add_counts(rows, keep_text=True), "quality-rows")
    cutoffs = calibrate(counted, labels)
    return unwrapped(counted.join(cutoffs, "_stratum", "left").where(kept()), docs.columns)

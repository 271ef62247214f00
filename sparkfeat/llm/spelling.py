"""Spelling variants: words of the corpus that are one edit apart, grouped under frequent forms.

The vocabulary is composed with a one-edit transducer and with itself. Every word stands in two
classes: that of its own length, where it meets words as long and words longer by one, and that
of the length below, as the longer one. Inside a class of size L a pair first differs at some
position; that position lies in one of the windows that the class is cut into. Both words then
share all before the window and all after it, which together name the initial state of a
partition. In it the parts inside the window form two minimised acceptors, of the L-long words
and of the longer ones; their composition with the transducer is walked from the initial state,
and every accepted pair comes out once, as the transducer edits only at the first difference.

A partition with more than ``CROWD`` words is not enumerated: its window is halved, so what its
words share outside grows, until partitions are small or the window has one position, where there are
at most 90 + 90 * 90 words of these letters. No word or pair is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.batches import one_thread, text_array
from sparkfeat.sources.store import materialize

#: Words that a partition may hold; more than a window of one position can hold.
CROWD = 9216
#: Characters of a text that are cut into runs at once.
STEP = 1 << 20
#: Distinct words and their characters that a task counts before it hands them on.
HELD_WORDS, HELD_CHARACTERS = 1 << 18, 1 << 24
#: States of a task's acceptors before they are built anew, and results before they go on.
STATES, RESULTS = 1 << 17, 1 << 15

LETTERS = "a-zÀ-ÿ"
KEY = ["size", "low", "high", "prefix", "suffix"]


# --- words ----------------------------------------------------------------------------------


def _runs(text: str, letters: re.Pattern, wanted: re.Pattern) -> Counter:
    """Long runs of letters with their number, of a text of any length in bounded steps."""
    found, start = Counter(), 0
    while start < len(text):
        end = min(start + STEP, len(text))
        if rest := letters.match(text, end):
            end = rest.end()
        found.update(wanted.findall(text, start, end))
        start = end
    return found


def count_words(docs: DataFrame, shortest: int = 7, every: int = 31) -> DataFrame:
    """Words (``word``) of at least ``shortest`` code points with their occurrences (``n``).

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case. Where ``every``
    divides the CRC-32 h of ``<doc_id>:<run>``, the run loses its code point h % length. A missing
    ``doc_id`` reads as the empty string; a missing or empty text has no words; repeated rows
    count again; an empty table gives no words; other columns play no part. Equal runs of a text
    are counted before they are hashed, and equal words of a task before the shuffle.
    """
    letters, wanted = f"[{LETTERS}]+", f"[{LETTERS}]{{{shortest},}}"

    def count(batches):
        one_thread()
        patterns = re.compile(letters), re.compile(wanted)
        words, characters = {}, 0
        for part in batches:
            for doc, text in zip(part.column("id"), text_array(part.column("text"))):
                seed = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                lowered = text.as_py().encode().lower().decode()
                for word, n in _runs(lowered, *patterns).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    if word in words:
                        words[word] += n
                    else:
                        words[word] = n
                        characters += len(word)
                if len(words) > HELD_WORDS or characters > HELD_CHARACTERS:
                    yield from _word_batches(words)
                    words, characters = {}, 0
        yield from _word_batches(words)

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _word_batches(words: dict[str, int]) -> Iterator[pa.RecordBatch]:
    columns = [pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["word", "n"])


# --- acceptors and their composition --------------------------------------------------------


class Acceptor:
    """Minimised acceptors of word lists, one initial state each.

    States with the same right language are one state, across all lists: a state is looked up by
    whether it accepts and by its arcs, whose targets are such states already.
    """

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        self._known: dict[tuple, int] = {}

    def _state(self, accepts: bool, arcs: dict[str, int]) -> int:
        key = (accepts, *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.accepts.append(accepts)
        return self._known[key]

    def add(self, words: list[str]) -> int:
        """The initial state of sorted distinct words. What follows a common part is final as
        soon as the next word leaves it, so states are shared while the list is read."""
        path = [[False, {}]]
        before = ""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                accepts, arcs = path.pop()
                path[-1][1][before[len(path) - 1]] = self._state(accepts, arcs)

        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            settle(shared)
            path.extend([False, {}] for _ in range(len(word) - shared))
            path[-1][0] = True
            before = word
        settle(0)
        return self._state(*path[0])

    def _both(self, p: int, q: int, unlike: str | None, end: bool) -> Iterator[str]:
        """What both states accept; ``unlike`` may not be the first character, and nothing at
        all counts only with ``end``."""
        if end and self.accepts[p] and self.accepts[q]:
            yield ""
        stack = [
            (self.arcs[p][c], self.arcs[q][c], (None, c))
            for c in self.arcs[p]
            if c != unlike and c in self.arcs[q]
        ]
        while stack:
            p, q, path = stack.pop()
            if self.accepts[p] and self.accepts[q]:
                yield _spelled(path)
            others = self.arcs[q]
            stack.extend((t, others[c], (path, c)) for c, t in self.arcs[p].items() if c in others)

    def near(self, short: int, long: int | None, open_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs of words that the composition accepts from a pair of initial states.

        Both words of a replacement come from ``short``, the longer one of an insertion from
        ``long``. The edit comes at the first difference: an inserted character differs from the
        one that the shorter word goes on with. ``open_end`` lets the shorter word end there.
        """
        stack = [(short, long, None)]
        while stack:
            p, q, path = stack.pop()
            here = list(self.arcs[p].items())
            for i, (a, first) in enumerate(here):
                for b, second in here[i + 1 :]:
                    for rest in self._both(first, second, None, True):
                        start = _spelled(path)
                        yield start + a + rest, start + b + rest
            if q is not None:
                for c, target in self.arcs[q].items():
                    for rest in self._both(p, target, c, open_end):
                        start = _spelled(path)
                        yield start + rest, start + c + rest
            others = self.arcs[q] if q is not None else {}
            stack.extend((t, others.get(c), (path, c)) for c, t in here)


def _spelled(path) -> str:
    """The characters of a path, kept as (what came before, character) so that a step is cheap."""
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


# --- partitions -----------------------------------------------------------------------------


def _windowed(rows: DataFrame, windows) -> DataFrame:
    """Rows with ``word``, ``n`` and ``size`` in each of the windows (structs of low and high)."""
    kept = F.greatest(F.lit(0), F.col("size") - F.col("high"))
    return (
        rows.withColumn("window", F.explode(windows))
        .select("word", "n", "size", "window.low", "window.high")
        .withColumn("prefix", F.expr("left(word, low)"))
        .withColumn("suffix", F.right("word", kept))
        .withColumn("middle", F.expr("substring(word, low + 1, length(word) - length(suffix) - low)"))
    )


def _window(low, high):
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def _halves(low, high):
    middle = F.floor((low + high) / 2)
    return F.array(_window(low, middle), _window(middle, high))


def _walk(batches):
    """Partition by partition of rows sorted by key and middle: what every word has near it."""
    one_thread()
    machine, found = Acceptor(), {}
    key, short, long = None, [], []

    def meet(word, n, other, m):
        count, best, form = found.get(word, (0, 0, ""))
        if m > best or (m == best and other < form):
            best, form = m, other
        found[word] = (count + 1, best, form)

    def close():
        nonlocal machine
        if len(short) + len(long) < 2 or not short:
            return
        if len(machine.arcs) > STATES:
            machine = Acceptor()
        numbers = dict(short) | dict(long)
        first = machine.add([w for w, _ in short])
        second = machine.add([w for w, _ in long]) if long else None
        size, _, high, prefix, suffix = key
        for one, two in machine.near(first, second, high > size):
            a, b = prefix + one + suffix, prefix + two + suffix
            meet(a, numbers[one], b, numbers[two])
            meet(b, numbers[two], a, numbers[one])

    def results():
        rows = [(word, *values) for word, values in found.items()]
        found.clear()
        columns = list(zip(*rows)) or [[]] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "near_n", "near"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in [*KEY, "middle", "n", "longer"]]
        for *now, middle, n, longer in zip(*columns):
            if now != key:
                close()
                key, short, long = now, [], []
                if len(found) > RESULTS:
                    yield results()
            (long if longer else short).append((middle, n))
    close()
    yield results()


def near_words(words: DataFrame) -> DataFrame:
    """What every word has near it, of a table of distinct words (``word``, ``n``).

    Returns ``word``, ``n_near``, ``near`` and ``near_n`` for words that have another at exactly
    one inserted, deleted or replaced code point; ``near`` is the one with the largest ``n``, the
    smallest in code-point order among equal ones. Missing and empty words are near to none.
    """
    length = F.length("word")
    classes = F.when(length > 1, F.array(length, length - 1)).otherwise(F.array(length))
    rows = words.where(length > 0).select("word", "n", F.explode(classes).alias("size"))
    rows = _windowed(rows, _halves(F.lit(0), F.col("size") + 1))
    found = None
    while True:
        rows = materialize(rows, "windows")
        can_split = F.col("high") - F.col("low") > 1
        counts = rows.where(can_split).groupBy(*KEY).count()
        crowded = materialize(counts.where(F.col("count") > CROWD), "crowded")
        last = crowded.isEmpty()
        ready = rows if last else rows.join(crowded, KEY, "left_anti")
        sorted_rows = (
            ready.select(*KEY, "middle", "n", (F.length("word") > F.col("size")).alias("longer"))
            .repartition(*KEY)
            .sortWithinPartitions(*KEY, "longer", "middle")
        )
        part = sorted_rows.mapInArrow(_walk, "word string, n_near long, near_n long, near string")
        found = part if found is None else found.unionByName(part)
        if last:
            break
        split = rows.join(crowded, KEY, "left_semi").select("word", "n", "size", "low", "high")
        rows = _windowed(split, _halves(F.col("low"), F.col("high")))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n")
    )


# --- groups ---------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """The last form of every word that has one: ``word``, ``root``.

    Every round doubles how far a word looks ahead. Numbers grow along the forms, so chains end.
    """
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(roots.join(further, "root", "left"), "roots")
        moved = joined.where(F.col("next").isNotNull())
        if moved.isEmpty():
            return roots
        roots = joined.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(
    docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, every: int = 31
) -> DataFrame:
    """Words of the texts with their forms: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are those of :func:`count_words` with at least ``least`` occurrences. A word's form is
    the near word with the largest ``n`` (among equal ones the smallest), if that is ``ratio`` or
    more times the word's; ``root`` is the last of the forms of forms, or the word itself.
    ``ratio`` above 1 keeps chains from running in circles. Texts without words, and tables
    without texts, give no rows; rules for missing values are those of ``count_words``.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = materialize(count_words(docs, shortest, every).where(F.col("n") >= least), "words")
    near = near_words(words)
    rows = words.join(near, "word", "left")
    has_form = F.col("near_n") >= ratio * F.col("n")
    rows = materialize(
        rows.select(
            "word",
            F.when(has_form, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(rows.where(F.col("form").isNotNull()))
    joined = rows.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

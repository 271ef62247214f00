"""Repair of damaged conversations by aligning their turns to the alternating grammar.

The initials of a sound conversation's roles are ``(s?(ua)+)?``. The turns are aligned to every
target string of that grammar that can be reached at the cost of a repair already known: rows of
the edit-distance table run over the turns, columns over the letters that remain of a target, so
one table serves all lengths, and a row holds only the band of columns whose cost, with the least
that the turns before must cost, stays within that incumbent. Among the cheapest lengths the
backtraced audits are compared.

A conversation goes to one task, as the checksum of its repaired text follows its order, but its
texts are not gathered: the task first reads short rows on all turns, aligns them, and then
streams the texts in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.batches import one_thread

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
#: Characters of a text that decide its place among equal turns and roles; then its checksum does.
SHOWN = 64
#: Conversations, or characters of repaired text, that leave a task at once.
ROWS, CHARACTERS = 4096, 4 << 20
_FAR = np.int64(1 << 40)


# --- damage ---------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with known faults: ``conv_id``, ``turn``, ``role``, ``text``, ``copies``.

    The CRC-32 of ``conv_id:turn`` modulo 20 drops a row (0; it stays with no copies, so that the
    conversation is known), empties its text (1), removes ``[.!?]`` from it (2), repeats it (3) or
    makes its role user (4). Missing values read as one space, but a missing turn stays missing.
    """
    space = F.lit(" ")
    name = F.concat_ws(
        ":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    )
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


# --- alignment ------------------------------------------------------------------------------


def _incumbent(initials: list[str], must_go: list[bool], truncated: list[bool]) -> int:
    """The cost of a repair that is easy to find: misplaced turns all go, or all change roles."""
    best = None
    for change in (DELETE, REROLE):
        cost, kept = 0, 0
        for initial, gone, cut in zip(initials, must_go, truncated):
            if gone or cut:
                cost += DELETE
            else:
                wrong = initial != "ua"[kept % 2]
                cost += change * wrong
                kept += not wrong or change == REROLE
        cost += INSERT * (kept % 2)
        best = cost if best is None else min(best, cost)
    return best


class _Table:
    """Costs of aligning the turns from the i-th on to the last r letters of ``...uaua``.

    A row is kept as its first column and the costs from there on, as far as the band reaches.
    """

    def __init__(self, initials: list[str], must_go: list[bool], truncated: list[bool]):
        self.initials, self.must_go, self.truncated = initials, must_go, truncated
        n = len(initials)
        self.most = _incumbent(initials, must_go, truncated)
        least = DELETE * np.cumsum([0, *(g or t for g, t in zip(must_go, truncated))])
        self.rows: list = [None] * (n + 1)
        self.rows[n] = (0, INSERT * np.arange((self.most - int(least[n])) // INSERT + 1))
        for i in range(n - 1, -1, -1):
            self.rows[i] = self._row(i, self.most - int(least[i]))

    def _row(self, i: int, limit: int) -> tuple[int, np.ndarray]:
        low, below = self.rows[i + 1]
        if not len(below):
            return low, below
        room = max(0, (limit - int(below.min())) // INSERT)
        cost = np.full(len(below) + 1 + room, _FAR)
        cost[: len(below)] = below + DELETE
        if not self.must_go[i]:
            columns = np.arange(low + 1, low + 1 + len(below))
            match = np.where(columns % 2, self.initials[i] == "a", self.initials[i] == "u")
            step = np.where(match, 0, REROLE) + TRUNCATED * self.truncated[i]
            cost[1 : len(below) + 1] = np.minimum(cost[1 : len(below) + 1], below + step)
        slope = INSERT * np.arange(len(cost))
        cost = np.minimum.accumulate(cost - slope) + slope
        inside = np.flatnonzero(cost <= limit)
        if not len(inside):
            return low, cost[:0]
        return low + int(inside[0]), cost[inside[0] : inside[-1] + 1]

    def cost(self, i: int, r: int) -> int:
        low, row = self.rows[i]
        return int(row[r - low]) if low <= r < low + len(row) else int(_FAR)

    def starts(self) -> Iterator[tuple[int, str, int, int]]:
        """(cost, letters so far, turn, remaining letters) of every way into the table: all
        lengths without a system turn, and all with one that is kept after the rest went."""
        n = len(self.initials)
        heads = [(0, "", 0, 0)]
        for k in range(n):
            if self.initials[k] == "s" and not self.must_go[k]:
                heads.append((DELETE * k + TRUNCATED * self.truncated[k], "D" * k + "K", k + 1, 2))
        for before, letters, i, fewest in heads:
            low, row = self.rows[i]
            for r in range(max(fewest, low + low % 2), low + len(row), 2):
                yield before + int(row[r - low]), letters, i, r

    def audit(self, i: int, r: int) -> str:
        """The least of the cheapest edits from a cell: D, I, K and R lead to different cells."""
        letters, n = [], len(self.initials)
        while i < n or r:
            now = self.cost(i, r)
            if i < n and self.cost(i + 1, r) + DELETE == now:
                letters.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == now:
                letters.append("I")
                r -= 1
            else:
                letters.append("K" if self.initials[i] == "ua"[r % 2] else "R")
                i, r = i + 1, r - 1
        return "".join(letters)


def align(initials: list[str], must_go: list[bool], truncated: list[bool]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; of equal ones the audit least in ASCII.

    K keeps a turn, R gives it the other role, D deletes it, I inserts one before the next turn.
    """
    table = _Table(initials, must_go, truncated)
    starts = list(table.starts())
    cost = min(s[0] for s in starts)
    return cost, min(letters + table.audit(i, r) for c, letters, i, r in starts if c == cost)


# --- streams of conversations ---------------------------------------------------------------


class _Conversation:
    """One conversation while its rows pass: first those on all turns, then the texts."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns, self.initials, self.faults = [], [], []
        self.seen: set = set()
        self.audit = None

    def note(self, turn, role, digest, copies, blank, truncated) -> None:
        for _ in range(copies):
            again = (role, digest) in self.seen
            self.seen.add((role, digest))
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else ""
            self.turns.append(turn)
            self.initials.append(role[:1])
            self.faults.append(fault)

    def close_notes(self) -> None:
        """Align; from now on texts may come."""
        self.seen = set()
        must_go = [f in ("blank", "duplicate") for f in self.faults]
        truncated = [f == "truncated" for f in self.faults]
        self.cost, self.audit = align(self.initials, must_go, truncated)
        kept = sum(c != "D" for c in self.audit)
        self.letters, self.roles = iter(self.audit), iter("s" * (kept % 2) + "ua" * (kept // 2))
        self.hash, self.empty = hashlib.sha256(), True

    def _said(self, edit: str, role: str | None, text: str) -> tuple[str, str, str]:
        wanted = next(self.roles)
        role = role if edit == "K" else {"u": "user", "a": "assistant"}[wanted]
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(role.encode() + b":" + text.encode())
        return edit, role, text

    def say(self, role, text) -> Iterator[tuple[str, str, str]]:
        """The repaired turns up to and with the next turn of the damaged conversation."""
        for edit in self.letters:
            if edit == "I":
                yield self._said(edit, None, "")
                continue
            if edit != "D":
                yield self._said(edit, role, text)
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for edit in self.letters:
            yield self._said(edit, None, "")

    def summary(self) -> tuple:
        known = [t for t in self.turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        counts = [self.faults.count(f) for f in ("blank", "duplicate", "truncated")]
        pairs = zip(self.initials, self.initials[1:])
        illegal = sum(a + b not in LEGAL for a, b in pairs)
        return (self.conv_id, gaps, *counts, illegal, self.cost, self.audit, self.hash.hexdigest())


SUMMARY = {
    "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long",
    "cost": "long", "audit": "string", "repaired_sha256": "string",
}
TURNS = {"place": "long", "edit": "string", "role": "string", "text": "string"}


def _events(batches) -> Iterator[tuple]:
    """(conversation, its next row or None at its end) for rows sorted by conversation."""
    now = None
    names = ["conv_id", "turn", "role", "digest", "copies", "blank", "truncated", "is_text", "text"]
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if now is None or now.conv_id != row[0]:
                if now is not None:
                    yield now, None
                now = _Conversation(row[0])
            yield now, row
    if now is not None:
        yield now, None


def _passing(batches) -> Iterator[tuple]:
    """(conversation, repaired turn or None at its end)."""
    for now, row in _events(batches):
        if row is not None and not row[7]:
            now.note(*row[1:7])
            continue
        if now.audit is None:
            now.close_notes()
        if row is None:
            yield from ((now, said) for said in now.rest())
            yield now, None
        else:
            for _ in range(row[4]):
                yield from ((now, said) for said in now.say(row[2], row[8]))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        columns = list(zip(*held)) or [[]] * len(schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= ROWS or size >= CHARACTERS:
            yield batch()
            held, size = [], 0
    yield batch()


def _sorted(rows: DataFrame) -> DataFrame:
    """Every row twice, first as a note without its text; conversations together and in order."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    ending = F.rtrim(F.col("text"), F.lit(WHITE))
    order = ["turn", "role", "shown", "digest"]
    return (
        rows.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
            text.alias("text"),
            copies.cast("int").alias("copies"),
            F.explode(F.array(F.lit(False), F.lit(True))).alias("is_text"),
        )
        .withColumns(
            {
                "shown": F.left("text", F.lit(SHOWN)),
                "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)),
                "blank": ending == "",
                "truncated": ~F.right(ending, F.lit(1)).isin(*ENDS),
            }
        )
        .withColumn("text", F.when(F.col("is_text"), F.col("text")))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "is_text", *(F.col(c).asc_nulls_first() for c in order))
    )


def _mapped(rows: DataFrame, columns: dict[str, str], wanted) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = ", ".join(f"{n} {t}" for n, t in {"conv_id": kind, **columns}.items())
    arrow = {"long": pa.int64(), "string": pa.string()}

    def run(batches):
        one_thread()
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        key = pa.field("conv_id", first.schema.field("conv_id").type)
        fields = [key, *(pa.field(n, arrow[t]) for n, t in columns.items())]

        def every():
            yield first
            yield from batches

        yield from _batches(wanted(_passing(every())), pa.schema(fields))

    return _sorted(rows).mapInArrow(run, schema)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, gaps, the cheapest repair and a checksum of its text.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and may have ``copies``, the number of
    times that a row stands there: a conversation all of whose rows have 0 is empty. Turns go by
    number, missing ones first, then by role and text (its first 64 characters, then its SHA-256).
    The first of a row's faults counts: blank, duplicate (role and text came before), truncated
    (ends in none of ``.!?``). A missing role or text reads as one space, rows without ``conv_id``
    are one conversation, a role of no characters fits no letter of the grammar; repeated rows
    are duplicates; other columns play no part; an empty table gives no rows.
    """
    return _mapped(
        rows, SUMMARY, lambda passing: (c.summary() for c, said in passing if said is None)
    )


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id``, ``place``, ``edit``, ``role``, ``text``.

    ``place`` counts from 0; ``edit`` is K, R or I. The rules are those of :func:`audits`.
    """

    def turns(passing):
        place = 0
        for conversation, said in passing:
            if said is None:
                place = 0
            else:
                yield (conversation.conv_id, place, *said)
                place += 1

    return _mapped(rows, TURNS, turns)

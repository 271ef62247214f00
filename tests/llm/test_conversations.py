import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfeat.llm.conversations import align, audits, damaged, repaired
from sparkfeat.llm.queries import QUERIES

GRAMMAR = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_faults(turns):
    seen, faults = set(), []
    for role, text in turns:
        letters = re.findall("[^\x20\x09-\x0d]", text)
        if not letters:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if letters[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def cheapest(initials, faults):
    """By a machine that reads the grammar: least (cost, audit) to every state after each turn."""
    steps = {"0": {"s": "1", "u": "2"}, "1": {"u": "2"}, "2": {"a": "3"}, "3": {"u": "2"}}

    def inserted(best):
        while True:
            more = dict(best)
            for state, (cost, audit) in best.items():
                for letter, to in steps[state].items():
                    if letter != "s":
                        new = (cost + 5, audit + "I")
                        more[to] = min(more.get(to, new), new)
            if more == best:
                return best
            best = more

    best = {"0": (0, "")}
    for initial, fault in zip(initials, faults):
        after = {}
        for state, (cost, audit) in inserted(best).items():
            options = [(state, 2, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for letter, to in steps[state].items():
                    if letter == initial:
                        options.append((to, extra, "K"))
                    elif letter != "s":
                        options.append((to, 1 + extra, "R"))
            for to, more, edit in options:
                new = (cost + more, audit + edit)
                after[to] = min(after.get(to, new), new)
        best = after
    best = inserted(best)
    return min(best[s] for s in best if s in "03")


def plain_repair(turns, audit):
    out, kept = [], sum(c != "D" for c in audit)
    roles = iter(["system"] * (kept % 2) + ["user", "assistant"] * (kept // 2))
    left = iter(turns)
    for edit in audit:
        turn = next(left) if edit != "I" else None
        if edit == "D":
            continue
        role = next(roles)
        out.append(turn if edit == "K" else (role, turn[1] if turn else ""))
    return out


def plain_rows(rows, changed):
    found = []
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in changed if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [(role, text) for _, role, text in mine]
        known = [t for t, _, _ in mine if t is not None]
        faults = plain_faults(turns)
        initials = [role[:1] for role, _ in turns]
        cost, audit = cheapest(initials, faults)
        fixed = plain_repair(turns, audit)
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in fixed))
        found.append(
            (
                conv,
                max(known) - min(known) + 1 - len(set(known)) if known else 0,
                *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
                cost,
                audit,
                hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
            )
        )
    return sorted(found, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TURN = st.tuples(st.sampled_from("uuuaaast"), st.sampled_from(["", "", "", "blank", "truncated"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=12))
def test_alignment_is_the_cheapest_and_least(turns):
    initials, faults = [t[0] for t in turns], [t[1] for t in turns]
    must_go, truncated = [f == "blank" for f in faults], [f == "truncated" for f in faults]
    assert align(initials, must_go, truncated) == cheapest(initials, faults)


def test_alignment_by_every_sequence_of_edits():
    """No machine and no table: all edits of short conversations."""
    for n in range(4):
        for initials in itertools.product("uas", repeat=n):
            for cut in itertools.product((False, True), repeat=n):
                best = (10**9, "")
                spaces = [("", "I", "II")] * (n + 1)
                for inserts in itertools.product(*spaces):
                    for edits in itertools.product("DKR", repeat=n):
                        audit = inserts[0] + "".join(e + i for e, i in zip(edits, inserts[1:]))
                        kept = sum(c != "D" for c in audit)
                        target = iter("s" * (kept % 2) + "ua" * (kept // 2))
                        if kept == 1:
                            continue
                        cost, turn, ok = 0, 0, True
                        for edit in audit:
                            wanted = next(target) if edit != "D" else ""
                            if edit == "I":
                                cost, ok = cost + 5, ok and wanted != "s"
                                continue
                            here, extra = initials[turn], 5 * cut[turn]
                            if edit == "D":
                                cost += 2
                            elif edit == "K":
                                cost, ok = cost + extra, ok and here == wanted
                            else:
                                cost, ok = cost + 1 + extra, ok and wanted != "s" and here != wanted
                            turn += 1
                        if ok:
                            best = min(best, (cost, audit))
                assert align(list(initials), [False] * n, list(cut)) == best


def test_long_conversation_stays_in_its_band():
    initials = list("ua" * 3000)
    for i in range(5, 6000, 50):
        initials[i] = "u"
    truncated = [i % 37 == 0 for i in range(6000)]
    must_go = [i % 91 == 0 for i in range(6000)]
    faults = ["blank" if g else "truncated" if t else "" for g, t in zip(must_go, truncated)]
    cut = [f == "truncated" for f in faults]
    assert align(initials, must_go, cut) == cheapest(initials, faults)


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (1, 4, "user", "So"),
    (2, None, "user", "a."), (2, None, None, None), (2, 3, "assistant", " \t\n"), (2, 3, "", "x."),
    (None, 1, "system", "Be good."), (None, 2, "assistant", "Ok."), (None, None, "user", "Go! \r\n"),
    (3, 5, "tool", "é　"), (4, 0, None, None), (5, 1, "system", "S."), (5, 2, "user", "q" * 100_000 + "."),
    (5, 3, "assistant", "\x0b."), (6, 1, "assistant", "b."), (6, 1, "assistant", "a."), (6, 1, "user", "a."),
] + [(7, t, "user" if t % 3 else "assistant", f"turn {t}" + "." * (t % 4)) for t in range(60)]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_audits_of_hard_rows(talks):
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ROWS]
    assert collected(audits(talks)) == plain_rows(ROWS, whole)
    assert collected(audits(damaged(talks))) == plain_rows(ROWS, plain_damage(ROWS))


def test_extra_columns_and_empty_tables(spark, talks):
    wide = talks.selectExpr("*", "1 AS place", "'x' AS digest", "2 AS blank", "'y' AS is_text", "0 AS shown")
    assert collected(audits(wide)) == collected(audits(talks))
    empty = spark.createDataFrame([], SCHEMA)
    assert audits(damaged(empty)).collect() == []
    assert repaired(empty).collect() == []


def test_conversation_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows = damaged(spark.createDataFrame([(gone, 1, "user", "x.")], SCHEMA))
    assert collected(audits(rows)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_turns_hash_to_the_audit(talks):
    rows = damaged(talks)
    texts = {}
    for r in repaired(rows).orderBy("conv_id", "place").collect():
        texts.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    for r in audits(rows).collect():
        said = texts.get(r["conv_id"], [])
        assert [p for p, _ in said] == list(range(len(said)))
        assert len(said) == sum(c != "D" for c in r["audit"])
        whole = "\n".join(t for _, t in said)
        assert hashlib.sha256(whole.encode()).hexdigest() == r["repaired_sha256"]


def test_query_equals_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in table.collect()]
    assert collected(QUERIES["op12_turn_repair"](spark, small)) == plain_rows(rows, plain_damage(rows))

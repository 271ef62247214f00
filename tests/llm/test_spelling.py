import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfeat.llm import spelling
from sparkfeat.llm.queries import QUERIES
from sparkfeat.llm.spelling import Acceptor, count_words, near_words, spelling_variants


def plain_words(rows, shortest=7, every=31):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                words[run] += 1
    return words


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deletions(word):
    return {word[:i] + "*" + word[i + 1 :] for i in range(len(word))} | {
        word[:i] + word[i + 1 :] for i in range(len(word))
    }


def plain_near(words):
    """Pairs that meet in a word with one character left out or starred, then compared in full."""
    shared = {}
    for word in words:
        for key in deletions(word) | {word}:
            shared.setdefault(key, set()).add(word)
    near = {word: set() for word in words}
    for group in shared.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    return near


def plain_rows(rows, least=2, ratio=10, **options):
    words = {w: n for w, n in plain_words(rows, **options).items() if n >= least}
    near = plain_near(words)
    forms = {}
    for word, n in words.items():
        best = min(near[word], key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for word, n in words.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        form = forms[word]
        out.add((word, form, root, n, len(near[word]), words[form] if form else None))
    return out


def collected(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


WORDS = st.lists(st.text("abé", min_size=1, max_size=6), unique=True, max_size=25)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(1, 5))
def test_composition_accepts_the_pairs_at_one_edit_once(words, size):
    short = sorted(w for w in words if len(w) == size)
    long = sorted(w for w in words if len(w) == size + 1)
    if not short:
        return
    machine = Acceptor()
    found = list(machine.near(machine.add(short), machine.add(long) if long else None, True))
    wanted = {
        frozenset((a, b)) for a in short for b in [*short, *long] if a != b and one_edit(a, b)
    }
    assert len(found) == len(wanted)
    assert {frozenset(p) for p in found} == wanted


@given(st.lists(st.text("abc", max_size=5), unique=True, min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_acceptor_is_minimal(words):
    machine = Acceptor()
    start = machine.add(sorted(words))

    def language(state):
        own = {""} if machine.accepts[state] else set()
        return own | {c + w for c, t in machine.arcs[state].items() for w in language(t)}

    languages = [frozenset(language(s)) for s in range(len(machine.arcs))]
    assert languages[start] == set(words)
    assert len(set(languages)) == len(languages)


def near_of(spark, words):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in near_words(table).collect()}


def expected_near(words):
    out = {}
    for word, others in plain_near(words).items():
        if others:
            best = min(others, key=lambda w: (-words[w], w))
            out[word] = (len(others), best, words[best])
    return out


VARIED = {
    w: 3 + i % 5
    for i, w in enumerate(
        sorted(
            {a + b + c for a in ("", "a", "b", "ab", "ba", "aab") for b in ("xxxx", "xyxx", "xxx")
             for c in ("", "a", "b", "ab", "bb", "é")}
        )
    )
}


def test_near_words_of_all_lengths(spark):
    assert near_of(spark, VARIED) == expected_near(VARIED)


def test_crowded_partitions_are_split_until_small(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CROWD", 12)
    assert near_of(spark, VARIED) == expected_near(VARIED)


def test_very_long_words(spark):
    base = "ab" * 40_000
    words = {base: 5, base + "a": 4, "c" + base: 3, base[:500] + "c" + base[501:]: 2, base[1:]: 9}
    assert near_of(spark, words) == expected_near_long(words)


def expected_near_long(words):
    near = {w: [v for v in words if v != w and close(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    return {w: (len(near[w]), b, words[b]) for w, b in best.items()}


def close(a, b):
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return a[at + 1 :] == b[at + 1 :]
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


def test_missing_and_empty_words_are_near_to_none(spark):
    table = spark.createDataFrame([(None, 3), ("", 3), ("a", 2), ("b", 5)], "word string, n long")
    assert collected(near_words(table)) == {("a", 1, "b", 5), ("b", 1, "a", 2)}


def test_words_of_hard_rows(spark, docs, wide, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert dict(collected(count_words(docs))) == plain_words(rows)
    assert dict(collected(count_words(wide.withColumn("id", F.lit("x"))))) == plain_words(rows)
    assert collected(spelling_variants(docs)) == plain_rows(rows)
    assert collected(spelling_variants(empty)) == set()


def test_runs_across_steps_and_held_words(spark, monkeypatch):
    text = "Erste ZÄhlung " * 50 + "x" * 300 + " İstanbul ÀÉÎÕÜß " + "abcdefgh-" * 40
    rows = [(i, text) for i in range(40)] + [(None, text)]
    monkeypatch.setattr(spelling, "STEP", 13)
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(collected(count_words(table))) == plain_words(rows)


def test_forms_lead_to_roots(spark):
    """Chains of forms, ties between forms, and ratios on the edge."""
    counts = {
        "abcdefg": 2000, "abcdefh": 200, "abcdeih": 20, "abcjeih": 2,
        "zzzzzzz": 100, "zzzzzzy": 100, "zzzzzzx": 10, "zzzzzzxw": 11, "solitary": 5, "once only": 1,
    }
    rows = [(1, " ".join(" ".join([w] * n) for w, n in counts.items()))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    never = 2**32 + 1  # divides only a hash of 0
    found = {r[0]: r for r in collected(spelling_variants(table, every=never))}
    assert set(found.values()) == plain_rows(rows, every=never)
    assert found["abcjeih"][1:3] == ("abcdeih", "abcdefg")
    assert found["zzzzzzx"][1] == "zzzzzzy"
    assert found["zzzzzzxw"][1] is None
    with pytest.raises(ValueError):
        spelling_variants(table, ratio=1)


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = collected(QUERIES["op11_spelling_variants"](spark, small))
    assert found == plain_rows(rows)
    assert any(r[1] for r in found)

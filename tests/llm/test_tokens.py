"""Packing, token counts and sampled pieces against the libraries and exact round trips."""

import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkfeat.llm.bin_packing import Capacities, best_fit_decreasing, pack_token_ids
from sparkfeat.llm import piece_sampling, token_counts
from sparkfeat.llm.batches import Recent
from sparkfeat.llm.piece_sampling import Sampler, certain_cuts, decode_pieces, encode_sampled
from sparkfeat.llm.token_counts import TokenCounter, count_tokens
from sparkfeat.llm.window_packing import WINDOW_PRICE, best_cuts, pack_windows
from tests.llm.conftest import ROWS


def library_ids(vocabulary, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary[0]).encode(text or "", add_special_tokens=False).ids


def wanted(vocabulary, end):
    return Counter((d, tuple(library_ids(vocabulary, t) + [end])) for d, t, *_ in ROWS)


def test_packed_rows_hold_every_document(docs, vocabulary):
    rows = pack_token_ids(docs, *vocabulary, end_id=50256, row_length=64, block_ids=500).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    parts = []
    for r in rows:
        ids, places = np.frombuffer(r.ids, np.uint32), np.frombuffer(r.position_ids, np.uint32)
        assert len(ids) == len(places) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert r.n_segments == len(r.doc_ids) and (ids[r.n_tokens :] == 50256).all()
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            parts.append((d, s, tuple(ids[a:b].tolist())))
    want = Counter()
    for (d, ids), n in wanted(vocabulary, 50256).items():
        for s in range(0, len(ids), 64):
            want[d, s, ids[s : s + 64]] += n
    assert Counter(parts) == want


def test_best_fit_takes_the_fullest_row_that_is_enough():
    free = Capacities(10)
    for row, space in enumerate((3, 7, 5, 7)):
        free.add(space, row)
    assert free.take(4) == (5, 2) and free.take(4)[0] == 7 and free.take(8) is None
    lengths = np.random.default_rng(0).integers(1, 65, 500)
    rows, n = best_fit_decreasing(lengths, 64)
    spaces: list[int] = []
    for need in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, space in enumerate(spaces) if space >= need]
        if fits:
            spaces[min(fits, key=lambda i: spaces[i])] -= need
        else:
            spaces.append(64 - need)
    assert np.bincount(rows, lengths).max() <= 64
    assert sorted(64 - np.bincount(rows, lengths)) == sorted(spaces) and n == len(spaces)


@pytest.mark.parametrize("window,block", [(64, 500), (1000, 1 << 20), (1024, 100)])
def test_windows_hold_every_id_once(docs, vocabulary, window, block):
    rows = pack_windows(docs, *vocabulary, window=window, block_ids=block).collect()
    found, places = Counter(), defaultdict(list)
    for r in rows:
        found[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    whole = {(d, len(ids)): ids for d, ids in wanted(vocabulary, 0)}
    for (d, start, length, crc, n), _ in found.items():
        assert zlib.crc32(np.array(whole[d, n][start : start + length], "<u4").tobytes()) == crc
    tokens = sum(len(i) * k for (_, i), k in wanted(vocabulary, 0).items())
    assert sum(r.length for r in rows) == tokens


def test_cuts_cost_no_more_than_any_other_choice():
    random = np.random.default_rng(3)
    for _ in range(30):
        cuts = np.concatenate([[0], np.cumsum(random.integers(1, 9, 9))])
        price = random.integers(0, 12, len(cuts))

        def cost(path):
            total = 0
            for a, b in zip(path, path[1:]):
                size = cuts[b] - cuts[a]
                if size > 16:
                    return float("inf")
                total += (0 if size & (size - 1) == 0 else 16 - size) + WINDOW_PRICE + price[b]
            return total

        inner = range(1, len(cuts) - 1)
        every = (
            [0, *(i for i in inner if mask >> i & 1), len(cuts) - 1] for mask in range(0, 1 << len(cuts) - 1, 2)
        )
        assert cost(best_cuts(cuts, price, 16)) == min(map(cost, every))


def test_counts_equal_the_library(docs, pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    texts = [t or "" for _, t, *_ in ROWS] + [" ", "▁▁ ▁", "a\x00b", "é", "\r\n  x ", "aa" * 900]
    got = TokenCounter(pieces).counts(pa.array(texts)).tolist()
    assert got == [len(library.encode(t)) for t in texts]
    rows = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, pieces, 100).collect())
    assert rows == Counter(
        (d, len((t or "").encode()), n, n > 100) for (d, t, *_), n in zip(ROWS, got)
    )


def test_remembered_words_are_bounded_by_their_characters(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "CHARACTERS", 50_000)
    counter, fresh = TokenCounter(pieces), TokenCounter(pieces)
    for i in range(40):
        texts = pa.array([f"{chr(97 + i % 26)}{i}" * 3000 + " short words", "long " + "q" * 9000])
        assert counter.counts(texts).tolist() == fresh.counts(texts).tolist()
        held = sum(map(len, counter.cache.young)) + sum(map(len, counter.cache.old))
        assert held <= 2 * (50_000 + 20_000)
    recent = Recent(2, 100)
    assert recent.get_many(["a", "b", "a"], lambda k: [len(x) for x in k]) == [1, 1, 1]


def test_sampled_pieces_decode_to_the_text(docs, pieces):
    rows = encode_sampled(docs, pieces)
    back = decode_pieces(rows, pieces).collect()
    assert all(r.lossless for r in back)
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((d, t or "") for d, t, *_ in ROWS)
    again = Counter((r.doc_id, r.ids) for r in encode_sampled(docs.repartition(5), pieces).collect())
    assert again == Counter((r.doc_id, r.ids) for r in back)
    assert again != Counter((r.doc_id, r.ids) for r in encode_sampled(docs, pieces, seed=9).collect())


def test_texts_with_every_odd_character_come_back(spark, pieces):
    """The space's own character beside code points that no text should hold."""
    odd = "".join(map(chr, (0x10FFFF, 0x10FFFE, 0xFFFFF, 0xFFFFE, 0xEFFFF, 0xEFFFE)))
    texts = [odd + "▁", f"▁ {odd} ▁▁ a▁b  ▁", "▁", " ▁ ", "\ue000▁\ud7ff"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decode_pieces(encode_sampled(docs, pieces), pieces).collect()
    assert {r.doc_id: r.decoded for r in rows} == dict(enumerate(texts))
    assert all(r.lossless for r in rows)


def test_samples_follow_the_lattice(pieces):
    sampler, n = Sampler(pieces, 0.5), 20_000
    ids, ends = sampler.sample(pa.array(["then"] * n), np.arange(n).astype(np.uint64))
    found = Counter(tuple(ids[a:b]) for a, b in zip(ends, ends[1:]))
    number, weight = sampler.pieces.number, sampler.pieces.weight

    def every(text):
        if not text:
            yield (), 1.0
        for i in range(1, len(text) + 1):
            if text[:i] in number:
                piece = number[text[:i]]
                yield from ((((piece,) + rest), weight[piece] * w) for rest, w in every(text[i:]))

    lattice = dict(every("▁then"))
    total = sum(lattice.values())
    assert set(found) <= set(lattice)
    for path, w in lattice.items():
        assert abs(found[path] / n - w / total) < 0.02


def test_no_piece_lies_across_a_certain_cut(pieces):
    sampler = Sampler(pieces, 1.0)
    names = ["▁" + "nowhere日本語のテキストthere" * 9, "的一是不了人我在有他" * 11, "x" * 70, "é１２３" * 20]
    for name in names:
        chars = np.array([ord(c) for c in name], np.uint64)
        want = [
            not any(name[a:b] in sampler.pieces.number for a in range(max(0, i - 40), i) for b in range(i + 1, i + 40))
            for i in range(len(name))
        ]
        for step in (7, 1 << 20):
            assert certain_cuts(sampler.pieces, chars, step)[1:].tolist() == want[1:]


def test_parts_of_a_long_word_are_sampled_as_the_whole(pieces, monkeypatch):
    random = np.random.default_rng(7)
    letters = "".join(random.choice(list("etaoinshrdlu"), 3000))
    texts, seeds = pa.array([letters, letters, "a " + letters[:700]]), np.arange(3).astype(np.uint64)
    ids, ends = Sampler(pieces, 1.0).sample(texts, seeds)
    monkeypatch.setattr(piece_sampling, "CELLS", 2000)
    again, same = Sampler(pieces, 1.0).sample(texts, seeds)
    assert ends.tolist() == same.tolist() and (ids == again).mean() > 0.999
    monkeypatch.setattr(piece_sampling, "CELLS", 1_000_000)
    monkeypatch.setattr(piece_sampling, "LONG_WORD", 1 << 30)  # nothing is cut
    whole, edges = Sampler(pieces, 1.0).sample(texts, seeds)
    sampler = Sampler(pieces, 1.0)
    for a, b, text in zip(edges, edges[1:], texts.to_pylist()):
        assert sampler.decode(whole[a:b]).decode() == text


def test_texts_without_spaces(spark, pieces):
    """12 MB of ideographs in one text cost at most three times as much a byte as documents."""
    random = np.random.default_rng(8)
    ideographs = "".join(map(chr, random.integers(0x4E00, 0x9FA5, 4_000_000)))
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = " ".join(r.text for r in documents.select("text").collect())
    sampler, spent = Sampler(pieces, 1.0), {}
    texts = {"spaced": words, "ideographs": ideographs}
    for name, text in texts.items():
        begin = time.process_time()
        ids, _ = sampler.sample(pa.array([text]), np.zeros(1, np.uint64))
        spent[name] = (time.process_time() - begin) / len(text.encode())
        assert sampler.decode(ids).decode() == text
    assert spent["ideographs"] < 3 * spent["spaced"]
    docs = spark.createDataFrame([(1, "nospaces" * 30_000), (2, ideographs)], "doc_id long, text string")
    assert all(r.lossless for r in encode_sampled(docs, pieces).select("lossless").collect())


def test_empty_tables_and_other_columns(empty, wide, docs, vocabulary, pieces):
    for run in (
        lambda d: pack_token_ids(d, *vocabulary, end_id=50256),
        lambda d: pack_windows(d, *vocabulary), lambda d: count_tokens(d, pieces),
        lambda d: encode_sampled(d, pieces),
    ):
        assert run(empty).count() == 0
        assert run(wide).count() == run(docs).count()

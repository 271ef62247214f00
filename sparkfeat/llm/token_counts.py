"""Operator 3: token counts of whole texts by merging symbol pairs, without making ids."""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparkfeat.llm.batches import Recent, by_space, map_slices, row_sums, text_array, texts_of

#: Distinct words whose counts a task remembers twice over, characters that they may have in all,
#: and the tokens above which a text is too long.
REMEMBERED, CHARACTERS, LIMIT = 500_000, 1 << 24, 4096
#: The character that stands for a space in the vocabulary.
SPACE = "▁"
#: Kinds of vocabulary entries that text can become.
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
TEXT_BYTES = 8 << 20

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceRanks:
    """The order of merges of a piece vocabulary with byte fallback and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rule, spec = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if (
            rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix
            or not rule.escape_whitespaces or not spec.byte_fallback or spec.model_type != spec.BPE
            or kinds & {USER_DEFINED, UNUSED}
        ):
            raise ValueError(f"{path}: only plain pair-merging vocabularies with byte fallback")
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError(f"{path}: pieces may not reach over the end of a word")
        self.known = {p for p in self.rank if len(p) == 1}
        if any(set(p) - self.known for p in self.rank):
            raise ValueError(f"{path}: a piece has a character that is no piece")

    def count(self, word: str) -> int:
        """Initial symbols of the word minus merges.

        A symbol is a character, or one for each byte of a character outside the vocabulary.
        The heap holds adjacent pairs by rank, then place; ``size`` of a symbol links it to the
        next one and ``before`` to the one in front. A pair on the heap whose symbols have
        changed since is skipped.
        """
        rank, known = self.rank, self.known
        n = len(word)
        symbols = n
        for c in word:
            if c not in known:
                symbols += len(c.encode()) - 1
        heap = []
        for i in range(n - 1):
            r = rank.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        if not heap:
            return symbols
        heapify(heap)
        size, before = [1] * n, list(range(-1, n - 1))
        while heap:
            _, left, end = heappop(heap)
            middle = left + size[left]
            if middle == left or middle >= end or middle + size[middle] != end:
                continue
            size[left], size[middle] = end - left, 0
            symbols -= 1
            if end < n:
                before[end] = left
                r = rank.get(word[left : end + size[end]])
                if r is not None:
                    heappush(heap, (r, left, end + size[end]))
            first = before[left]
            if first >= 0:
                r = rank.get(word[first:end])
                if r is not None:
                    heappush(heap, (r, first, end))
        return symbols


class TokenCounter:
    """Counts of texts: no merge passes the end of a word, so each distinct word is counted once."""

    def __init__(self, path: str):
        self.ranks, self.cache = PieceRanks(path), Recent(REMEMBERED, CHARACTERS)

    def _make(self, words: list[str]) -> list[int]:
        return [self.ranks.count(SPACE + w) for w in words]

    def count_spaced(self, text: str) -> int:
        """A text with several spaces in a row, at an end, or with the space's own character."""
        if not text:
            return 0
        words = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
        return sum(self.cache.get_many([w[1:] for w in words], self._make))

    def counts(self, texts: pa.Array) -> np.ndarray:
        if len(texts) == 0:
            return np.zeros(0, np.int64)
        offsets, codes, words = by_space(texts)
        odd = pc.or_(pc.equal(words, ""), pc.match_substring(words, SPACE)).to_numpy(
            zero_copy_only=False
        )
        each = np.zeros(len(words), np.int64)
        each[~odd] = self.cache.get_many(words.filter(pa.array(~odd)).to_pylist(), self._make)
        out = row_sums(each[codes], offsets)
        if odd.any():
            for row in np.flatnonzero(row_sums(odd[codes], offsets)).tolist():
                out[row] = self.count_spaced(texts[row].as_py())
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens are more than ``limit``.

    The counts are those of the vocabulary's own library without begin and end tokens. A missing
    or empty text has 0 of both; a missing doc_id stays missing; repeated rows are repeated; an
    empty table gives no rows. No shuffle; a task keeps a bounded number of words in memory.
    """

    held: dict[str, TokenCounter] = {}

    def prepare():
        held["counter"] = TokenCounter(path)

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_array(batch.column("text"))
        n = held["counter"].counts(texts)
        return pa.record_batch(
            [
                batch.column("doc_id").cast(pa.int64()),
                pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_slices(texts_of(docs), function, SCHEMA, prepare=prepare, limit=TEXT_BYTES)

"""Token ids of whole texts by a byte-level vocabulary, with the work shared by equal words."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkfeat.llm.batches import by_space, expand, row_sums

#: Distinct words joined to one text for the encoder.
JOINED = 10_000
#: Empty, or white space of any kind in front.
ODD = r"^$|^[\s\v\x1c-\x1f\x{85}\p{Z}]"


class TokenIds:
    """Ids as the tokenizers library gives them for ``path`` without added special tokens.

    The vocabulary's pattern always starts a new unit at a space before a visible character, so
    what stands between such spaces is encoded on its own, every distinct word once, by the
    rank file of the same vocabulary, which is several times faster. A text with other white
    space around a space, or with a special string, is encoded as a whole from ``path``.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = [b""] * (max(self.tokenizer.get_vocab_size(), max(ranks.values()) + 1))
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.widths = np.fromiter(map(len, self.bytes_of), np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, each with a space before it, and how many each word has."""
        parts, sizes = [], []
        for i in range(0, len(words), JOINED):
            some = words.slice(i, JOINED)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")
            ids = np.array(self.fast.encode_ordinary(" " + joined[0].as_py()), np.uint32)
            ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + 1)
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            parts.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        none = np.zeros(0, np.int64)
        return np.concatenate([none.astype(np.uint32), *parts]), np.concatenate([none, *sizes])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the offsets of the texts among them."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        offsets, codes, words = by_space(texts)
        strange = pc.match_substring_regex(words, ODD)
        for special in self.special:
            strange = pc.or_(strange, pc.match_substring(words, special))
        odd = strange.to_numpy(zero_copy_only=False)
        # The first word of a text has no space before it; its ids come after those of the rest.
        leading, where = np.unique(codes[offsets[:-1]], return_inverse=True)
        firsts = [self.whole("" if odd[i] else words[i].as_py()) for i in leading.tolist()]
        ids, found = self._words(words.filter(pa.array(~odd)))
        sizes = np.zeros(len(words) + len(leading), np.int64)
        sizes[: len(words)][~odd] = found
        sizes[len(words) :] = list(map(len, firsts))
        parts, base = [ids, *firsts], int(sizes.sum())
        codes = codes.copy()
        codes[offsets[:-1]] = len(words) + where
        starts, lengths = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        if odd.any():
            strange_word = np.concatenate([odd, odd[leading]])[codes]
            for row in np.flatnonzero(row_sums(strange_word, offsets)).tolist():
                part = self.whole(texts[row].as_py())
                a, b = offsets[row], offsets[row + 1]
                lengths[a:b] = 0
                starts[a], lengths[a] = base, len(part)
                parts.append(part)
                base += len(part)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return np.concatenate(parts)[expand(starts, lengths)], ends[offsets]

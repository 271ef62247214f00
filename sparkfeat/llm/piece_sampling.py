"""Operator 8: sampled piece segmentations by forward filtering and backward sampling."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.llm.batches import coded, expand, map_slices, row_sums, text_array

SPACE, NORMAL, BYTE = "▁", 1, 6
#: Bytes of text of one step, cells of one lattice, and bits of the table of pieces.
TEXT_BYTES, CELLS, SLOT_BITS = 8 << 20, 1_000_000, 20
#: Longer words are cut where no piece can lie across; what is still longer shares a lattice with
#: others that are at most this much longer.
LONG_WORD, PADDING = 48, 1.15
#: Stands between and behind words of one array; no text and no piece holds it.
NO_CHARACTER = 0x110000
#: Odd factors of the hash of characters.
FACTOR, SCATTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Stands for the space's own character where a text holds it. No text holds this code point: it
#: is half of a surrogate pair, which UTF-8 cannot say.
OWN = "\ud800"

SCHEMA = "n_tokens long, ids binary, ids_crc32 long, decoded_crc32 long, lossless boolean"


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finalizer: whole numbers to evenly spread ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of a vocabulary with byte fallback, and weights for a segmentation lattice.

    The file orders its pieces by the rank of their merge; a piece of rank r has the weight
    r ** -alpha, as in Zipf's law, and a byte or unknown character the weight of the last rank.
    """

    def __init__(self, path: str, alpha: float):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.text = [p.piece for p in model.pieces]
        self.first_byte = next(i for i, p in enumerate(model.pieces) if p.type == BYTE)
        last = len(self.text)
        self.number, self.weight = {}, np.zeros(last, np.float32)
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self.number[p.piece] = i
                self.weight[i] = (1 + min(-p.score, last)) ** -alpha
        self.unknown = float(last) ** -alpha
        self.longest = max(map(len, self.number))
        self.joins = np.zeros(NO_CHARACTER + 1, bool)
        self.joins[[ord(c) for p in self.number if len(p) > 1 for c in p]] = True
        if any(SPACE in p.lstrip(SPACE) for p in self.number):
            raise ValueError(f"{path}: pieces may not reach over the end of a word")
        keys = np.array([self.hash_of(p) for p in self.number], np.uint64)
        numbers = np.array(list(self.number.values()))
        slots, first = np.unique(self._slot(keys), return_index=True)
        # a table of one piece for each slot, and the few pieces whose slot another one has
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slot[slots] = first
        self.keys, self.ids = keys, numbers
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        if len(np.unique(keys)) < len(keys):
            raise ValueError(f"{path}: two pieces share a hash")
        self.rest = rest if len(rest) else np.zeros(1, np.int64)
        self.bytes_of = [self._bytes(i) for i in range(last)]
        sizes = np.fromiter(map(len, self.bytes_of), np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def hash_of(self, piece: str) -> int:
        return int((prefix_hashes(np.array([[ord(c) for c in piece]], np.uint64)) * SCATTER)[0, -1])

    def _bytes(self, i: int) -> bytes:
        if self.first_byte <= i < self.first_byte + 256:
            return bytes([i - self.first_byte])
        return self.text[i].replace(SPACE, " ").encode() if self.text[i] in self.number else b""

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashed strings are pieces, and their numbers."""
        keys = hashes.ravel() * SCATTER
        piece = self.slot[self._slot(keys)]
        maybe = np.flatnonzero(piece >= 0)
        keys, piece = keys[maybe], piece[maybe]
        wrong = np.flatnonzero(self.keys[piece] != keys)
        at = np.minimum(np.searchsorted(self.keys[self.rest], keys[wrong]), len(self.rest) - 1)
        piece[wrong] = self.rest[at]
        right = np.ones(len(maybe), bool)
        right[wrong] = self.keys[piece[wrong]] == keys[wrong]
        return maybe[right], self.ids[piece[right]]


def prefix_hashes(chars: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2 ** 64, of all prefixes of every row, the empty one first."""
    out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
    for i in range(chars.shape[1]):
        out[:, i + 1] = out[:, i] * FACTOR + (chars[:, i] + np.uint64(1))
    return out


def lattice(
    pieces: Pieces, chars: np.ndarray, carry: np.ndarray | None = None, context: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward filtering of words of one length, all at once; ``chars`` is words x length.

    For every word and end position: the cumulative probabilities of the lengths 1, 2, ... of the
    piece that ends there, and the pieces (-1 for a character outside the vocabulary). The sums
    over segmentations are kept relative to the latest ones, so that long words do not vanish.

    A part of a longer word begins with ``context`` characters of the part before, and with the
    sums that the part before ends with, which come as the third result.
    """
    words, n = chars.shape
    reach = pieces.longest if carry is not None else min(n, pieces.longest)
    hashes = prefix_hashes(chars)
    ids = np.full((words, n, reach), -1, np.int32)
    weight = np.zeros((words, n, reach), np.float32)
    weight[:, :, 0] = pieces.unknown
    power = np.ones(1, np.uint64)
    for size in range(1, min(n, reach) + 1):
        power = power * FACTOR
        at, found = pieces.find(hashes[:, size:] - hashes[:, :-size] * power)
        word, end = np.divmod(at, n - size + 1)
        ids[word, end + size - 1, size - 1] = found
        weight[word, end + size - 1, size - 1] = pieces.weight[found]
    sums = np.zeros((words, n + reach))  # reach - 1 zeros in front
    if carry is None:
        sums[:, reach - 1] = 1
    else:
        sums[:, context : context + reach] = carry
    for end in range(context, n):
        # the sums before a piece of length 1, 2, ... that ends here
        share = np.cumsum(sums[:, end : end + reach][:, ::-1] * weight[:, end], axis=1)
        total = share[:, -1:].copy()
        share /= total
        weight[:, end] = share
        sums[:, end + reach] = total[:, 0]
        sums[:, end + 1 : end + reach + 1] /= total
    return weight, ids, sums[:, n : n + reach].copy()


def certain_cuts(pieces: Pieces, chars: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether no piece lies across the place before each character: there every segmentation
    has a cut, so the parts on both sides can be sampled one without the other."""
    out = np.ones(len(chars), bool)
    for begin in range(0, len(chars), step):
        low, end = max(0, begin - pieces.longest), begin + step
        some = chars[low : end + pieces.longest]
        across = np.zeros(len(some) + 1, np.int32)
        # how far from every character on all are ones that pieces of several characters hold
        breaks = np.append(np.flatnonzero(~pieces.joins[some]), len(some))
        room = np.repeat(breaks, np.diff(np.concatenate([[-1], breaks])))[: len(some)] - np.arange(len(some))
        start = np.flatnonzero(room > 1)
        window = some[start] + np.uint64(1)
        for size in range(2, pieces.longest + 1):
            inside = room[start] >= size
            start = start[inside]
            if not len(start):
                break
            window = window[inside] * FACTOR + (some[start + size - 1] + np.uint64(1))
            at, _ = pieces.find(window)
            across += np.bincount(start[at] + 1, minlength=len(across)).astype(np.int32)
            across -= np.bincount(start[at] + size, minlength=len(across)).astype(np.int32)
        out[begin:end] = np.cumsum(across)[begin - low : end - low][: len(out) - begin] == 0
    return out


def points(names: list[str]) -> np.ndarray:
    """The code points of some words, one after the other."""
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Sampler:
    def __init__(self, path: str, alpha: float):
        self.pieces = Pieces(path, alpha)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Offsets, codes and the distinct words, each with the space characters before it.

        The character of a space that stands in a text itself becomes a code point that no text
        can hold, and is spelled as its own bytes later.
        """
        offsets, codes, distinct = coded(pc.split_pattern(texts, " "))
        names = [w.replace(SPACE, OWN) for w in distinct.to_pylist()]
        empty = pc.index(distinct, "").as_py()
        gone = codes == empty
        out = [SPACE + w for w in names]
        if not gone.any():
            return offsets, codes, out
        wider: dict[str, int] = {}
        # runs of spaces belong to the word after them, or to the end of the text
        codes, drop = codes.astype(np.int64), np.zeros(len(codes), bool)
        for row in np.flatnonzero(row_sums(gone, offsets)).tolist():
            a, b = offsets[row], offsets[row + 1]
            new, spaces = [], 0
            for c in codes[a:b].tolist():
                spaces += 1
                if c != empty:
                    word = SPACE * spaces + names[c]
                    new.append(c if spaces == 1 else wider.setdefault(word, len(out) + len(wider)))
                    spaces = 0
            if spaces and b - a > 1:  # an empty text has no word
                new.append(wider.setdefault(SPACE * spaces, len(out) + len(wider)))
            codes[a : a + len(new)] = new
            drop[a + len(new) : b] = True
        sizes = np.diff(offsets) - row_sums(drop, offsets)
        return np.concatenate([[0], np.cumsum(sizes)]), codes[~drop], out + list(wider)

    def cut_words(self, offsets, codes, names):
        """The same with long words cut where no piece can lie across."""
        long = [i for i, w in enumerate(names) if len(w) > LONG_WORD]
        if not long:
            return offsets, codes, names
        size = np.array([len(names[i]) for i in long])
        begin = np.cumsum(size + 1) - size - 1
        chars = np.full(int(begin[-1] + size[-1] + 1), NO_CHARACTER, np.uint64)
        chars[expand(begin, size)] = points([names[i] for i in long])
        starts_part = certain_cuts(self.pieces, chars)
        starts_part[begin] = starts_part[begin + size] = True
        start = np.flatnonzero(starts_part)
        length = np.diff(start, append=len(chars))
        start, length = start[chars[start] != NO_CHARACTER], length[chars[start] != NO_CHARACTER]
        number = np.empty(len(start), np.int64)
        single = length == 1
        letters, which = np.unique(chars[start[single]], return_inverse=True)
        number[single] = len(names) + which
        more = names + [chr(c) for c in letters.tolist()]
        text, known = " ".join(names[i] for i in long), {}
        several = np.flatnonzero(~single)
        for i, a, n in zip(several.tolist(), start[several].tolist(), length[several].tolist()):
            number[i] = known.setdefault(text[a : a + n], len(more) + len(known))
        counts = np.ones(len(names), np.int64)
        counts[long] = np.diff(np.searchsorted(start, np.append(begin, len(chars))))
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        flat[starts] = np.arange(len(names))
        flat[expand(starts[long], counts[long])] = number
        wide = counts[codes]
        edges = np.concatenate([[0], np.cumsum(wide)])[offsets]
        return edges, flat[expand(starts[codes], wide)], more + list(known)

    def sample(self, texts: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All piece ids of the texts in order, and the offsets of the texts among them."""
        offsets, codes, names = self.cut_words(*self.words(texts))
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        place = np.arange(n, dtype=np.int64) - offsets[row]
        seed = mix(seeds[row] ^ mix(place.astype(np.uint64) * FACTOR))
        length = np.fromiter(map(len, names), np.int64)
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
        found: list[np.ndarray] = []  # occurrence, steps before, piece or character
        seen = bounds[1:] > bounds[:-1]
        for mine in self._alike(length, seen):
            some = [names[w] for w in mine]
            if len(some) == 1 and len(some[0]) * self.pieces.longest > CELLS:
                found.append(self._sample_part_by_part(some[0], mine, order, bounds, seed))
            else:
                found.append(self._sample_words(some, mine, order, bounds, seed))
        who, step, drawn = np.concatenate(found, axis=1)
        counts = np.bincount(who, minlength=n)
        ids = np.empty(len(who), np.int64)
        ids[np.cumsum(counts)[who] - 1 - step] = drawn  # drawn from the end on
        if (ids < 0).any():
            ids, counts = self._spell(ids, np.repeat(np.arange(n), counts), n)
        ends = np.concatenate([[0], np.cumsum(row_sums(counts, offsets))])
        return ids, ends

    def _alike(self, length: np.ndarray, seen: np.ndarray):
        """Words that share a lattice: of one length, or long ones of about one length."""
        order = np.argsort(length, kind="stable")
        order = order[seen[order]]
        sizes = length[order]
        start = 0
        while start < len(order):
            least = int(sizes[start])
            most = least if least <= LONG_WORD else int(least * PADDING)
            stop = int(np.searchsorted(sizes, most, side="right"))
            limit = max(1, CELLS // (most * min(most, self.pieces.longest)))
            stop = min(stop, start + limit)
            yield order[start:stop]
            start = stop

    def _sample_words(self, names, numbers, order, bounds, seed):
        length = np.fromiter(map(len, names), np.int64)
        chars = np.full((len(names), int(length.max())), NO_CHARACTER, np.uint64)
        chars[np.arange(chars.shape[1]) < length[:, None]] = points(names)
        cumulative, ids, _ = lattice(self.pieces, chars)
        size = bounds[numbers + 1] - bounds[numbers]
        who = order[expand(bounds[numbers], size)]
        word = np.repeat(np.arange(len(names)), size)
        out, step = [np.zeros((3, 0), np.int64)], np.zeros(len(who), np.int64)
        self._draw(cumulative, ids, chars, who, word, length[word], 0, seed, step, out)
        return np.concatenate(out, axis=1)

    def _sample_part_by_part(self, name, numbers, order, bounds, seed):
        """One very long word: the sums at the start of every part are kept from a first pass,
        the parts are filtered again from the last on, and sampled in turn."""
        longest = self.pieces.longest
        chars, width = points([name])[None, :], max(1, CELLS // longest)
        begins = list(range(0, len(name), width))
        carry = np.zeros((1, longest))
        carry[0, -1] = 1
        kept = []
        for begin in begins:
            kept.append(carry)
            context = min(begin, longest)
            *_, carry = lattice(self.pieces, chars[:, begin - context : begin + width], carry, context)
        who = order[bounds[numbers[0]] : bounds[numbers[0] + 1]]
        at, step = np.full(len(who), len(name)), np.zeros(len(who), np.int64)
        out = [np.zeros((3, 0), np.int64)]
        for begin, carry in zip(reversed(begins), reversed(kept)):
            context = min(begin, longest)
            part = chars[:, begin - context : begin + width]
            cumulative, ids, _ = lattice(self.pieces, part, carry, context)
            inside = at - begin + context
            at = self._draw(cumulative, ids, part, who, np.zeros(len(who), np.int64), inside, context, seed, step, out)
            at = at + begin - context
        return np.concatenate(out, axis=1)

    def _draw(self, cumulative, ids, chars, who, word, at, low, seed, step, out) -> np.ndarray:
        """Pieces of all occurrences from their ends (``at``) down to ``low``; where they stop.

        ``step`` counts the pieces of every occurrence; ``out`` gets occurrence, step, and piece or
        character.
        """
        at = at.copy()
        left = np.flatnonzero(at > low)
        while len(left):
            # 24 bits, so that the float stays below 1
            draw = mix(seed[who[left]] + step[left].astype(np.uint64) * FACTOR) >> np.uint64(40)
            draw = (draw / (1 << 24)).astype(np.float32)
            here, of = at[left] - 1, word[left]
            took = (cumulative[of, here, :-1] <= draw[:, None]).sum(axis=1)
            piece = ids[of, here, took].astype(np.int64)
            outside = piece < 0
            piece[outside] = -1 - chars[of[outside], here[outside]].astype(np.int64)
            out.append(np.array([who[left], step[left], piece]))
            at[left] = here - took
            step[left] += 1
            left = left[at[left] > low]
        return at

    def _spell(self, ids: np.ndarray, occurrence: np.ndarray, n: int):
        """Characters outside the vocabulary (negative) as the pieces of their bytes."""
        outside = np.flatnonzero(ids < 0)
        chars, which = np.unique(-1 - ids[outside], return_inverse=True)
        spelled = [(SPACE if chr(c) == OWN else chr(c)).encode() for c in chars.tolist()]
        width = np.ones(len(ids), np.int64)
        width[outside] = np.array([len(s) for s in spelled])[which]
        out = np.repeat(ids, width)
        starts = np.cumsum(width) - width
        letters = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64) + self.pieces.first_byte
        sizes = np.array([len(s) for s in spelled])
        begin = np.cumsum(sizes) - sizes
        out[expand(starts[outside], width[outside])] = letters[expand(begin[which], sizes[which])]
        return out, np.bincount(np.repeat(occurrence, width), minlength=n)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, without the space that is put before every text."""
        sizes = self.pieces.sizes[ids]
        return self.pieces.raw[expand(self.pieces.starts[ids], sizes)].tobytes()[1:]


def seed_of(key, seed: int) -> int:
    """A row's seed: its key as text, or a text of its own where it is missing."""
    return xxhash.xxh3_64_intdigest("\0" if key is None else str(key), seed & (2**64 - 1))


def encode_sampled(
    docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 8, key: str = "doc_id"
) -> DataFrame:
    """A sampled segmentation of every whole text, and proof that it decodes to the text.

    A text's words with the spaces before them are the spans of the piece lattice, as no piece
    passes the end of a word; words of more than 48 characters, such as texts without spaces, are
    cut further where no piece lies across, and what cannot be cut is filtered in parts of bounded
    size. Forward filtering sums the weights of all segmentations up to each
    character, once for each distinct word of a step; backward sampling then draws every
    occurrence from its end on. The numbers drawn depend on the row's key, the word's place and
    ``seed`` alone, so a repeated run and a repeated row give the same pieces.

    ``ids`` are little-endian unsigned 16-bit, or 32-bit for larger vocabularies. A character
    outside the vocabulary is spelled by byte pieces, and so is the vocabulary's own character
    for a space, so every text comes back. A missing or empty text has no pieces; missing keys
    share one seed; an empty table gives no rows.
    """
    held: dict[str, Sampler] = {}

    def prepare():
        held["sampler"] = Sampler(path, alpha)

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        sampler, texts = held["sampler"], text_array(batch.column("text"))
        keys = batch.column(key)
        seeds = np.array([seed_of(k, seed) for k in keys.to_pylist()], np.uint64)
        ids, ends = sampler.sample(texts, seeds)
        kind = "<u2" if len(sampler.pieces.text) <= 1 << 16 else "<u4"
        cuts = ends.tolist()
        raw = [ids[a:b].astype(kind).tobytes() for a, b in zip(cuts, cuts[1:])]
        back = [zlib.crc32(sampler.decode(ids[a:b])) for a, b in zip(cuts, cuts[1:])]
        want = [zlib.crc32(t.as_buffer() or b"") for t in texts]
        return pa.record_batch(
            [
                keys, pa.array(np.diff(ends), pa.int64()), pa.array(raw, pa.binary()),
                pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(back, pa.int64()),
                pa.array([a == b for a, b in zip(back, want)], pa.bool_()),
            ],
            names=[key, *(f.split()[0] for f in SCHEMA.split(", "))],
        )

    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return map_slices(rows, function, f"{key} {kind}, {SCHEMA}", prepare=prepare, limit=TEXT_BYTES)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows of :func:`encode_sampled` with the text of their ids as ``decoded``."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = Sampler(path, 1.0)
        kind = "<u2" if len(pieces.pieces.text) <= 1 << 16 else "<u4"
        texts = [
            None if raw is None else pieces.decode(np.frombuffer(raw, kind).astype(np.int64)).decode()
            for raw in batch.column(ids).to_pylist()
        ]
        return pa.record_batch(
            [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
        )

    schema = T.StructType(list(encoded.schema.fields)).add("decoded", "string")
    return map_slices(encoded, function, schema, column=ids)

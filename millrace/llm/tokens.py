"""Token ids of a public word-level tokenizer, a batch of texts at a time, inside tasks.

The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its chunks
between ASCII white space, one after the other. A chunk of Latin letters, ASCII marks and digits is cut further, as the
tokenizer does it: into runs of letters in lower case, runs of marks, and single digits. Each of these is one word of
the tokenizer's model. All other chunks (with an apostrophe, a "<", or any other character) go through the tokenizer whole.

Pieces recur: each is encoded once per worker, kept under a 64-bit hash, and the ids of a whole batch are gathered by
array indexing. The bytes of each piece are compared with those that the ids were made from: a text with a piece whose
hash belongs to another one is encoded by itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from millrace.llm.wordbytes import other_bytes, steps, text_bytes, word_hashes, words

DEFAULT = "word_bpe_49k.json"
#: Pieces kept at most, most of them runs of letters; a full store is emptied, which costs time and never changes a result.
LETTERS = 3 << 18
_open: dict[tuple[str, bool], "ChunkTokenizer"] = {}

#: Kinds of bytes. Bytes above 127 are letters only as pairs, which `pieces` looks for.
_LETTER, _MARK, _DIGIT, _OTHER, _SPACE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[*b"'<"]] = _OTHER
_KIND[[*range(9, 14), 32]] = _SPACE
#: Bytes that stand for no visible character have another one in the model's words.
_HIDDEN = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def pieces(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with Latin letters in lower case, the starts and ends of all pieces of the chunks, and which chunks are left whole."""
    kind = _KIND[part]
    second = part[1:]
    pair = (part[:-1] == 0xC3) & ((second & 0xC0) == 0x80) & ((second & 0xDF) != 0x97)  # not the signs of multiplication and division
    alone = part >= 128
    alone[:-1] &= ~pair
    alone[1:] &= ~pair
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, np.flatnonzero(alone | (kind == _OTHER)), "right") - 1] = True
    low = part + (((part - np.uint8(65)) < 26).view(np.uint8) << 5)
    low[1:] += (pair & (second < 0x9F)).view(np.uint8) << 5
    kept = _ranges(starts[whole], (ends - starts)[whole])
    low[kept] = part[kept]
    left, right = kind[:-1], kind[1:]
    cuts = np.flatnonzero(((left != right) | (right == _DIGIT)) & (left < _OTHER) & (right < _OTHER)) + 1
    chunk = np.searchsorted(starts, cuts, "right") - 1
    cuts = cuts[~whole[chunk] & (starts[chunk] != cuts)]
    is_start, is_end = np.zeros(len(part), bool), np.zeros(len(part) + 1, bool)
    is_start[starts] = is_start[cuts] = True
    is_end[ends] = is_end[cuts] = True
    return low, np.flatnonzero(is_start), np.flatnonzero(is_end), whole


class _Store:
    """Pieces in the order of their hashes, with the bytes and ids of each."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.uint8)
        self.at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.hashes, hashes)
        known = place < len(self)
        known[known] = self.hashes[place[known]] == hashes[known]
        return np.flatnonzero(~known)

    def add(self, hashes: np.ndarray, texts: list[bytes], ids: list[list[int]]) -> None:
        counts, sizes = np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(map(len, texts), np.int64, len(texts))
        starts, at = len(self.flat) + np.cumsum(counts) - counts, len(self.bytes) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(texts), np.uint8)])
        place = np.searchsorted(self.hashes, hashes)  # hashes are sorted, so the store stays sorted
        for name, new in (("hashes", hashes), ("starts", starts), ("counts", counts), ("at", at), ("sizes", sizes)):  # one after the other: only one is there twice
            setattr(self, name, np.insert(getattr(self, name), place, new))


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where one of each is, and the rank of each value."""
    coded = pa.array(hashes).dictionary_encode()
    values, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    one = np.zeros(len(values), np.int64)
    one[codes] = np.arange(len(codes))
    order = np.argsort(values)
    rank = np.zeros(len(values), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], one[order], rank[codes]


class ChunkTokenizer:
    def __init__(self, path: str, plain_marks: bool = False) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain_marks
        self._model = self._tokenizer.model
        self._letters = _Store()
        probe = ["éxample", ",", "straße", "--", "7", "7", "x"]  # a tokenizer that cuts in another way gets all chunks whole
        self._cuts = self._plain(["Éxample,STRAßE--77x"])[0] == [*chain.from_iterable(self._encode([p.encode() for p in probe], [False] * len(probe)))]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[bytes], whole: list[bool]) -> list[list[int]]:
        rest = iter(self._plain([str(t, "utf-8") for t, w in zip(texts, whole) if w]))
        word = self._model.tokenize
        return [next(rest) if w else [x.id for x in word(str(t, "ascii") if t.isascii() else str(t, "latin-1").translate(_HIDDEN))] for t, w in zip(texts, whole)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        raw, offsets = text_bytes(column)
        for a, b in steps(offsets):
            cut = offsets[a : b + 1] - offsets[a]
            part = raw[int(offsets[a]) : int(offsets[b])]
            chunks, chunk_ends, _ = words(part, cut)
            if not len(chunks):
                yield from (np.zeros(0, np.uint32) for _ in range(b - a))
                continue
            low, starts, ends, whole = pieces(part, chunks, chunk_ends) if self._cuts else (part, chunks, chunk_ends, np.ones(len(chunks), bool))
            hashes, one, inverse = _distinct(word_hashes(low, cut, starts, ends))
            if len(self._letters) > LETTERS:
                self._letters = _Store()
            store = self._letters
            fresh = store.unknown(hashes)
            if len(fresh):
                at = one[fresh]
                texts = [low[s:e].tobytes() for s, e in zip(starts[at].tolist(), ends[at].tolist())]
                store.add(hashes[fresh], texts, self._encode(texts, whole[np.searchsorted(chunks, starts[at], "right") - 1].tolist()))
            place = np.searchsorted(store.hashes, hashes)[inverse]
            counts = store.counts[place].astype(np.int64)
            flat = store.flat[_ranges(store.starts[place], counts)]
            sizes = ends - starts
            differs = sizes != store.sizes[place]
            same = np.flatnonzero(~differs)
            differs[same] = other_bytes(low, starts[same], sizes[same], store.bytes, store.at[place[same]])
            until = np.searchsorted(starts, cut)  # pieces before each text
            odd = set((np.searchsorted(until, np.flatnonzero(differs), "right") - 1).tolist())
            limits = np.concatenate([[0], np.cumsum(counts)])[until]
            for k, (s, e) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist())):
                if k in odd:
                    yield np.array(self._plain([str(part[int(cut[k]) : int(cut[k + 1])].tobytes(), "utf-8")])[0], np.uint32)
                else:
                    yield flat[s:e]


def tokenizer(name_or_path: str, plain_marks: bool = False) -> ChunkTokenizer:
    """One per Python worker. A bare name is looked up among the installed public tokenizers, on the executor itself.

    plain_marks: the strings of special tokens in a text are ordinary text; without it they get the special ids, as the library does.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (name_or_path, plain_marks)
    if key not in _open:
        path = name_or_path
        if os.sep not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        _open[key] = ChunkTokenizer(path, plain_marks)
    return _open[key]

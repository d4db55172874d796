"""Ids of texts put together from the remembered ids of their parts, for tokenizers that drop white space and never join letters to marks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from framewright.llm.text import LOWER, Words, split_words

#: Parts, and their bytes, that a Python worker remembers the ids of; then it starts over.
CACHE_WORDS, CACHE_BYTES = 700_000, 32 << 20
#: Text bytes whose parts are looked up at once.
STEP_BYTES = 1 << 21
#: ASCII letters (1) and ASCII marks without the apostrophe (2): where one meets the other, the tokenizer splits too.
_SIDE = np.zeros(256, np.uint8)
_SIDE[97:123] = 1
_SIDE[[b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27]] = 2


class PartEncoder:
    """Ids of a text as the ids of its parts one after another.

    Parts are words, cut where an ASCII letter meets an ASCII mark; their ASCII
    letters are lower-cased, as the tokenizer does after composing characters
    (so a letter before a byte beyond ASCII, which might compose with it, is left
    to the tokenizer).  Each distinct part is encoded once and remembered.
    Subclasses say how parts, and texts with reserved strings, are encoded.
    """

    #: Strings that are ids of their own wherever a text contains them.
    reserved: list[str]

    def encode_parts(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all parts one after another, and how many each has."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        """Ids of a text that contains a reserved string."""
        raise NotImplementedError

    def clear(self) -> None:
        self.known, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n, self.bytes = 0, 0
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used, self.begin = 0, np.zeros(CACHE_WORDS + 1, np.int64)

    def learn(self, parts: list[bytes]) -> None:
        ids, sizes = self.encode_parts([p.decode() for p in parts])
        while self.n + len(parts) + 1 > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[self.n + 1 : self.n + 1 + len(parts)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.bytes += sum(map(len, parts))
        self.n += len(parts)

    @staticmethod
    def parts(texts: list[str]) -> Words:
        raw = [t.encode() for t in texts]
        whole = np.frombuffer(b"\n".join(raw), np.uint8)
        lower = LOWER[whole]
        lower[:-1] = np.where(whole[1:] < 0x80, lower[:-1], whole[:-1])
        side = _SIDE[lower]
        cut = np.flatnonzero((side[1:] + side[:-1] == 3) & (side[1:] > 0) & (side[:-1] > 0)) + 1
        at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        spaced = pa.array([np.insert(lower, cut, 0x20).tobytes()], pa.large_binary())
        (words,) = split_words(spaced)
        words.offsets = np.searchsorted(words.starts, at + np.searchsorted(cut, at, "right"))
        return words

    def codes(self, words: Words) -> np.ndarray:
        """Numbers of parts, by 64-bit hashes; parts not met before are encoded."""
        value, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if (self.n + len(value) > CACHE_WORDS or self.bytes > CACHE_BYTES) and self.n:
            self.clear()
        at = np.searchsorted(self.known, value)
        new = np.ones(len(value), bool) if not self.n else self.known[np.minimum(at, self.n - 1)] != value
        if new.any():
            spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)
            self.code = np.insert(self.code, at[new], np.arange(self.n, self.n + new.sum()))
            self.known = np.insert(self.known, at[new], value[new])
            self.learn([words.buf[a:b].tobytes() for a, b in spans])
        return self.code[np.searchsorted(self.known, value)][of]

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end`` if given, and by text offsets into them."""
        more = int(end is not None)
        whole = {i: self.encode_whole(t) for i, t in enumerate(texts) if any(r in t for r in self.reserved)}
        words = self.parts(["" if i in whole else t for i, t in enumerate(texts)])
        code = self.codes(words)
        at, size = self.begin[code], self.begin[code + 1] - self.begin[code]
        sizes = np.bincount(words.rows_of_words(), size, len(texts)).astype(np.int64)
        for i, ids in whole.items():
            sizes[i] = len(ids)
        offsets = np.concatenate(([0], np.cumsum(sizes + more)))
        out = np.empty(offsets[-1], np.uint32)
        body = np.ones(len(out), bool)
        if more:
            out[offsets[1:] - 1] = end
            body[offsets[1:] - 1] = False
        for i, ids in whole.items():
            body[offsets[i] : offsets[i + 1]] = False
            out[offsets[i] : offsets[i + 1] - more] = ids
        out[body] = self.pool[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return out, offsets


def steps(sizes: list[int] | np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``STEP_BYTES``, of one row at least."""
    size = np.cumsum(sizes)
    row = 0
    while row < len(size):
        stop = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + STEP_BYTES, "right")))
        yield row, stop
        row = stop

"""Array kernels over whole Arrow text columns, shared by the operators of this subpackage.

Words are ``[^\\x20\\x09-\\x0D]+``.  A column is read as one byte buffer plus
offsets, cut into slices of bounded size (never inside a word), and hashed with
numpy: no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Spaces and everything else in ASCII that is no letter or digit.
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
#: ASCII letters and the byte that leads U+00C0 to U+00FF.
LETTERS = np.zeros(256, bool)
LETTERS[[b for b in range(128) if chr(b).isalpha()] + [0xC3]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text that one numpy step works on; its temporaries are about 30 times as large.
SLICE_BYTES = 1 << 21

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The usual 64-bit finaliser (xor-shift, multiply), on a copy."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_GRAM, _SIZE, _SEED = U(0xD1342543DE82EF95), U(0x2545F4914F6CDD1D), U(0x9E3779B97F4A7C15)
#: Bytes of a word that numpy hashes, eight at a time; longer words are hashed one by one.
LONG_WORD = 64
#: Words that one numpy step hashes.
STEP_WORDS = 1 << 18
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass
class Words:
    """Words of a slice of rows: byte spans into ``buf`` and, by row, offsets into the words."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    first_row: int

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: every eight of them are mixed into the hash of those before."""
        buf = np.concatenate((LOWER[self.buf] if lower else self.buf, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
        size = self.ends - self.starts
        out = mix64(size.astype(np.uint64) * _SIZE + U(seed) * _SEED)
        for a in range(0, len(out), STEP_WORDS):
            part = slice(a, a + STEP_WORDS)
            out[part] = mix64(out[part] * _GRAM ^ (eight[self.starts[part]] & _KEEP[np.minimum(size[part], 8)]))
            done = 8
            live = np.flatnonzero((size[part] > done) & (size[part] <= LONG_WORD)) + a
            while len(live):
                out[live] = mix64(out[live] * _GRAM ^ (eight[self.starts[live] + done] & _KEEP[np.minimum(size[live] - done, 8)]))
                done += 8
                live = live[size[live] > done]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(buf[self.starts[i] : self.ends[i]].data, seed)
        return out

    def rows_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.counts())


def raw_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def latin_letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to ASCII letters or to U+00C0 to U+00FF (C3 and the byte after it, in UTF-8)."""
    inside = LETTERS[buf]
    inside[1:] |= buf[:-1] == 0xC3
    return inside


def split_words(column: pa.Array | pa.ChunkedArray, between: np.ndarray = SPACE, slice_bytes: int = SLICE_BYTES, inside_of: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[Words]:
    """Words of the rows, in slices of whole rows of about ``slice_bytes`` (one row may be longer).

    ``between`` tells by byte what separates words; ``inside_of``, if given, tells
    instead which bytes of a slice are inside words.
    """
    buf, offsets = raw_text(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        end = min(end, n)
        a, b = int(offsets[row]), int(offsets[end])
        part = buf[a:b]
        inside = ~between[part] if inside_of is None else inside_of(part)
        edge = np.zeros(len(part) + 1, bool)  # a row begins here
        edge[offsets[row:end] - a] = True
        before = np.concatenate(([False], inside[:-1])) if len(part) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(part) else inside
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        yield Words(part, starts, ends, np.searchsorted(starts, offsets[row : end + 1] - a, "left"), row)
        row = end


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words, and whether it lies within one row (else its hash means nothing).

    Runs are put together from two halves and, where ``n`` asks for it, one word
    more; every step mixes, so that no arrangement of words cancels out.
    """
    total = len(hashes)
    out = np.zeros(total, np.uint64)
    if total >= n:
        run, width = hashes, 1
        for bit in bin(n)[3:]:
            run, width = mix64(run[: total - 2 * width + 1] * _GRAM + run[width:]), 2 * width
            if bit == "1":
                run, width = mix64(run[: total - width] * _GRAM + hashes[width:]), width + 1
        out[: total - n + 1] = run
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)
    return out, left >= n

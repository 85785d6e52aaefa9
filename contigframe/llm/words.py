"""Words of a batch of texts as numpy arrays: borders, hashes, and hashes of word windows.

Texts are taken as UTF-8 bytes straight from an Arrow column, so a batch costs a fixed number of
array operations whatever the number of its texts or words. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text handled at once, so that the arrays of a task stay small.
SLICE_BYTES = 2 << 20
#: Longer words are hashed one by one: the loop over 8-byte pieces is for ordinary words.
LONG_WORD = 256

_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


def _folding(separators: bytes, lower: bool) -> np.ndarray:
    """A byte for every byte: 0 for separators, the lower-cased byte otherwise."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Words between white space as they stand, the same in lower case, and letters and digits only.
PLAIN = _folding(SPACES, lower=False)
PLAIN_LOWER = _folding(SPACES, lower=True)
ALNUM_LOWER = _folding(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


@dataclass
class Words:
    """``data`` holds the folded bytes; word i is ``data[start[i]:end[i]]``; the words of text t
    are ``first[t]`` to ``first[t + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    offsets = text_buffers(texts)[1]
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of a string column; nulls are empty."""
    texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.Array, folding: np.ndarray) -> Words:
    """All words of a string column. ``folding`` maps the zero byte to zero or keeps it a letter."""
    raw, offsets = text_buffers(texts)
    data = folding[raw]
    # In PLAIN the zero byte is a letter like any other, yet folds to zero.
    letter = data != 0
    if folding[1] != 0:
        letter |= raw == 0
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(raw))])
    before = np.zeros(len(raw), bool)
    before[1:] = letter[:-1]
    before[inner] = False
    start = np.flatnonzero(letter & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = letter[1:]
    after[inner - 1] = False
    end = np.flatnonzero(letter & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(32))) * _C2
    h = (h ^ (h >> U64(29))) * _C3
    return h ^ (h >> U64(32))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; words of up to eight bytes of one length never collide."""
    length = words.end - words.start
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    pieces = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = (length.astype(np.uint64) + U64(seed)) * _C1
    rows = np.flatnonzero(length <= LONG_WORD)
    left, at = length[rows], words.start[rows]
    while len(rows):
        h[rows] = mixed(h[rows] * _C1 ^ (pieces[at] & keep[np.minimum(left, 8)]))
        go = np.flatnonzero(left > 8)
        rows, left, at = rows[go], left[go] - 8, at[go] + 8
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(words.data[words.start[i] : words.end[i]].tobytes(), seed)
    return h


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, U64(base))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of each ``size`` consecutive words: a polynomial modulo 2**64, scrambled.

    The sum of every prefix is taken once; a window is the difference of two of them times the
    inverse power of its start. Windows across text borders are the caller's to leave out.
    """
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def window_starts(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words at which a whole window of their text starts, and their texts."""
    n = np.maximum(words.counts() - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(len(text)) - first[text] + words.first[text], text

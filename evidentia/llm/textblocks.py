"""Vectorised word kernel shared by the corpus operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 those
bytes never occur inside a longer character, so bytes and characters agree.
Texts arrive as Arrow string arrays and are worked on in slices of whole
documents, so that temporary memory follows the slice and not the batch.  All
hashes are 64 bits and depend on nothing but the words (fixed seed), so every
executor, retry and run computes the same values.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow_powers(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, np.uint64(_MULT))
            down = np.full(size, np.uint64(pow(_MULT, -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class WordSlice:
    """Words of consecutive documents ``first .. first + n_docs`` of a batch."""

    first: int
    n_docs: int
    counts: np.ndarray  # words of each document
    doc: np.ndarray  # int32: document of each word, from 0 within the slice
    hashes: np.ndarray  # uint64 of each word
    starts: np.ndarray  # byte offsets of each word into ``data``
    ends: np.ndarray
    data: np.ndarray  # the slice's bytes, as hashed

    def word_starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of ``k`` words within one document."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, window_hash(self.hashes, at, k)


def window_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    total = np.full(len(at), k, np.uint64)
    for j in range(k):
        total += hashes[at + j] * _POSITION[j % 64]
    return mix(total)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:  # what lies under a null is not defined
        pieces = [data[a:b] if ok else data[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_numpy(zero_copy_only=False), strict=True)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])
    return data, offsets


def doc_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of ``data``."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    _grow_powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * _inverse[starts]
    return starts, ends, mix(value + (ends - starts).astype(np.uint64))


def word_slices(column: pa.Array, lower: bool, most: int = SLICE_BYTES) -> Iterator[WordSlice]:
    """The words of every text, slice by slice; ``lower`` folds A-Z only."""
    data, offsets = text_buffer(column)
    for i, j in doc_slices(offsets, most):
        part = data[offsets[i] : offsets[j]]
        part = _LOWER[part] if lower else part
        bounds = (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        # a document's end also ends a word: spaces go between documents
        if j - i > 1:
            gap = np.zeros(len(part) + j - i - 1, np.uint8)
            where = np.arange(len(part)) + np.repeat(np.arange(j - i), np.diff(bounds))
            gap[:] = 32
            gap[where] = part
            part, bounds = gap, bounds + np.concatenate([np.arange(j - i), [j - i - 1]])
        starts, ends, hashes = hash_words(part)
        doc = (np.searchsorted(bounds[1:], starts, "right")).astype(np.int32)
        yield WordSlice(i, j - i, np.bincount(doc, minlength=j - i), doc, hashes, starts, ends, part)


def crc_mod(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo ``modulus``; a null id counts as text ``null``."""
    return np.fromiter((zlib.crc32(b"null" if v is None else b"%d" % v) % modulus for v in ids.to_pylist()), np.int64, len(ids))


WORD = re.compile(rb"[^\x20\x09-\x0D]+")

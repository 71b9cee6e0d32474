"""Vectorised work on UTF-8 bytes of many texts at once: words, word hashes and windows of words.

A word is a maximal run of bytes that a 256-entry table marks. The word classes used here hold or leave out all
bytes of 0x80 and above together, so cutting bytes and cutting characters give the same words.

Hashes have 64 bits and stand for words and word windows. A word of up to LONG bytes goes eight bytes at a time through
a bijective mixer that starts from its length; a longer one takes BLAKE2b. So words that differ in one such step only never
share a hash, and any two others do with a probability near 2**-64, whatever repeats inside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words without blanks: all bytes but space and 0x09 to 0x0D.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Words of letters and digits: ASCII letters (lower case), digits, and every byte above 0x7F.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word from which on BLAKE2b hashes it.
LONG = 256
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its rows; null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def pieces(b: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes at most; a longer text comes alone."""
    _, bounds = flat(b.column(column))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of a run of texts: data are the lowered bytes; words of text k are first[k] to first[k + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        sizes = self.ends - self.starts
        out = mixed(sizes.astype(np.uint64) * _STEP + _SEED)
        for at, lane in lanes(self.data, self.starts, np.where(sizes <= LONG, sizes, 0)):
            out[at] = mixed(out[at] ^ lane)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """Eight bytes after eight of each run of bytes as a number, zeros beyond its end: (which runs, their numbers)."""
    if not len(starts):
        return
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at: np.ndarray | slice = slice(None)
    while len(starts):
        yield at, wide[starts] & _FIRST[np.minimum(sizes, 8)]
        more = np.flatnonzero(sizes > 8)
        at = more if isinstance(at, slice) else at[more]
        starts, sizes = starts[more] + 8, sizes[more] - 8


def cut(texts: pa.Array, table: np.ndarray) -> Words:
    """Lower A-Z and cut every text into words of the bytes that table marks."""
    raw, bounds = flat(texts)
    data = LOWER[raw]
    inside = table[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(bounds), np.int64))
    heads = bounds[:-1][bounds[:-1] < n]
    tails = bounds[1:][bounds[1:] > 0]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[heads] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[tails - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def joined_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowered bytes of every text's words, each word followed by one space, and the n + 1 offsets of the texts'.

    Works on masks and counts alone, a few bytes for each byte of text, so that a very long text fits.
    """
    raw, bounds = flat(texts)
    if len(bounds) == 1:
        return np.zeros(0, np.uint8), bounds
    data = np.insert(LOWER[raw], bounds[1:], 0x20)
    inside = table[data]
    chosen = inside.copy()
    chosen[1:] |= inside[:-1]
    sizes = np.add.reduceat(chosen, bounds[:-1] + np.arange(len(bounds) - 1), dtype=np.int64)
    data[~inside] = 0x20
    return data[chosen], np.concatenate([[0], np.cumsum(sizes)])


def owners(bounds: np.ndarray, a: int, b: int) -> np.ndarray:
    """The text that each place from a to b belongs to."""
    first, last = np.searchsorted(bounds, (a, b - 1), "right") - 1
    inner = np.clip(bounds[first : last + 2], a, b)
    return np.repeat(np.arange(first, last + 1), np.diff(inner))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; windows that cross texts are the caller's to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mixed(out + np.uint64(k))


def inside_texts(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of k words, over all words of a run of texts, lie inside one text."""
    total = int(first[-1])
    n = max(0, total - k + 1)
    ok = np.zeros(total + 1, np.int32)
    counts = np.diff(first)
    has = counts >= k
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[1:][has] - k + 1, -1)
    return np.cumsum(ok[:n]) > 0

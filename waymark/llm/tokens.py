"""Vectorised words of Arrow text columns: spans, 64-bit hashes and windows of hashes.

Words are runs of bytes outside space and \\t..\\r, which is what
`[^\\x20\\x09-\\x0D]+` finds in UTF-8 text. Null text counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text starts and ends."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # offsets of the texts in data
    start: np.ndarray  # of each word in data
    end: np.ndarray
    at: np.ndarray  # offsets of the texts in the words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end)


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = flat(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return Words(data, at, start, np.flatnonzero(last) + 1, np.searchsorted(start, at))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) * _K1)
    live = np.flatnonzero(length > 0)
    at = 0
    while len(live):
        part = eight[start[live] + at] & _MASK[np.minimum(length[live] - at, 8)]
        h[live] = mix((h[live] ^ part) * _K1)
        at += 8
        live = live[length[live] > at]
    return h


def windows(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring words, and the offsets of the texts in them; a window never crosses texts."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(out[-1]) - np.repeat(out[:-1], counts) + np.repeat(at[:-1], counts)
    w = h[first]
    for k in range(1, n):
        w = mix(w * _K1 + h[first + k])
    return w, out

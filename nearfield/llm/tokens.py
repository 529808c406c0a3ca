"""Words and their hashes, taken from whole Arrow buffers with NumPy.

A word is a run of bytes that are not ASCII white space; A-Z count as a-z.
UTF-8 keeps both rules exact at the level of bytes. A word is known by a
64-bit hash of its bytes, the same in every process.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix's end)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def spans_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, eight bytes at a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    h = lengths.astype(np.uint64) * _M1
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = lengths[live] - at
        part = eights[starts[live] + at] & _KEEP[np.minimum(left, 8)]
        x = (h[live] ^ part) * _M2
        h[live] = x ^ (x >> np.uint64(32))
        at += 8
        live = live[left > 8]
    return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and for each document the place of its
    first word (one more entry than documents)."""
    solid = ~SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = ~solid[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    last[inner - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all documents, and where each
    document's words begin."""
    starts, lengths, docs = word_spans(data, offsets)
    return spans_hash(LOWER[data], starts, lengths), docs

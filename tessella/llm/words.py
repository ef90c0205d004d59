"""Words of many texts at once: byte positions and 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Bytes that part words: space and 9 to 13. In UTF-8 these occur only as themselves.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random word for each byte, and powers of the base and of its inverse for a block of bytes.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BLOCK = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_BLOCK, dtype=np.uint64)
    out[0] = 1
    n = 1
    while n < _BLOCK:
        out[n : 2 * n] = out[:n] * np.uint64(pow(base, n, 1 << 64))
        n *= 2
    return out


_POWERS = _powers(_BASE)
_INVERSES = _powers(pow(_BASE, -1, 1 << 64))


def _power(table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """base to the power `at`, modulo 2**64, by blocks."""
    high, low = at // _BLOCK, at % _BLOCK
    step = pow(base, _BLOCK, 1 << 64)
    blocks = np.ones(int(high.max(initial=0)) + 1, dtype=np.uint64)
    for i in range(1, len(blocks)):
        blocks[i] = (int(blocks[i - 1]) * step) & _MASK
    return table[low] * blocks[high]


def word_spans(data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes. cuts: positions at which a new text begins, and so a word ends."""
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    if cuts is not None:
        own = cuts[(cuts > 0) & (cuts < len(data))]
        begins[own] |= inside[own]
        ends[own - 1] |= inside[own - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


#: Bytes whose words are hashed at once, which takes some 60 bytes of memory for each.
SEGMENT = 1 << 19


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte words, by prefix sums, then mixed with the length."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        low = starts[i]
        out[i:j] = _segment_hashes(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def _segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers = _power(_POWERS, _BASE, np.arange(len(data))) if len(data) > _BLOCK else _POWERS[: len(data)]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers, out=sums[1:])
    inverse = _power(_INVERSES, pow(_BASE, -1, 1 << 64), starts)
    return mix64((sums[ends] - sums[starts]) * inverse + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words in a shingle, and the factors of its words.
SHINGLE = 5
_FACTORS = mix64(np.arange(1, SHINGLE + 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles of five words, A-Z lower-cased.

    A text of fewer words has one shingle, all its words; a text without words none.
    """
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    edges = np.searchsorted(starts, offsets)
    n = max(0, len(words) - SHINGLE + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        runs += words[k : k + n] * _FACTORS[k]
    runs = mix64(runs)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * _FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64)
            out.append(mix64(short + _FACTORS[SHINGLE : SHINGLE + 1] * np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def text_blocks(texts: Iterable[str], size: int = 2 << 20):
    """Runs of texts of about `size` bytes together; a longer text comes alone."""
    block, held = [], 0
    for text in texts:
        if block and held + 2 * len(text) > size:
            yield block
            block, held = [], 0
        block.append(text)
        held += 2 * len(text)
    if block:
        yield block

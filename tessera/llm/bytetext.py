"""Vectorised work on the UTF-8 bytes of a whole Arrow batch of texts."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import numpy as np
import pyarrow as pa

#: Separators of words: space and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: A fixed random value for each byte, and the odd base of the rolling hash with its inverse modulo 2^64.
_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system. Spark keeps its Python workers for later tasks, and what one task has freed
    would go on counting against the executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and where each begins (and the last ends). Nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never spans two texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    start = inside[1:] & (~inside[:-1] | first)
    end = inside[:-1] & (~inside[1:] | first)
    return np.flatnonzero(start), np.flatnonzero(end)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORWARD, _BACK = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the ASCII-lower-cased bytes of each span, in time linear in the data."""
    global _FORWARD, _BACK
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) >= len(_FORWARD):
        _FORWARD, _BACK = _powers(_BASE, 2 * len(data)), _powers(_INVERSE, 2 * len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[_LOWER[data]] * _BACK[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _FORWARD[starts], 1) + (ends - starts).astype(np.uint64)


def shingle_sets(texts: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text its sorted distinct shingle hashes and its number of words.

    A shingle is n consecutive words; a text with fewer words but at least one has the whole sequence as its only one.
    """
    data, at = buffers(texts)
    starts, ends = word_spans(data, at)
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    count = np.diff(first)
    rolled = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for j in range(n):
        rolled += mix(words[j : j + len(rolled)], 10 + j)
    rolled = mix(rolled, 2)
    out = []
    for k, c in enumerate(count):
        if c >= n:
            out.append(np.unique(rolled[first[k] : first[k] + c - n + 1]))
        elif c:
            h = np.array([c], np.uint64)
            for j in range(c):
                h += mix(words[first[k] + j : first[k] + j + 1], 10 + j)
            out.append(mix(h, 3))
        else:
            out.append(np.zeros(0, np.uint64))
    return out, count

"""Hashed text features from the bytes of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import slices

TRIGRAMS = 1024
_LENGTHS = np.array([2, 5, 9, 13])  # upper ends of word-length classes
SHAPES = 2 * 3 * 4 * 2 * 5
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122) | (np.arange(256) >= 128)
_MARK = ~_LETTER & ~_SPACE & ~((np.arange(256) >= 48) & (np.arange(256) <= 57))


def parts(texts: pa.LargeStringArray, limit: int = 1 << 20):
    """(from, to) of runs of texts of about ``limit`` bytes and few rows."""
    return slices(np.maximum(pc.binary_length(texts).to_numpy(), limit >> 11), limit)


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and each text's first byte and the end."""
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    if not bounds[-1]:
        return np.zeros(0, np.uint8), bounds
    offsets = np.frombuffer(texts.buffers()[1], np.int64)
    at = int(offsets[texts.offset])
    return np.frombuffer(texts.buffers()[2], np.uint8)[at:at + int(bounds[-1])], bounds


def trigrams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, TRIGRAMS) counts of hashed byte trigrams."""
    docs = len(bounds) - 1
    if len(data) < 3:
        return np.zeros((docs, TRIGRAMS))
    wide = data.astype(np.uint32)
    key = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    key = (key * np.uint32(2654435761) >> np.uint32(22)).astype(np.int64)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    inside = doc[:-2] == doc[2:]
    return np.bincount((doc[:-2] * TRIGRAMS + key)[inside], minlength=docs * TRIGRAMS).reshape(docs, -1)


def words(data: np.ndarray, bounds: np.ndarray):
    """(first byte, end, text) of each white-space separated word."""
    docs = len(bounds) - 1
    inner = ~_SPACE[data]
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    new = inner.copy()
    new[1:] &= ~inner[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = inner.copy()
    last[:-1] &= ~inner[1:] | (doc[1:] != doc[:-1])
    return first, np.flatnonzero(last) + 1, doc[first]


def _per_word(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[end] - total[first]


def word_codes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: the sum of a mixed value per (byte, place)."""
    place = np.arange(len(data))
    place[first[0]:] -= np.repeat(first, np.diff(np.append(first, len(data))))
    return _per_word(mix(data.astype(np.uint64) | place.astype(np.uint64) << np.uint64(8)), first, end)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and shift twice)."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def shapes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, SHAPES) counts of word shapes: case, marks, letters, length,
    and whether the word repeats the one before."""
    docs = len(bounds) - 1
    first, end, doc = words(data, bounds)
    if not len(first):
        return np.zeros((docs, SHAPES))
    upper = _per_word(_UPPER[data].astype(np.int64), first, end)
    marks = _per_word(_MARK[data].astype(np.int64), first, end)
    letters = _per_word(_LETTER[data].astype(np.int64), first, end)
    size = end - first
    code = word_codes(data, first, end)
    again = np.zeros(len(first), np.int64)
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1]) & (size[1:] == size[:-1])
    case = np.where(upper == 0, 0, np.where((upper > 1) & (upper * 2 >= letters), 2, 1))
    shape = (((again * 3 + case) * 4 + np.minimum(marks, 3)) * 2 + (letters > 0)) * 5 + np.searchsorted(
        _LENGTHS, size, "right")
    return np.bincount(doc * SHAPES + shape, minlength=docs * SHAPES).reshape(docs, -1)

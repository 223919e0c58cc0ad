"""Vectorised words and word n-grams of UTF-8 texts.

Words are maximal runs of word bytes of the ASCII-lower-cased text; they are hashed to 64 bits by a polynomial over
randomly drawn byte codes, all words of a piece of a quarter megabyte in one go. Pieces are cut at documents or, inside
a longer document, between words, so that memory doesn't grow with the longest text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_MASK = (1 << 64) - 1


def steady(run):
    """The same function over batches, after which the worker gives unused memory back: workers live on from stage to stage."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CODES = _splitmix(256, 11)[_LOWER]  # upper-case ASCII letters share the codes of lower-case ones
RAW_CODES = _splitmix(256, 12)
BASE = int(_splitmix(1, 13)[0]) | 1
ORDERED = _splitmix(64, 14) | np.uint64(1)  # multipliers for the places in an n-gram
_byte = np.arange(256)
#: Word bytes: all but white space 0x09-0x0D and 0x20.
NON_SPACE = ~((_byte == 0x20) | ((_byte >= 9) & (_byte <= 13)))
#: Word bytes: ASCII digits and letters, and every byte of a non-ASCII character.
ALNUM = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | ((_byte >= 65) & (_byte <= 90)) | (_byte >= 128)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which close numbers become unlike."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without a copy; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes; a longer row is a run of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _cuts(data: np.ndarray, is_word: np.ndarray, a: int, b: int) -> list[int]:
    """Ends of stretches of data[a:b] that split no word."""
    out = []
    while b - a > 2 * PIECE:
        end, step = a + PIECE, PIECE
        while end < b and (free := np.flatnonzero(~is_word[data[end : end + 4096]])).size == 0:
            end += 4096
        end = min(b, end + (int(free[0]) if end < b else 0))
        out.append(end)
        a = end
    return [*out, b]


def _words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and by text the place of its first word, for texts that lie side by side."""
    base, end = int(offs[0]), int(offs[-1])
    d = data[base:end]
    n = len(d)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    w = is_word[d]
    edge = np.zeros(n + 1, bool)
    edge[offs - base] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w
    last[:-1] &= ~is_word[d[1:]] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    pw, inv = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(CODES[d] * pw[:n], out=total[1:])
    h = (total[e] - total[s]) * inv[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(s, offs - base)


def words(column: pa.Array, is_word: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By run of rows: first row, end row, word hashes, and where each row's words begin (with the end as last)."""
    data, offs = text_buffer(column)
    for lo, hi in pieces(offs, limit):
        if hi - lo == 1 and offs[hi] - offs[lo] > 2 * PIECE:
            a, parts = int(offs[lo]), []
            for b in _cuts(data, is_word, a, int(offs[hi])):
                parts.append(_words(data, np.array([a, b]), is_word)[0])
                a = b
            h = np.concatenate(parts)
            yield lo, hi, h, np.array([0, len(h)])
        else:
            yield lo, hi, *_words(data, offs[lo : hi + 1], is_word)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word but the last n - 1."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for j in range(n):
        out += h[j : j + k] * ORDERED[j]
    return mix(out + np.uint64(n))

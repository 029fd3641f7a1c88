"""Vectorised word hashing over Arrow string buffers, shared by the text operators.

A word's hash is a polynomial over its bytes (a random 64-bit value for each byte, powers of an odd
base), read off a running sum, so that a batch of texts is hashed in a few numpy passes and no Python
string is made. A-Z fold to a-z in the byte table. White space is \\x20 and \\x09-\\x0D; in UTF-8 these
bytes never occur inside another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text hashed at once; a longer single text is one piece.
PIECE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C17 | 3  # odd, 3 mod 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of x over all 64."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))
_TABLE[65:91] = _TABLE[97:123]
_STEPS = mix(np.arange(101, 133, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: White space and ASCII punctuation, for operators that ignore punctuation.
MARKS = SPACES.copy()
MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

_powers = np.ones(1, _U), np.ones(1, _U)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = tuple(np.concatenate((np.ones(1, _U), np.cumprod(np.full(size - 1, b, _U)))) for b in (_BASE, inverse))
    return _powers


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each text): the runs of bytes that are no separators."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    tok = ~separators[buf]
    first, last = tok.copy(), tok.copy()
    first[1:] &= ~tok[:-1]
    last[:-1] &= ~tok[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = tok[edge]
    last[edge - 1] = tok[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, word offsets of each text, starts, ends)."""
    starts, ends, woff = words(buf, off, separators)
    if not len(starts):
        return np.zeros(0, _U), woff, starts, ends
    power, inverse = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(_TABLE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U)), woff, starts, ends


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive entries; len(h) - n + 1 of them."""
    out = h[: len(h) - n + 1] * _STEPS[0]
    for k in range(1, n):
        out = out + h[k : len(h) - n + 1 + k] * _STEPS[k]
    return mix(out + _U(n))


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int = SHINGLE, separators: np.ndarray = SPACES) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text. A text of 1 to n-1 words has one shingle, the whole sequence; a text without words has none."""
    h, woff, _, _ = word_hashes(buf, off, separators)
    runs = combine(h, n) if len(h) >= n else np.zeros(0, _U)
    out = []
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(runs[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(combine(h[a:b], b - a) if b > a else np.zeros(0, _U))
    return out

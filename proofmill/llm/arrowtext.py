"""Vectorised reading of UTF-8 columns inside Spark tasks: chunks of rows, words and 64-bit word hashes.

Everything works on the bytes of an Arrow column, so no Python string is made per word.  Memory is
bounded by one Arrow batch plus a few times ``CHUNK``; a single text longer than that is read alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_UNBASE = pow(_BASE, -1, 1 << 64)


def _classes(separators) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, hashed value of the byte) for the 256 bytes; A-Z count as a-z."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    value = np.arange(1, 257, dtype=U64)
    value[65:91] = value[97:123]
    return word, value


#: Words are runs without space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = _classes([0x20, *range(0x09, 0x0E)])
#: Words are runs of a-z, A-Z, 0-9 and all bytes of non-ASCII characters.
ALNUM = _classes([b for b in range(128) if not chr(b).isalnum()])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets, is null) of a string or binary column; null reads as empty."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0], null


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``most`` bytes together, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of every word, and n + 1 word offsets of the rows."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | cut[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        one = np.ones(1, U64)
        up = np.concatenate([one, np.cumprod(np.full(size - 1, _BASE, U64))])
        down = np.concatenate([one, np.cumprod(np.full(size - 1, _UNBASE, U64))])
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial of its bytes from prefix sums, then mixed."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        span = int(ends[j - 1] - base)
        up, down = _tables(span + 1)
        total = np.zeros(span + 1, U64)
        np.cumsum(value[buf[base : base + span]] * up[:span], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i+k-1 for every start i of the flat array; the last k-1 entries are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, k, U64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * U64(0xA0761D6478BD642F)
        h ^= h >> U64(32)
    return mix(h)

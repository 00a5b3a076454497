"""Vectorised word hashing for Arrow batches of texts.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Those bytes
never occur inside a multi-byte UTF-8 sequence, so words are found on the raw
UTF-8 bytes of a whole batch at once.  Every word gets two independent 64-bit
hashes (sums of bytes times pseudo-random odd multipliers, then mixed), and
sequences of words are hashed by sliding polynomials over them.  Equal words
have equal hashes on every machine: nothing depends on a process seed.

Memory: ``word_chunks`` cuts a batch at document borders into pieces of about
``CHUNK_BYTES`` bytes, so the temporary arrays stay small; a single longer
document makes one longer piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_U = np.uint64
_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def multipliers(seed: int, n: int) -> np.ndarray:
    """The first n odd multipliers of a seed; longer tables extend shorter ones."""
    table = _TABLES.get(seed)
    if table is None or len(table) < n:
        size = max(256, 1 << (int(n) - 1).bit_length())
        at = np.arange(1, size + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 % 2**64)
        _TABLES[seed] = table = mix(at) | _U(1)
    return table


@dataclass
class Words:
    """The words of some consecutive documents of a batch.

    ``docs``: index of the first document; ``first[i]:first[i+1]`` are the
    words of document ``docs + i``; ``start``/``end`` are byte positions in
    ``data``; ``h1``/``h2`` the two word hashes (h2 only when asked for).
    """

    docs: int
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    h1: np.ndarray
    h2: np.ndarray | None


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def word_chunks(texts: pa.Array, lower: bool = False, two: bool = False) -> Iterator[Words]:
    """Words of every text of an Arrow string array; null counts as empty."""
    at, raw = _bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        yield _words(i, at[i : j + 1] - at[i], raw[at[i] : at[j]], lower, two)
        i = j


def _words(docs: int, at: np.ndarray, data: np.ndarray, lower: bool, two: bool) -> Words:
    if lower:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    ink = np.ones(len(data) + 1, bool)
    ink[:-1] = (data != 32) & ((data < 9) | (data > 13))
    ink[-1] = False
    starts = ink.copy()
    starts[1:] &= ~ink[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    starts[inner] |= ink[inner]  # a document starts a word even without a gap before it
    start = np.flatnonzero(starts)
    if not len(start):
        none = np.zeros(0, _U)
        return Words(docs, np.zeros(len(at), np.int64), start, start, data, none, none if two else None)
    # The end of a word: the next gap, or the next document's start.
    gaps = np.flatnonzero(~ink)
    end = gaps[np.searchsorted(gaps, start)]
    end = np.minimum(end, np.append(start[1:], len(data)))
    length = end - start
    word = np.repeat(np.arange(len(start)), length)
    spread = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=spread[1:])
    pos = np.arange(spread[-1]) - spread[word]
    byte = data[start[word] + pos].astype(_U) + _U(1)
    size = int(length.max())
    hashed = [mix(np.add.reduceat(byte * multipliers(s, size)[pos], spread[:-1]) + length.astype(_U)) for s in ((1, 2) if two else (1,))]
    return Words(docs, np.searchsorted(start, at).astype(np.int64), start, end, data, hashed[0], hashed[1] if two else None)


def sliding(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each k consecutive entries (documents' borders not regarded)."""
    if len(h) < k:
        return np.zeros(0, _U)
    c = int(multipliers(seed, 1)[0])
    up = _powers(c, len(h))
    down = _powers(pow(c, -1, 2**64), len(h))
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])


_POWERS: dict[int, np.ndarray] = {}


def _powers(c: int, n: int) -> np.ndarray:
    table = _POWERS.get(c)
    if table is None or len(table) < n:
        table = np.full(1 << (n - 1).bit_length(), c, _U)
        table[0] = 1
        _POWERS[c] = table = np.cumprod(table)
    return table[:n]


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive entries."""
    size = 1
    while size * 2 <= k:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (k - size)], h[k - size :]) if k > size else h

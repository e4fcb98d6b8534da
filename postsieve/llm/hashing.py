"""Hashes of bytes, words and word shingles in numpy, for use inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.default_rng(20240229)
_U = np.uint64
#: A random number for each byte; the second table has A-Z as a-z.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)
PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)
SHINGLE = 5
#: Bytes of a word up to which its hash is a polynomial; modulo 2**64 that has built collisions on long words.
LONG_WORD = 64
_POWERS: dict = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
        inverse = pow(base, -1, 2**64)
        out = []
        for b in (base, inverse):
            column = np.full(size, b & (2**64 - 1), np.uint64)
            column[0] = 1
            out.append(np.cumprod(column))
        known = _POWERS[base] = tuple(out)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of each number over all others."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def number_sums(numbers: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    sums = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(numbers * powers(len(numbers), base)[0][:len(numbers)], out=sums[1:])
    return sums


def prefix_sums(data: np.ndarray, table: np.ndarray = BYTE, base: int = BASES[0]) -> np.ndarray:
    return number_sums(table[data], base)


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of the bytes from each start to its end, wherever they are."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), base)[1][starts] + (ends - starts).astype(np.uint64))


def windows(sums: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """The same hashes as `ranges`, of every string of `size` numbers."""
    return mix((sums[size:] - sums[:-size]) * powers(len(sums), base)[1][:len(sums) - size] + _U(size))


def word_hashes(text: bytes | None, table: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hashes of a text's words in order; with the table LOWER, of A-Z in lower case."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = ranges(prefix_sums(data, table), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[i]:ends[i]].tobytes()
        digest = hashlib.blake2b(word.lower() if table is LOWER else word, digest_size=8).digest()
        words[i] = int.from_bytes(digest, "little")
    return words


def shingle_hashes(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's shingles of `n` words in order, repeats included, A-Z in lower case.

    A text of fewer words is one shingle; one without words, or null, has none.
    """
    words = word_hashes(text, LOWER)
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total += words[i:len(words) - k + 1 + i] * PLACE[i]
    return mix(total)


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, n))

"""Texts as arrays of code points: classes, boundaries and hashes of slices, without
regular expressions and without a loop over characters."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Unicode White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MULTIPLIER = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


@cache
def classes() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    table[WHITE] = SPACE
    return table


class Slab:
    """Several texts end to end: code points, and where each text starts."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.append(0, lengths.cumsum())
        self.joined = joined

    def first(self) -> np.ndarray:
        """True at the first code point of each text."""
        out = np.zeros(len(self.points) + 1, bool)
        out[self.starts[:-1]] = True
        return out[: len(self.points)]


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    out = []
    for m in (MULTIPLIER, inverse):
        p = np.full(n, m, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64, a public constant-time mix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slices:
    """64-bit hashes of any slices of an array of symbols, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _powers(max(10, int(len(symbols)).bit_length()))
        spread = mix(symbols.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(spread * power[: len(symbols)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes start[0], start[0]+1, ... of all ranges, end to end."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)

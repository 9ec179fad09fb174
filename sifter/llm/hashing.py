"""Hashes of words and of runs of words, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all of the argument's."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    x = y >> U(27)
    x ^= y
    x *= U(0x94D049BB133111EB)
    np.right_shift(x, U(31), out=y)
    y ^= x
    return y


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            powers = lambda base: np.cumprod(np.append(U(1), np.full(n, U(base))), dtype=np.uint64)
            self.up, self.down = powers(int(GOLD)), powers(pow(int(GOLD), -1, 1 << 64))
        return self.up, self.down


_POWERS = _Powers()
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
BLANK = 32


def tidied(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each followed by a blank, and how many words each text has.

    Words are runs of bytes other than 9 to 13 and 32.
    """
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = (data == BLANK) | ((data >= 9) & (data <= 13))
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the blank that ends a word stays
    kept = np.where(gap[keep], np.uint8(BLANK), data[keep])
    ends = np.cumsum(keep)[np.cumsum([len(r) + 1 for r in raw]) - 1]  # bytes kept up to the end of each text
    words = np.searchsorted(word_bounds(kept)[1:], ends, side="right")
    return kept, np.diff(np.append(0, words))


def word_bounds(kept: np.ndarray) -> np.ndarray:
    """Where the words of tidied bytes start, and where the last one ends."""
    return np.append(0, np.flatnonzero(kept == BLANK) + 1)


def run_hashes(kept: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of tidied bytes: a difference of prefix sums over all of them."""
    up, down = _POWERS.upto(len(kept) + 1)
    sums = np.zeros(len(kept) + 1, np.uint64)
    np.cumsum(_LETTERS[kept] * up[: len(kept)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(kept: np.ndarray, bounds: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The hash of each word of tidied bytes, about `most` bytes at a time."""
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, len(kept), most)), len(bounds) - 1))
    parts = [np.zeros(0, np.uint64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low = bounds[a]
        parts.append(run_hashes(kept[low : bounds[b]], bounds[a:b] - low, bounds[a + 1 : b + 1] - low))
    return np.concatenate(parts)

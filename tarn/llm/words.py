"""64-bit hashes of the words of many texts at once, in numpy: no table of words, so that a large vocabulary costs nothing."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are hashed at a time, or one word.
PIECE = 1 << 20
_factors = np.empty(0, U64)


def factors(n: int) -> np.ndarray:
    """The first n of a fixed sequence of random odd numbers, one for each place in a word."""
    global _factors
    if len(_factors) < n:
        _factors = np.random.default_rng(20240229).integers(0, 1 << 64, max(256, 2 * n), dtype=U64) | U64(1)
    return _factors


def scramble(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit words in place."""
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the hashes of its words, which are what ASCII white space separates, A-Z lower-cased; null has none.

    A word's hash is the sum of its bytes times the factors of their places, mixed: two words that aren't equal have one
    hash with a probability of about 2**-63.
    """
    parts = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]).lower(), np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    out, done = np.empty(len(starts), U64), 0
    while done < len(starts):
        stop = max(done + 1, int(np.searchsorted(ends, starts[done] + PIECE, "right")))
        letters = data[starts[done] : ends[stop - 1]][inside[starts[done] : ends[stop - 1]]]
        length = size[done:stop]
        first = np.cumsum(length) - length
        place = np.arange(len(letters)) - np.repeat(first, length)
        value = (letters.astype(U64) + U64(1)) * factors(int(length.max()))[place]
        out[done:stop] = scramble(np.add.reduceat(value, first) + length.astype(U64))
        done = stop
    ends_of = np.cumsum([len(p) + 1 for p in parts])
    return np.split(out, np.searchsorted(starts, ends_of[:-1])) if parts else []

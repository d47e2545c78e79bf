"""Rolling and word hashes of UTF-8 texts, in numpy over whole arrays of bytes.

All arithmetic is modulo 2**64.  With powers of an odd base B, the hash of
bytes s to e is (sum of byte * B**i over s <= i < e) * B**-s: it depends on the
bytes alone, not on where they stand.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20
U64 = np.uint64


class Powers:
    """Powers of the base and its inverse, grown as texts need them."""

    up = down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            n = max(2 * len(cls.up), n + 1)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                factors = np.full(n, base, U64)
                factors[0] = 1
                setattr(cls, name, np.multiply.accumulate(factors))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefixes(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any span follows."""
    up, _ = Powers.of(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans start to end."""
    _, down = Powers.of(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order.

    Long texts go in blocks cut at white space, so memory stays bounded unless
    a single word is larger than a block.
    """
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    space = _SPACE[data]
    found, at = [], 0
    while at < len(data):
        to = min(at + BLOCK_BYTES, len(data))
        if to < len(data):
            gaps = np.flatnonzero(space[at:to])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(space[to:])
                to = to + int(later[0]) + 1 if len(later) else len(data)
        edge = np.diff(np.concatenate(([1], space[at:to], [1])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        found.append(spans(prefixes(data[at:to]), start, end))
        at = to
    return np.concatenate(found) if found else np.zeros(0, U64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; fewer words are one shingle."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, U64)
    for k in range(width):
        h = mix(h * U64(BASE) + words[k : k + n])
    return np.unique(h)

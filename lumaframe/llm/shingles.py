"""Word shingles of whole texts as sets of 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(23)
_TURN = _rng.integers(0, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased. A text of
    fewer words than size has one shingle, all its words; one without words has none.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    space = _SPACE[data]
    word = ~space
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sizes = ends - starts
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    splits = np.searchsorted(starts, begins)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    at = np.flatnonzero(word)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP), dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    values = (_LOWER[data[at]] + np.uint64(1)) * powers[at - np.repeat(starts, sizes)]
    words = mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))
    n = len(words)
    joined = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        joined += words[k : k + len(joined)] * _TURN[k]
    joined = mix(joined)
    found = []
    for a, b in zip(splits[:-1].tolist(), splits[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(joined[a : b - size + 1])
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            few = words[a:b] * _TURN[: b - a]
            found.append(mix(np.array([few.sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class Bands:
    """Keys that two sets of similarity s share with probability 1 - (1 - s**rows) ** bands."""

    def __init__(self, bands: int, rows: int, seed: int = 41):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.turn = rng.integers(0, 2**31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.flip = rng.integers(0, 2**32, bands * rows).astype(np.uint32)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.turn), np.uint32(2**32 - 1))
        for i in range(0, len(high), 256):  # as many as stay in a core's cache
            low = np.minimum(low, ((high[i : i + 256, None] ^ self.flip) * self.turn).min(0))
        low = mix(low.astype(np.uint64)).reshape(self.bands, self.rows)
        total = self.salt.copy()
        for r in range(self.rows):
            total = mix(total * _TURN[r] + low[:, r])
        return total.view(np.int64)

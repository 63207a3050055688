"""Word shingles as sets of 64-bit hashes, and MinHash signatures. Runs inside tasks; sent there by value."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash one task remembers before it starts anew.
MEMORY = 150_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and at tab to carriage return; the rest of Unicode stays as it is."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence as one; of none, nothing."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    width = min(k, n)
    mixed = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            mixed = (mixed ^ h[j:n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def coordinates(count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 2**64, count, dtype=np.uint64)
    return draw() | np.uint64(1), draw(), draw()


def signature(shingles: np.ndarray, coords: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Per coordinate the least shingle under its own ordering, mixed with the coordinate into one posting key."""
    a, b, tag = coords
    least = np.full(len(a), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), chunk):
            part = shingles[at:at + chunk]
            np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=least)
        key = (least ^ tag) * np.uint64(0xD6E8FEB86659FD93)
        return (key ^ (key >> np.uint64(32))).view(np.int64)

"""Statistics of whole texts, transformed to be near normal. Runs inside tasks; sent there by value."""

from __future__ import annotations

import operator

import numpy as np

NAMES = [
    "words", "word_bytes", "long_word", "upper", "digit", "symbol", "pipe", "shout", "full_stop", "comma", "line_break",
    "beyond_ascii", "distinct_words", "distinct_pairs", "repeat", "distinct_lines",
]

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line break, 6 full stop, 7 comma, 8 pipe, 9 ! or ?, 10 symbol, 11 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 10
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _bytes, _c in ((b" \t\x0b\x0c\r", 4), (b"\n", 5), (b".", 6), (b",", 7), (b"|", 8), (b"!?", 9), (b"'\"-:;()", 0)):
    _CLASS[list(_bytes)] = _c
_CLASS[128:] = 11


def statistics(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=12).astype(float)
    words = data.split()
    lines = data.split(b"\n")
    n = len(words)
    size, letters = len(data) + 1.0, counts[1] + counts[2] + counts[11] + 1.0
    share = lambda x, of: np.log((x + 0.5) / (of + 1.0))
    return np.array([
        np.log1p(n), np.log1p((size - counts[4] - counts[5]) / (n + 1.0)), np.log1p(max(map(len, words), default=0)),
        share(counts[2], letters), share(counts[3], size), share(counts[10], size), share(counts[8], size), share(counts[9], size),
        share(counts[6], n), share(counts[7], n), share(counts[5], n), share(counts[11], letters),
        share(len(set(words)), n), share(len(set(zip(words, words[1:]))), n), share(sum(map(operator.eq, words, words[1:])), n),
        share(len(set(lines)), len(lines)),
    ])


def statistics_of(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))

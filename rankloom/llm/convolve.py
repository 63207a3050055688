"""Maximal periodic runs of word sequences by block convolution. Runs inside tasks; sent there by value.

Words are numbers, different in each document, so many documents are searched as
one sequence. A run of period q is a stretch of at least q places where a word
equals the one q places on. At scale b = 4, 8, 16, ... and periods 2b-1 to 4b-2
such a stretch holds an aligned block of b words, so the sum of squared
differences between that block and the words q places on is zero. All sums of a
block come from one product of number-theoretic transforms, taken exactly modulo
a prime as matrix products of whole numbers below 2^53; a sum that is zero only
modulo the prime is found out by comparing words. Blocks that match side by side
at one distance join, and what is left on either side is shorter than a block.
Periods below the first scale are compared place by place.

Blocks inside a run of a small period match at every multiple of it. Those say
nothing new and go; where such a block meets another run of its period, both
ends are skipped at once. So a text that is one word over and over costs no more
than any other.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: 7 * 2^20 + 1; 3 generates its multiplicative group.
PRIME, ROOT = 7340033, 3
LEAST = 12
FIRST = 4
#: The longest block; longer distances are searched in several windows.
LONGEST = 1 << 18
#: Numbers held in one transform.
CELLS = 1 << 20


def reduced(x: np.ndarray) -> np.ndarray:
    """To the residues around 0, in place; exact for whole numbers below 2^53."""
    x -= np.rint(x * (1.0 / PRIME)) * PRIME
    return x


@cache
def _powers(n: int) -> np.ndarray:
    """Powers 0 to n-1 of a root of unity of order n."""
    w, out = pow(ROOT, (PRIME - 1) // n, PRIME), np.ones(n)
    for i in range(n.bit_length() - 1):
        half = 1 << i
        out[half:2 * half] = reduced(out[:half] * float(pow(w, half, PRIME)))
    return out


@cache
def _matrix(n: int, inverse: bool) -> np.ndarray:
    at = np.outer(np.arange(n), np.arange(n)) % n
    if not inverse:
        return _powers(n)[at].copy()
    return reduced(_powers(n)[-at % n] * float(pow(n, -1, PRIME)))


@cache
def _twist(n1: int, n2: int, inverse: bool) -> np.ndarray:
    at = np.outer(np.arange(n1), np.arange(n2)) % (n1 * n2)
    return _powers(n1 * n2)[-at % (n1 * n2) if inverse else at][:, :, None].copy()


def _factors(n: int) -> list[int]:
    """Powers of two of 64 at most whose product is n."""
    bits = n.bit_length() - 1
    steps = -(-bits // 6)
    return [1 << (bits // steps + (i < bits % steps)) for i in range(steps)]


def transform(x: np.ndarray) -> np.ndarray:
    """Of each column of x (n rows, a power of two); frequencies in the order that ``restore`` takes."""
    n, columns = x.shape
    x, left = x.reshape(1, n, columns), n
    for f in _factors(n):
        left //= f
        x = reduced(np.matmul(_matrix(f, False), x.reshape(-1, f, left * columns)))
        if left > 1:
            x = reduced(x.reshape(-1, f, left, columns) * _twist(f, left, False))
        x = x.reshape(-1, left, columns)
    return x.reshape(n, columns)


def restore(x: np.ndarray) -> np.ndarray:
    n, columns = x.shape
    left = 1
    for f in reversed(_factors(n)):
        x = x.reshape(-1, f, left, columns)
        if left > 1:
            x = reduced(x * _twist(f, left, True))
        x = reduced(np.matmul(_matrix(f, True), x.reshape(-1, f, left * columns)))
        left *= f
    return x.reshape(n, columns)


def zero_sums(values: np.ndarray, squares: np.ndarray, starts: np.ndarray, b: int, least: int, most: int):
    """(start, distance) at which a block of b values may equal those ``distance`` on. ``squares`` are running sums; ``values`` go on past every window."""
    n = 1 << (3 * b - 2).bit_length()
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for lo in range(least, most + 1, n - b + 1):
        wide = min(n - b + 1, most + 1 - lo)
        for at in range(0, len(starts), max(1, CELLS // n)):
            s = starts[at:at + max(1, CELLS // n)]
            block, window = np.zeros((n, len(s))), np.zeros((n, len(s)))
            block[:b] = values[s + np.arange(b - 1, -1, -1)[:, None]]
            window[:wide + b - 1] = values[s + lo + np.arange(wide + b - 1)[:, None]]
            product = restore(reduced(transform(block) * transform(window)))[b - 1:b - 1 + wide]
            there = s + lo + np.arange(wide)[:, None]
            sums = squares[there + b] - squares[there] + (squares[s + b] - squares[s]) - 2.0 * product
            d, k = np.nonzero(reduced(sums) == 0)
            found.append((s[k], d + lo))
    return tuple(np.concatenate(c) for c in zip(*found))


class Runs:
    """Runs found so far: starts, ends and periods; of several over one interval the smallest period."""

    def __init__(self):
        self.start = self.end = self.period = np.empty(0, np.int64)

    def add(self, start, end, period) -> None:
        long = end - start >= np.maximum(LEAST, 2 * period)
        s, e, q = (np.concatenate([old, new[long]]) for old, new in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((q, e, s))
        s, e, q = s[order], e[order], q[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        by_period = np.lexsort((s[first], q[first]))
        self.start, self.end, self.period = (c[first][by_period] for c in (s, e, q))

    def over_blocks(self, b: int, blocks: int) -> np.ndarray:
        """For each aligned block the run around it whose period is at most b/2 (there is one at most), or -1."""
        out = np.full(blocks, -1, np.int64)
        lo, hi = -(-self.start // b), self.end // b
        for k in np.flatnonzero((2 * self.period <= b) & (hi > lo)):
            out[lo[k]:hi[k]] = k
        return out

    def around(self, run: np.ndarray, at: np.ndarray, b: int) -> np.ndarray:
        """The run of the same period as ``run`` around ``at`` to ``at + b``, or -1."""
        wide = np.int64(1) << 40
        k = np.searchsorted(self.period * wide + self.start, self.period[run] * wide + at, side="right") - 1
        near = np.maximum(k, 0)
        return np.where((k >= 0) & (self.period[near] == self.period[run]) & (self.end[near] >= at + b), near, -1)


def _reach(words: np.ndarray, x: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many places from x on (step -1: back from x) equal those q further."""
    out, active, off, wide = np.zeros(len(x), np.int64), np.arange(len(x)), 0, 8
    while active.size:
        wide = max(1, min(wide, CELLS // active.size))
        at = x[active][:, None] + step * (off + np.arange(wide))
        inside = (at >= 0) & (at + q[active][:, None] < len(words))
        at = np.where(inside, at, 0)
        other = ~inside | (words[at] != words[np.where(inside, at + q[active][:, None], 0)])
        stop = other.any(axis=1)
        out[active[stop]] = off + other[stop].argmax(axis=1)
        active, off, wide = active[~stop], off + wide, 2 * wide
    return out


def _equal(words: np.ndarray, x: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words from x on equal those q further."""
    out, active, off, wide = np.ones(len(x), bool), np.arange(len(x)), 0, 8
    while active.size:
        wide = max(1, min(wide, CELLS // active.size))
        t = off + np.arange(wide)
        used = t < n[active][:, None]
        at = np.where(used, x[active][:, None] + t, x[active][:, None])
        differ = (used & (words[at] != words[at + q[active][:, None]])).any(axis=1)
        out[active[differ]] = False
        active, off, wide = active[~differ & (n[active] > off + wide)], off + wide, 2 * wide
    return out


def runs(words: np.ndarray, starts: np.ndarray) -> Runs:
    """Maximal runs of the documents that begin at ``starts`` in ``words`` (numbers; none occurs in two documents)."""
    found, n = Runs(), len(words)
    sizes = np.diff(np.append(starts, n))
    longest = int(sizes.max(initial=0))
    for q in range(1, min(2 * FIRST - 2, longest // 2) + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], words[q:] == words[:-q], [False]]).astype(np.int8)))
        found.add(edge[::2], edge[1::2] + q, np.full(len(edge) // 2, q))
    if longest < 2 * (2 * FIRST - 1):
        return found
    owner = np.repeat(np.arange(len(starts)), sizes)
    # A word met once in its document is in no run; a number drawn by word spreads sums over all residues.
    once = np.append(0, np.cumsum(np.bincount(words)[words] == 1))
    drawn = np.random.default_rng(1).integers(0, PRIME, int(words.max()) + 1)[words].astype(float) - PRIME // 2
    squares, b = np.append(0.0, np.cumsum(np.mod(drawn * drawn, PRIME))), FIRST
    while 2 * (2 * b - 1) <= longest:
        most = longest // 2 if b == LONGEST else min(4 * b - 2, longest // 2)
        at = np.arange(n // b, dtype=np.int64) * b
        end = (starts + sizes)[owner[at]]
        use = (sizes[owner[at]] >= 2 * (2 * b - 1)) & (at + 3 * b - 1 <= end) & (once[at + b] == once[at])
        past = most + 2 * b + 1
        values, sums = np.append(drawn, np.zeros(past)), np.append(squares, np.full(past, squares[-1]))
        x, q = zero_sums(values, sums, at[use], b, 2 * b - 1, most)
        inside = x + q + b <= n
        x, q = x[inside], q[inside]
        _extend(words, found, x, q, b)
        if b == LONGEST:
            break
        b *= 2
    return found


def _extend(words: np.ndarray, found: Runs, x: np.ndarray, q: np.ndarray, b: int) -> None:
    """Adds the runs that matching blocks (x, q) are seeds of."""
    run = found.over_blocks(b, len(words) // b)[x // b]
    other = np.full(len(x), -1, np.int64)
    known = run >= 0
    other[known] = found.around(run[known], (x + q)[known], b)
    keep = ~known | (other != run)
    x, q, run, other = x[keep], q[keep], run[keep], other[keep]
    both = (run >= 0) & (other >= 0)
    # Two blocks of one period are equal where one period of each is.
    sure = _equal(words, x, q, np.where(both, found.period[run] if len(found.period) else 0, b))
    x, q, run, other, both = x[sure], q[sure], run[sure], other[sure], both[sure]
    order = np.lexsort((x, q))
    x, q, run, other, both = x[order], q[order], run[order], other[order], both[order]
    if not len(x):
        return
    joined = (q[1:] == q[:-1]) & (x[1:] == x[:-1] + b)
    first, last = np.append(True, ~joined), np.append(~joined, True)
    before, after = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if both.any():
        r, o, xb, qb = run[both], other[both], x[both], q[both]
        before[both] = np.minimum(xb - found.start[r], xb + qb - found.start[o])
        after[both] = np.minimum(found.end[r] - xb - b, found.end[o] - xb - qb - b)
    q, left, right = q[first], x[first] - before[first], x[last] + b + after[last]
    left = left - _reach(words, left - 1, q, -1)
    right = right + _reach(words, right, q, 1)
    found.add(left, right + q, q)

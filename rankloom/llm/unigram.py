"""Unigram tokens by Viterbi over a double-array trie, for many words at a time. Runs inside tasks; sent there by value."""

from __future__ import annotations

import re

import numpy as np

MARK = "▁"
PENALTY = 10.0  # of an unknown character, below the least score
MEMORY = 250_000  # words
CELLS = 500_000  # of a search, some 30 bytes each


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): from state s byte c leads to base[s] + c if check there is s; value is the key that ends there or -1."""
    tree: list[dict[int, int]] = [{}]
    ends = [-1]
    for i, key in enumerate(keys):
        at = 0
        for c in key:
            nxt = tree[at].get(c)
            if nxt is None:
                nxt = tree[at][c] = len(tree)
                tree.append({})
                ends.append(-1)
            at = nxt
        ends[at] = i
    size = len(tree) * 2 + 1024
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    place, free = {0: 0}, np.ones(size, bool)
    free[0], value[0], check[0] = False, ends[0], -2
    begin = [1] * 257  # by number of children: lower places were taken when one as large was put in
    for node in range(len(tree)):
        kids = sorted(tree[node])
        if not kids:
            continue
        offsets, b = np.array(kids), begin[len(kids)]
        while True:
            if b + 1024 >= len(free):
                grow = len(free)
                base, value = np.append(base, np.zeros(grow, np.int64)), np.append(value, np.full(grow, -1))
                check, free = np.append(check, np.full(grow, -1)), np.append(free, np.ones(grow, bool))
            fits = free[b + offsets[:, None] + np.arange(512)[None, :]].all(axis=0)
            if fits.any():
                b += int(np.argmax(fits))
                break
            b += 512
        begin[len(kids)] = b
        s = place[node]
        base[s] = b
        for c in kids:
            t = b + c
            child = tree[node][c]
            place[child], free[t], check[t], value[t] = t, False, s, ends[child]
    top = int(np.flatnonzero(~free).max()) + 257
    return base[:top].copy(), np.append(check, np.full(257, -1))[:top].copy(), value[:top].copy()


class Unigram:
    """Pieces with log scores; ids are positions in the vocabulary."""

    def __init__(self, pieces: list[str], scores: np.ndarray, usable: np.ndarray, byte_ids: np.ndarray, dummy_prefix: bool = True):
        ids = np.flatnonzero(usable)
        self.ids = ids
        self.base, self.check, self.value = double_array([pieces[i].encode() for i in ids])
        self.scores = np.asarray(scores, float)[ids]
        self.unknown = self.scores.min() - PENALTY
        self.byte_ids = byte_ids
        self.dummy_prefix = dummy_prefix
        # Characters of pieces of two or more; others stand alone, so a text may be cut at either side of them.
        joined = {c for i in ids if len(pieces[i]) > 1 for c in pieces[i]}
        inner = any(MARK in pieces[i].lstrip(MARK) for i in ids)
        run = "[" + "".join(map(re.escape, sorted(joined - {MARK}))) + "]" if joined - {MARK} else "(?!)"
        lead = "" if inner else f"{MARK}*"
        body = run.replace("[", f"[{MARK}", 1) if inner else run
        self.cut = re.compile(f"{lead}{body}+|{MARK}+|[^{MARK}]", re.S)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not inner else None
        raw = [b""] * len(pieces)
        for i in ids:
            raw[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        self.raw_at = np.cumsum([0] + [len(r) for r in raw])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.fallback = np.zeros(len(pieces), bool)
        self.fallback[byte_ids] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def best_paths(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each byte string on its own."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[list[int]] = [[]] * len(words)
        at = 0
        while at < len(order):
            to, width = at, 1
            while to < len(order) and (to == at or (to + 1 - at) * len(words[order[to]]) <= CELLS):
                width = max(1, len(words[order[to]]))
                to += 1
            for i, got in zip(order[at:to], self._block([words[i] for i in order[at:to]], width)):
                out[i] = got
            at = to
        return out

    def _block(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        size = np.array([len(w) for w in words])
        data = np.zeros((n, width + 1), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(size) - size
        rows = np.repeat(np.arange(n), size)
        cols = np.arange(len(flat)) - np.repeat(starts, size)
        data[rows, cols] = flat
        head = (data & 0xC0) != 0x80
        score = np.full((n, width + 1), -np.inf)
        score[:, 0] = 0
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int64)
        for pos in range(width):
            live = np.flatnonzero((size > pos) & head[:, pos])
            if not len(live):
                continue
            ends = np.full(len(live), width)
            for k in range(1, 5):
                ends = np.where((ends == width) & (pos + k <= width) & (head[live, min(pos + k, width)] | (size[live] <= pos + k)), pos + k, ends)
            single = np.zeros(n, bool)
            state, on, k = np.zeros(len(live), np.int64), live, pos
            char_end = np.zeros(n, np.int64)
            char_end[live] = ends
            while len(on) and k < width:
                nxt = self.base[state] + data[on, k]
                ok = (self.check[nxt] == state) & (size[on] > k)
                on, state = on[ok], nxt[ok]
                k += 1
                value = self.value[state]
                hit = value >= 0
                if hit.any():
                    r, v = on[hit], value[hit]
                    new = score[r, pos] + self.scores[v]
                    better = new > score[r, k]
                    r2 = r[better]
                    score[r2, k], back[r2, k], piece[r2, k] = new[better], pos, v[better]
                    single[r[char_end[r] == k]] = True
            lone = live[~single[live]]
            if len(lone):
                e = char_end[lone]
                new = score[lone, pos] + self.unknown
                better = new > score[lone, e]
                lone, e = lone[better], e[better]
                score[lone, e], back[lone, e], piece[lone, e] = new[better], pos, -1
        out = []
        for i in range(n):
            got, at = [], int(size[i])
            while at > 0:
                frm, p = int(back[i, at]), int(piece[i, at])
                if p >= 0:
                    got.append(int(self.ids[p]))
                else:
                    got.extend(int(self.byte_ids[b]) for b in reversed(words[i][frm:at]))
                at = frm
            out.append(got[::-1])
        return out

    def _remember(self, words: list[str]) -> None:
        """Add words to the pool: each is cut where no piece can cross."""
        parts, counts = [], []
        for w in words:
            cut = self.cut.findall(w)
            parts += cut
            counts.append(len(cut))
        distinct = list(dict.fromkeys(parts))
        place = {p: i for i, p in enumerate(distinct)}
        paths = self.best_paths([p.encode("utf-8", "surrogatepass") for p in distinct])
        at, new, ends = 0, [], []
        for c in counts:
            for p in parts[at:at + c]:
                new += paths[place[p]]
            at += c
            ends.append(len(new))
        first = len(self.known)
        self.known.update((w, first + i) for i, w in enumerate(words))
        self.at = np.concatenate([self.at, len(self.pool) + np.array(ends, np.int64)])
        self.pool = np.concatenate([self.pool, np.array(new, np.int32)])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts one after the other; null texts are empty."""
        if len(self.known) > MEMORY:
            self.forget()
        lists = []
        for text in texts:
            marked = (text or "").replace(" ", MARK)
            if marked and self.dummy_prefix:
                marked = MARK + marked
            lists.append(self.words.findall(marked) if self.words else ([marked] if marked else []))
        fresh = {w for words in lists for w in words if w not in self.known}
        if fresh:
            self._remember(sorted(fresh))
        known = self.known
        counts = np.array([len(x) for x in lists], np.int64)
        idx = np.fromiter((known[w] for words in lists for w in words), np.int64, int(counts.sum()))
        ids, sizes = _gather(self.pool, self.at, idx)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ends[np.concatenate([[0], np.cumsum(counts)])], ids

    def decode(self, ids: np.ndarray) -> str:
        """Text of one document's ids; broken byte sequences become U+FFFD."""
        data, _ = _gather(self.raw, self.raw_at, np.asarray(ids, np.int64))
        text = data.tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _gather(pool: np.ndarray, at: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pool[at[i]:at[i + 1]]`` of every i one after the other, and their sizes."""
    starts, sizes = at[idx], at[idx + 1] - at[idx]
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return pool[shift + np.arange(total)], sizes

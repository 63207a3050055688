"""A hierarchical navigable small-world graph over unit vectors. Runs inside tasks; sent there by value."""

from __future__ import annotations

import heapq
import pickle

import numpy as np


def unit(vectors) -> np.ndarray:
    """Rows scaled to length 1 in double precision; first by their largest part, so no square overflows."""
    x = np.array(vectors, float).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, seed: int = 5):
        self.x, self.links, self.beam = vectors, links, beam
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 12)
        self.near: list[dict[int, np.ndarray]] = [{} for _ in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        self.stamp, self.turn = np.zeros(n, np.int64), 0
        for i in range(n):
            self._insert(i)
        self._both_ways()

    def _both_ways(self) -> None:
        """Walk links of the lowest level in both directions: in a dense group pruning may leave a node that no other points to."""
        back: dict[int, list[int]] = {}
        for i, around in self.near[0].items():
            for j in around.tolist():
                back.setdefault(j, []).append(i)
        for j, more in back.items():
            self.near[0][j] = np.union1d(self.near[0][j], np.array(more, np.int32)).astype(np.int32)

    def dumps(self) -> bytes:
        return pickle.dumps((self.x, self.links, self.beam, self.level, self.near, self.entry))

    @classmethod
    def loads(cls, data: bytes) -> "Graph":
        g = cls.__new__(cls)
        g.x, g.links, g.beam, g.level, g.near, g.entry = pickle.loads(data)
        g.stamp, g.turn = np.zeros(len(g.x), np.int64), 0
        return g

    def _search(self, q: np.ndarray, starts: list[int], beam: int, level: int, floor: float = 2.0) -> list[tuple[float, int]]:
        """(cosine, node) of the nodes met, best first: a beam search that also goes on through every node of cosine ``floor`` or more."""
        self.turn += 1
        stamp, turn, near, x = self.stamp, self.turn, self.near[level], self.x
        stamp[starts] = turn
        sims = x[starts] @ q
        open_ = [(-s, i) for s, i in zip(sims.tolist(), starts)]
        heapq.heapify(open_)
        best = [(s, i) for s, i in zip(sims.tolist(), starts)]
        heapq.heapify(best)
        over: list[tuple[float, int]] = []  # pushed out of the beam, but at least ``floor``
        while open_:
            s, i = heapq.heappop(open_)
            s = -s
            if len(best) >= beam and s < best[0][0] and s < floor:
                break
            around = near[i]
            around = around[stamp[around] != turn]
            if not len(around):
                continue
            stamp[around] = turn
            sims = x[around] @ q
            worst = best[0][0] if len(best) >= beam else -2.0
            for s2, j in zip(sims.tolist(), around.tolist()):
                if s2 > worst or s2 >= floor or len(best) < beam:
                    heapq.heappush(open_, (-s2, j))
                    heapq.heappush(best, (s2, j))
                    if len(best) > beam:
                        out = heapq.heappop(best)
                        if out[0] >= floor:
                            over.append(out)
                    worst = best[0][0] if len(best) >= beam else -2.0
        return sorted(best + over, reverse=True)

    def _descend(self, q: np.ndarray, to: int) -> int:
        at = self.entry
        for level in range(int(self.level[self.entry]), to, -1):
            at = self._search(q, [at], 1, level)[0][1]
        return at

    def _spread(self, cosines: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in several directions: one that is closer to a chosen one than to the node waits until last."""
        if len(nodes) <= most:
            return nodes
        among = self.x[nodes] @ self.x[nodes].T
        chosen, rest, nearest = [], [], np.full(len(nodes), -2.0)
        for k in range(len(nodes)):
            if nearest[k] < cosines[k]:
                chosen.append(k)
                np.maximum(nearest, among[k], out=nearest)
                if len(chosen) == most:
                    break
            else:
                rest.append(k)
        return nodes[(chosen + rest)[:most]]

    def _insert(self, i: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            for level in range(top + 1):
                self.near[level][i] = np.empty(0, np.int32)
            self.entry = i
            return
        q, high = self.x[i], int(self.level[self.entry])
        starts = [self._descend(q, top)]
        for level in range(top, high, -1):
            self.near[level][i] = np.empty(0, np.int32)
        for level in range(min(top, high), -1, -1):
            found = self._search(q, starts, self.beam, level)
            most = 2 * self.links if level == 0 else self.links
            mine = self._spread(np.array([s for s, _ in found]), np.array([j for _, j in found], np.int32), self.links)
            self.near[level][i] = mine
            for j in mine.tolist():
                theirs = np.append(self.near[level][j], np.int32(i))
                if len(theirs) > most:
                    sims = self.x[theirs] @ self.x[j]
                    order = np.argsort(-sims, kind="stable")
                    theirs = self._spread(sims[order], theirs[order], most)
                self.near[level][j] = theirs
            starts = [j for _, j in found[:8]]
        if top > high:
            self.entry = i

    def within(self, q: np.ndarray, least: float, beam: int, slack: float = 0.04) -> np.ndarray:
        """Nodes found with cosine of at least ``least`` in double precision."""
        found = self._search(q, [self._descend(q, 0)], beam, 0, least - slack)
        nodes = np.array([j for s, j in found if s >= least - 1e-9], np.int64)
        return nodes[(self.x[nodes] * q).sum(axis=1) >= least]


def linked(graph: Graph, queries: np.ndarray, least: float, beam: int, audits: int) -> tuple[list[np.ndarray], int, float]:
    """(hits of every query, widest beam, share of the links that the first walks found).

    Every query is audited: compared with the whole graph, ``audits`` at a time.
    Those that miss any of their own links walk again with twice the beam, until
    none does or the beam spans the graph; what no walk reaches is added. The
    share is a mean over the queries that link with another vector, self hits
    left out.
    """
    hits = _hits(graph, queries, least, beam)
    short, shares = {}, []
    for start in range(0, len(queries), audits):
        for k, truth in enumerate(_truth(graph, queries[start:start + audits], least), start):
            missed = np.setdiff1d(truth, hits[k]) if len(hits[k]) < len(truth) else truth[:0]
            others = len(truth)
            if others == 1 or len(missed):
                others -= int((graph.x[truth] == queries[k]).all(axis=1).any())
                missed = missed[~(graph.x[missed] == queries[k]).all(axis=1)]
            if others:
                shares.append(1 - len(missed) / others)
            if len(hits[k]) < len(truth):
                short[k] = truth
    recall = float(np.mean(shares)) if shares else 1.0
    while short and beam < len(graph.x):
        beam *= 2
        again = sorted(short)
        for k, found in zip(again, _hits(graph, queries[again], least, beam)):
            hits[k] = np.union1d(hits[k], found)
            if len(hits[k]) >= len(short[k]):
                del short[k]
    for k, truth in short.items():
        hits[k] = truth
    return hits, beam, recall


def _truth(graph: Graph, queries: np.ndarray, least: float) -> list[np.ndarray]:
    """Nodes linked to each query by brute force."""
    return [_above(graph.x, q, least, s) for q, s in zip(queries, (graph.x @ queries.T).T)]


def _above(x: np.ndarray, q: np.ndarray, least: float, cosines: np.ndarray) -> np.ndarray:
    """Rows of ``x`` with cosine of at least ``least``; near the bound the sum is made in one order, so that both ends of a link agree."""
    nodes = np.flatnonzero(cosines >= least - 1e-9)
    close = nodes[cosines[nodes] < least + 1e-9]
    if not len(close):
        return nodes
    return np.setdiff1d(nodes, close[(x[close] * q).sum(axis=1) < least])


def _hits(graph: Graph, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
    """Nodes linked to each query.

    Queries that link with a query just searched share its walk: what they link
    with lies within twice the angle of it, so one wider walk and one product of
    matrices serve a whole dense group.
    """
    out: list[np.ndarray | None] = [None] * len(queries)
    open_ = np.ones(len(queries), bool)
    wide = 2 * least * least - 1
    for i, q in enumerate(queries):
        if not open_[i]:
            continue
        group = np.flatnonzero(open_ & (queries @ q >= least))
        if len(group) <= 1:
            group = np.array([i])
            out[i] = graph.within(q, least, beam)
        else:
            near = graph.within(q, wide, beam)
            x = graph.x[near]
            for g, cosines in zip(group, (x @ queries[group].T).T):
                out[g] = near[_above(x, queries[g], least, cosines)]
        open_[group] = False
    return out


def forest(edges) -> list[tuple[int, int]]:
    """A spanning forest of (a, b) edges."""
    root: dict[int, int] = {}

    def top(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for a, b in edges:
        ra, rb = top(a), top(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out

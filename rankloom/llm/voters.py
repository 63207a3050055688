"""Voters of the toxicity label model. Runs inside tasks; sent there by value."""

from __future__ import annotations

import zlib

import numpy as np

#: Hand-written lexicons; each is one voter.
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid dumb imbecile fool foolish dimwit halfwit brainless clueless dunce",
    "worth": "worthless pathetic loser losers useless trash garbage failure nobody miserable lowlife",
    "disgust": "disgusting scum filth filthy vermin vile repulsive parasite parasites pig pigs rat rats creep",
    "ridicule": "clown clowns joke laughable ridiculous crybaby coward cowards liar liars",
    "menace": "kill hurt destroy hate hang shoot suffer",
}
ADDRESS = set("you your youre ur du dich dein ihr tu toi te vous usted ustedes eres".split())
LEET = str.maketrans("013457@$!", "oieastasi")
PREFIXES = range(4, 9)

_TABLE = bytes(b if 97 <= b < 123 or 48 <= b < 58 or b >= 128 else 32 for b in range(256))
MEMORY = 100_000


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits, so symbols beside a word do not hide it."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def entries_of(token: bytes) -> list[str]:
    """What an induced lexicon may hold of a token: itself, and its beginnings with its length."""
    word = token.decode("utf-8", "replace")
    return [f"={word}"] + [f"^{word[:n]}:{len(word)}" for n in PREFIXES if n < len(word)]


#: An induced entry belongs to a voter by its kind and by how many times likelier it is in toxic rows.
STRENGTHS = (8, 20, 50, 150)


class Voters:
    """Votes by hand-written lexicons, induced lexicons by strength and group, and patterns."""

    def __init__(self, induced: dict[str, float], groups: int = 4):
        self.groups = groups
        kinds = [f"{k}{s}.{g}" for k in ("word", "begin") for s in STRENGTHS for g in range(groups)]
        self.names = [*LEXICONS, *kinds, "leet", "addressed"]
        self.hand = {w: i for i, words in enumerate(LEXICONS.values()) for w in words.split()}
        self.induced = {e: self._voter(e, ratio) for e, ratio in induced.items()}

    def _voter(self, entry: str, ratio: float) -> int:
        strength = max(i for i, s in enumerate(STRENGTHS) if ratio >= s or i == 0)
        kind = 0 if entry[0] == "=" else 1
        return len(LEXICONS) + (kind * len(STRENGTHS) + strength) * self.groups + zlib.crc32(entry.encode()) % self.groups

    def of_token(self, token: bytes) -> tuple[int, ...]:
        word = token.decode("utf-8", "replace")
        found = [self.hand[word]] if word in self.hand else []
        plain = word.translate(LEET)
        if not found and plain != word and plain in self.hand:
            found.append(len(self.names) - 2)
        found += sorted({self.induced[e] for e in entries_of(token) if e in self.induced})
        return tuple(found)

    def counts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(hits per voter, number of tokens) of each text."""
        known = _Known(self.of_token)
        out, sizes = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for i, text in enumerate(texts):
            tokens = tokens_of(text)
            sizes[i] = len(tokens)
            for at, got in [(at, got) for at, got in enumerate(map(known.__getitem__, tokens)) if got]:
                out[i, list(got)] += 1
                if got[0] < len(LEXICONS) and any(t.decode("utf-8", "replace") in ADDRESS for t in tokens[max(0, at - 3):at]):
                    out[i, -1] += 1
        return out, sizes


class _Known(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        got = self[key] = self.make(key)
        return got


def features(hits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Inputs of the linear classifier: log hits of each voter, density of all hits, and a constant."""
    total = hits.sum(axis=1)
    return np.column_stack([np.log1p(hits), np.log1p(1000 * total / (sizes + 20)), np.log1p((hits > 0).sum(axis=1)), np.ones(len(hits))])

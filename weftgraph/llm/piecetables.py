"""A byte-pair piece model compiled to arrays: which pieces can end where, and which pieces can stand next to each other.

A sequence of pieces is what merging gives for its text exactly if each piece gives itself and every two neighbours give
themselves. Whether two neighbours do is a test of ranks along their inner borders: undone from the last merge on, the pieces
at the border at any time must not merge before one of them is merged away (of equal ranks the left merge comes first).
"""

from __future__ import annotations

import numpy as np

from .bpe import Merges

NONE = -1
MEMO_BITS = 18


def _scatter(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class IntMap:
    """A fixed map of non-negative integers to integers, looked up for arrays at once (open addressing)."""

    def __init__(self, entries: dict[int, int]):
        self.bits = max(4, (4 * len(entries)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, NONE, np.int64), np.full(1 << self.bits, NONE, np.int32)
        mask = (1 << self.bits) - 1
        keys = np.fromiter(entries, np.int64, len(entries))
        for k, at in zip(keys.tolist(), _scatter(keys, self.bits).tolist(), strict=True):
            while self.keys[at] != NONE:
                at = (at + 1) & mask
            self.keys[at], self.values[at] = k, entries[k]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; NONE for unknown keys."""
        at = _scatter(keys, self.bits)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        left = np.flatnonzero((found != keys) & (found != NONE))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != NONE)]
        return out


class Memo:
    """The results of a function of integer keys, kept in a table of fixed size; a new key takes an old one's place."""

    def __init__(self, f, bits: int = MEMO_BITS):
        self.f, self.bits = f, bits
        self.keys, self.values = np.full(1 << bits, NONE, np.int64), np.zeros(1 << bits, np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = _scatter(keys, self.bits)
        out = self.values[at]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            own, back = np.unique(keys[miss], return_inverse=True)
            found = self.f(own)
            out[miss] = found[back]
            where = _scatter(own, self.bits)  # of several keys for one place the last stays, in both arrays
            self.keys[where], self.values[where] = own, found
        return out


class PieceTables:
    """The pieces as an automaton over code points, and the test of neighbours.

    score: of every piece, lower merges first. Pieces have numbers in the order given; UNKNOWN stands for any character that
    no piece holds.
    """

    def __init__(self, score: dict[str, float]):
        self.pieces = list(score)
        self.merges = Merges(lambda a, b: (score[a + b], a + b) if a + b in score else None)
        number = {p: i for i, p in enumerate(self.pieces)}
        for c in sorted({c for p in self.pieces for c in p} - number.keys()):
            number[c] = len(self.pieces)
            self.pieces.append(c)
        n = self.unknown = len(self.pieces)
        self.length = np.array([len(p) for p in self.pieces] + [1], np.int32)
        level = {s: i for i, s in enumerate(sorted(set(score.values())))}
        self.rank = np.array([level[score[p]] if len(p) > 1 else NONE for p in self.pieces] + [NONE], np.int64)
        # The two pieces that a piece is merged from, if its text gives it; whether that happens in rising order of rank.
        self.left, self.right = np.full(n + 1, NONE, np.int32), np.full(n + 1, NONE, np.int32)
        alone, self.odd = [], np.zeros(n + 1, bool)
        for i, p in enumerate(self.pieces):
            if len(p) == 1:
                alone.append(p)
            elif (halves := self.merges.halves(p)) is not None:
                alone.append(p)
                self.left[i], self.right[i] = (number[h] for h in halves)
        for i in sorted((number[p] for p in alone if len(p) > 1), key=lambda i: self.length[i]):
            a, b = self.left[i], self.right[i]
            self.odd[i] = self.odd[a] or self.odd[b] or max(self.rank[a], self.rank[b]) >= self.rank[i]
        self.joined = IntMap({number[p[:k]] * (n + 1) + number[p[k:]]: int(self.rank[number[p]]) for p in score for k in range(1, len(p)) if p[:k] in number and p[k:] in number})
        self._automaton(alone, number)
        self.follows = Memo(self._stand_together, MEMO_BITS + 2)
        self.step = Memo(self._step)

    def _automaton(self, alone: list[str], number: dict[str, int]) -> None:
        """States are the prefixes of pieces; fail: the longest proper suffix that is one, ends: the longest piece that a
        state's text ends with, shorter: for a piece, the next shorter piece that its text ends with."""
        self.classes = np.zeros(0x110000, np.int32)
        chars = sorted({c for p in alone for c in p})
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        state = {"": 0}
        for p in sorted(alone, key=len):
            for k in range(1, len(p) + 1):
                state.setdefault(p[:k], len(state))
        self.fail = np.zeros(len(state), np.int32)
        self.ends = np.full(len(state), NONE, np.int32)
        self.shorter = np.full(len(self.pieces) + 1, NONE, np.int32)
        known = set(alone)
        edges = {}
        for text, s in state.items():
            if not text:
                continue
            edges[state[text[:-1]] * self.width + int(self.classes[ord(text[-1])])] = s
            self.fail[s] = next((state[text[k:]] for k in range(1, len(text)) if text[k:] in state), 0)
            tails = [number[text[k:]] for k in range(len(text)) if text[k:] in known]
            self.ends[s] = tails[0]
            if text in known and len(tails) > 1:
                self.shorter[tails[0]] = tails[1]
        self.edges = IntMap(edges)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The state after a character, for keys of state * width + class."""
        state, kind = keys // self.width, keys % self.width
        out = np.zeros(len(keys), np.int32)
        left = np.flatnonzero(kind > 0)
        while len(left):
            to = self.edges.get(state[left] * self.width + kind[left])
            done = (to != NONE) | (state[left] == 0)
            out[left[done]] = np.maximum(to[done], 0)
            left = left[~done]
            state[left] = self.fail[state[left]]
        return out

    def _stand_together(self, keys: np.ndarray) -> np.ndarray:
        """1 where merging the text of both pieces gives both again, for keys of a * (unknown + 1) + b."""
        n = self.unknown + 1
        a, b = keys // n, keys % n
        out = np.ones(len(keys), np.int32)
        plain = (a != self.unknown) & (b != self.unknown)
        odd = plain & (self.odd[a] | self.odd[b])
        for i in np.flatnonzero(odd):
            p, q = self.pieces[a[i]], self.pieces[b[i]]
            out[i] = self.merges.merge(p + q) == [p, q]
        left = np.flatnonzero(plain & ~odd)
        x, y = a[left], b[left]
        before = np.full(len(left), np.iinfo(np.int64).max)  # twice the rank that ends the pair; odd: equal ranks are before it
        while len(left):
            whole = self.joined.get(x * n + y)
            merged = (whole != NONE) & (2 * whole.astype(np.int64) < before)
            out[left[merged]] = 0
            later = self.rank[x] > self.rank[y]  # x came last: undo it, else y
            before = np.where(later, 2 * self.rank[x], 2 * self.rank[y] + 1)
            on = ~merged & (np.maximum(self.rank[x], self.rank[y]) != NONE)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
            left, x, y, before = left[on], x[on], y[on], before[on]
        return out

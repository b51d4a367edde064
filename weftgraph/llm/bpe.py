"""Byte-pair merges as a left-to-right automaton.

A sequence of tokens is what merging gives for its text exactly if every token gives itself and every two neighbours give
themselves; so each prefix of a word has one last token, found among the tokens that end there by testing them against the
last token of the prefix before them. This turns merging into a forward recurrence over prefixes.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence


class Merges:
    """rank(a, b): (priority, merged token) of a pair of tokens, lower first, leftmost of equals; None if they stay apart."""

    def __init__(self, rank: Callable, limit: int = 1 << 18):
        self.rank, self.limit = rank, limit
        self._apart: dict = {}

    def merge(self, symbols: Sequence, log: list | None = None) -> list:
        """The tokens of a sequence of symbols, pair by pair: what all else here must agree with. log: gets the merged pairs."""
        token = list(symbols)
        after = list(range(1, len(token))) + [-1]
        before = list(range(-1, len(token) - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.rank(token[i], token[j])) is not None:
                heapq.heappush(heap, (r[0], i, token[i], token[j], r[1]))

        for i in range(len(token) - 1):
            push(i)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            token[i], token[j], after[i] = whole, None, after[j]
            if log is not None:
                log.append((a, b))
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [t for t in token if t is not None]

    def halves(self, symbols: Sequence) -> tuple | None:
        """The last pair that merging joins, if it gives one token of several symbols."""
        log: list = []
        return log[-1] if len(self.merge(symbols, log)) == 1 and log else None

    def apart(self, a, b, symbols: Callable) -> bool:
        """Whether merging the text of a and b gives a and b again. symbols(token): the symbols it is made of."""
        key = (a, b)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= self.limit:
                self._apart.clear()
            known = self._apart[key] = self.merge([*symbols(a), *symbols(b)]) == [a, b]
        return known

"""An Aho-Corasick automaton over numbers, in a few arrays, that reads many sequences side by side.

A state is a row of the arrays: 8 bytes for the edge that leads to it, and 4 each
for its failure link, its pattern and its next pattern along failure links. States
are numbered level by level, so that edges (state, symbol) are in order and the
state that the k-th edge leads to is ``k + 1``.
"""

from __future__ import annotations

import numpy as np

#: Symbols that one of the sequences read side by side has, besides its overlap with the next.
_PIECE = 256


class Automaton:
    def __init__(self, patterns: np.ndarray, lengths: np.ndarray, symbols: int) -> None:
        """``patterns`` (n, longest): distinct rows of symbols below ``symbols``, of which the first ``lengths`` count."""
        self.symbols, self.longest = max(1, symbols), int(lengths.max(initial=0))
        state, levels, count = np.zeros(len(patterns), np.int64), [], 0
        for depth in range(self.longest):
            live = np.flatnonzero(lengths > depth)
            edges, to = np.unique(state[live] * self.symbols + patterns[live, depth], return_inverse=True)
            state[live] = count + 1 + to
            levels.append((count, edges))
            count += len(edges)
        self.edges = np.concatenate([e for _, e in levels] or [np.zeros(0, np.int64)])
        self.fail, self.pattern, self.suffix = np.zeros(count + 1, np.int32), np.full(count + 1, -1, np.int32), np.zeros(count + 1, np.int32)
        self.pattern[state] = np.arange(len(patterns))
        for depth, (before, edges) in enumerate(levels):
            own = np.arange(before + 1, before + 1 + len(edges))
            if depth:
                self.fail[own] = self.step(self.fail[edges // self.symbols].astype(np.int64), edges % self.symbols)
            at = self.fail[own]
            self.suffix[own] = np.where(self.pattern[at] >= 0, at, self.suffix[at])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one more symbol each."""
        out, todo = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(todo):
            edge = state[todo] * self.symbols + symbol[todo]
            at = np.searchsorted(self.edges, edge)
            at[at == len(self.edges)] = 0
            found = self.edges[at] == edge
            out[todo[found]] = at[found] + 1
            todo = todo[~found & (state[todo] > 0)]
            state[todo] = self.fail[state[todo]]
        return out

    def find(self, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns end (exclusive) in text[first:last] of each sequence, and which; in order of place, then length, each once."""
        overlap = self.longest - 1
        n = np.maximum(1, -(-(last - first - overlap) // _PIECE))
        begin = np.repeat(first, n) + _PIECE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(begin + _PIECE + overlap, np.repeat(last, n))
        order = np.argsort(begin - end, kind="stable")
        begin, size = begin[order], (end - begin)[order]
        state, ends, which = np.zeros(len(begin), np.int64), [], []
        for t in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -t))  # those longer than t
            state = self.step(state[:m], text[begin[:m] + t])
            at = np.flatnonzero((self.pattern[state] >= 0) | (self.suffix[state] > 0))
            s, place = state[at], begin[at] + t + 1
            while len(s):
                hit = self.pattern[s] >= 0
                ends.append(place[hit])
                which.append(self.pattern[s[hit]])
                s, place = self.suffix[s], place[self.suffix[s] > 0]
                s = s[s > 0]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack((np.concatenate(ends), np.concatenate(which).astype(np.int64)), axis=1), axis=0)
        return both[:, 0], both[:, 1]

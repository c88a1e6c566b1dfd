"""A suffix automaton over sequences of integers that grows by whole sequences, and matching statistics against it."""

from __future__ import annotations


class SuffixAutomaton:
    """States by number: longest length, suffix link, transitions. Sequences that are added share one automaton."""

    def __init__(self):
        self.length, self.link, self.next = [0], [-1], [{}]

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        nxt.append(nxt[q].copy())
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matching(self, sequence) -> list[int]:
        """For each position, the length of the longest substring ending there that some added sequence holds."""
        length, link, nxt = self.length, self.link, self.next
        out, state, n = [], 0, 0
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out

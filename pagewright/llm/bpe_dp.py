"""Byte-pair segmentation as dynamic programming over prefixes, in numpy, many equally long words at a time.

Fact used: the encoding of every prefix ends in exactly one piece, and a sequence of pieces is an encoding exactly if
each adjacent pair of its pieces is one (no merge across the seam would have come before a merge inside either piece).
So prefix i ends in the one piece p that fits text[:i] and whose pair with the last piece of prefix i - len(p) is
stable; its count is that prefix's count plus one. Substrings are looked up by a 64-bit polynomial hash among the
sorted hashes of the pieces. Stability is decided by undoing the later merge of the two pieces again and again.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max
#: What is left of a piece's hash when its leading 18 bits are taken.
LEAD = np.uint64(46)
#: Prefixes whose fitting pieces are looked up at a time, over all rows: bounds what is held, however long the words are.
BLOCK = 1 << 18


def word_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes (rows, length + 1) of equally long words, and powers of the base. Arithmetic wraps at 64 bits."""
    rows, n = codes.shape
    h = np.zeros((rows, n + 1), dtype=np.uint64)
    power = np.ones(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h[:, i + 1] = h[:, i] * _BASE + (codes[:, i].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            power[i + 1] = power[i] * _BASE
    return h, power


class Pieces:
    """pieces: symbol tuples. rank[i]: when piece i is made by a merge (None: a single symbol, never merged).
    split[i]: the two pieces that it is last merged from. pairs: {(left, right): rank of that merge}."""

    def __init__(self, pieces: list[tuple[int, ...]], rank: list[int | None], split: list[tuple[int, int] | None], pairs: dict[tuple[int, int], int], usable: np.ndarray):
        self.n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        self.lengths = lengths
        self.longest = int(lengths[usable].max())
        self.made = np.array([-1 if r is None else r for r in rank], dtype=np.int64)
        self.left = np.array([i if s is None else s[0] for i, s in enumerate(split)], dtype=np.int64)
        self.right = np.array([i if s is None else s[1] for i, s in enumerate(split)], dtype=np.int64)
        keys = np.array([a * (1 << 32) + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.array(list(pairs.values()), dtype=np.int64)[order]
        self.asked, self.asked_ok = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)
        self.pair_leads = np.zeros(1 << 20, dtype=bool)
        self.pair_leads[self._lead(self.pair_keys)] = True
        hashes = np.zeros(self.n, dtype=np.uint64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            hashes[at] = word_hashes(np.array([pieces[i] for i in at], dtype=np.int64).reshape(len(at), n))[0][:, n]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # and which leading bits occur, so that most probes need no search
        for n in np.unique(lengths[usable]):
            at = np.flatnonzero((lengths == n) & usable)
            at = at[np.argsort(hashes[at])]
            leads = np.zeros(1 << 18, dtype=bool)
            leads[hashes[at] >> LEAD] = True
            self.by_length[int(n)] = (hashes[at], at, leads)

    @staticmethod
    def _lead(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * _BASE) >> np.uint64(44)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stable, with a table of a million pairs asked for before, each in the place that its hash gives it."""
        key = a.astype(np.int64) * (1 << 32) + b
        slot = self._lead(key)
        ok = self.asked_ok[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            ok[new] = self._stable(a[new], b[new])
            self.asked[slot[new]], self.asked_ok[slot[new]] = key[new], ok[new]
        return ok

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of pieces: does a followed by b stay so? Ids from n on are symbols outside the pieces; they merge with nothing."""
        ok = np.ones(len(a), dtype=bool)
        live = np.flatnonzero((a < self.n) & (b < self.n))
        x, y = a[live].astype(np.int64), b[live].astype(np.int64)
        limit = np.full(len(live), _NONE, dtype=np.int64)
        while len(live):
            key = x * (1 << 32) + y
            merges = self.pair_leads[self._lead(key)]  # most pairs never merge, which a table of leading bits tells
            if some := np.flatnonzero(merges).tolist():
                at = np.minimum(np.searchsorted(self.pair_keys, key[some]), len(self.pair_keys) - 1)
                merges[some] = (self.pair_keys[at] == key[some]) & (self.pair_rank[at] < limit[some])
            ok[live[merges]] = False
            mx, my = self.made[x], self.made[y]
            go = ~merges & ((mx >= 0) | (my >= 0))
            live, x, y, mx, my = live[go], x[go], y[go], mx[go], my[go]
            first = mx > my  # the later merge is undone first; at equal ranks the right one is the later
            limit = np.where(first, mx, my + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def prefixes(self, codes: np.ndarray, unknown: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For equally long words (rows of symbols): the last piece and the piece count of each prefix, from 1 on.

        unknown: ids to give to single symbols that no piece stands for (n and more), None if there are none such."""
        rows, n = codes.shape
        h, power = word_hashes(codes)
        h = np.ascontiguousarray(h.T)  # position by position, as the words advance
        last = np.full((n + 1, rows), -1, dtype=np.int64)
        count = np.zeros((n + 1, rows), dtype=np.int32)
        block = max(1, BLOCK // max(rows, 1))
        for start in range(1, n + 1, block):
            stop = min(start + block, n + 1)
            fits = self._fitting(h, power, start, stop)
            for i in range(start, stop):
                here, so_far = last[i], count[i]
                for k, bounds, at, pieces in fits:  # longest first; each prefix has one last piece, so a found row is done
                    a, b = bounds[i - start], bounds[i - start + 1]
                    if a == b:
                        continue
                    todo = here[at[a:b]] < 0
                    row, piece = at[a:b][todo], pieces[a:b][todo]
                    if i > k:
                        before = last[i - k][row]
                        good = before >= 0
                        good[good] = self.stable(before[good], piece[good])
                        row, piece = row[good], piece[good]
                    here[row] = piece
                    so_far[row] = count[i - k][row] + 1
                if unknown is not None:
                    miss = np.flatnonzero((here < 0) & (unknown[:, i - 1] >= 0))
                    here[miss] = unknown[miss, i - 1]
                    so_far[miss] = count[i - 1][miss] + 1
        return last.T, count.T

    def _fitting(self, h: np.ndarray, power: np.ndarray, start: int, stop: int) -> list[tuple[int, list[int], np.ndarray, np.ndarray]]:
        """Which pieces end where, at positions from start to stop: for each length, the longest first, (length, where each position's begin, rows, pieces)."""
        out = []
        for k in sorted(self.by_length, reverse=True):
            first = max(start, k)
            if first >= stop:
                continue
            hashes, ids, leads = self.by_length[k]
            with np.errstate(over="ignore"):
                probe = (h[first:stop] - h[first - k : stop - k] * power[k]).ravel()
            hit = np.flatnonzero(leads[probe >> LEAD])
            probe = probe[hit]
            at = np.minimum(np.searchsorted(hashes, probe), len(hashes) - 1)
            found = hashes[at] == probe
            if found.any():
                place, row = np.divmod(hit[found], h.shape[1])
                bounds = np.searchsorted(place + first, np.arange(start, stop + 1)).tolist()
                out.append((k, bounds, row, ids[at[found]]))
        return out

    def walk(self, last: np.ndarray, row: int) -> list[int]:
        """The pieces of one word, by its backpointers."""
        out, i = [], last.shape[1] - 1
        while i > 0:
            p = int(last[row, i])
            out.append(p)
            i -= int(self.lengths[p]) if p < self.n else 1
        return out[::-1]


def same_length(words: list) -> dict[int, list[int]]:
    """Positions of the words by length, for batches that advance together."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    return by


def merged(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[int], tuple[int, int] | None]:
    """Plain merging, lowest rank first and leftmost among equals; pairs gives (rank, piece). Also the last pair merged. For short inputs."""
    s, last = list(symbols), None
    while len(s) > 1:
        best = min(((pairs[p][0], i) for i in range(len(s) - 1) if (p := (s[i], s[i + 1])) in pairs), default=None)
        if best is None:
            break
        i = best[1]
        last = (s[i], s[i + 1])
        s[i : i + 2] = [pairs[last][1]]
    return s, last

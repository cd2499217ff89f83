"""The interval that serves a query interval best, among many at once."""

from __future__ import annotations

import numpy as np

_FAR = np.int64(1) << 62


class Intervals:
    """Held intervals ``first`` to ``last`` with an ``ord`` each, and for queries the
    one of greatest overlap; of equal ones one that holds the query's start, then that
    of the nearest start, of the nearest start or end, of the least ``ord``.

    A query takes time in proportion to the square of the logarithm of the number
    held, however many of them overlap it: searches go through tables of the greatest
    ends of 2, 4, 8... neighbours, and through lists of such blocks sorted by end.
    """

    def __init__(self, first: np.ndarray, last: np.ndarray, ords: np.ndarray) -> None:
        by = np.lexsort((ords, last, first))
        self.a, self.z, self.ord = first[by], last[by], ords[by]
        n = self.n = len(by)
        self.ends, rank = np.unique(self.z, return_inverse=True)
        rank = rank.astype(np.int32)
        self.starts, self.group = np.unique(self.a, return_inverse=True)
        self.opens = np.searchsorted(self.a, self.starts)  # first of each group of one start
        self.closes = np.append(self.opens[1:], n)
        self.span = len(self.ends) + 1
        self.place = self.group.astype(np.int64) * self.span + rank
        self.alike = np.searchsorted(self.place, self.place)  # first of equal start and end
        self.least = np.arange(n)  # from each on, the one of least ord in its group
        for k in range(n - 2, -1, -1):
            if self.group[k] == self.group[k + 1] and self.ord[self.least[k + 1]] < self.ord[k]:
                self.least[k] = self.least[k + 1]
        self.reach = np.maximum.accumulate(self.z) if n else self.z
        # greatest ends of 2 ** k neighbours, backward and forward
        self.back, self.ahead = [rank], [rank]
        while (1 << len(self.back)) <= n:
            step = 1 << (len(self.back) - 1)
            back, ahead = self.back[-1].copy(), self.ahead[-1].copy()
            back[step:] = np.maximum(back[step:], self.back[-1][:-step])
            ahead[:-step] = np.maximum(ahead[:-step], self.ahead[-1][step:])
            self.back.append(back)
            self.ahead.append(ahead)
        # longer is better, of equal ones the earlier; blocks of 2 ** k by end
        self.by_length = np.lexsort((-np.arange(n), self.z - self.a))
        worth = np.empty(n, np.int32)
        worth[self.by_length] = np.arange(n, dtype=np.int32)
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(n.bit_length() + 1):  # the last block holds all
            block = np.arange(n, dtype=np.int64) >> k
            key = block * self.span + rank
            order = np.argsort(key, kind="stable")
            best = worth[order]
            for step in (1 << j for j in range(k)):  # running greatest inside each block
                same = block[step:] == block[:-step]
                best[step:] = np.maximum(best[step:], np.where(same, best[:-step], -1))
            self.blocks.append((key[order], best))

    def _rank(self, end: np.ndarray) -> np.ndarray:
        """How many kinds of ends lie before; an end is as late if its rank is no less."""
        return np.searchsorted(self.ends, end)

    def _before(self, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The last place up to ``at`` of an end not before; below 0 without one."""
        at = at.copy()
        for k in range(len(self.back) - 1, -1, -1):
            skip = (at >= 0) & (self.back[k][np.maximum(at, 0)] < rank)
            at -= skip.astype(np.int64) << k
        return at

    def _after(self, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on of an end not before; ``n`` or more without."""
        at = at.copy()
        for k in range(len(self.ahead) - 1, -1, -1):
            skip = (at < self.n) & (self.ahead[k][np.minimum(at, self.n - 1)] < rank)
            at += skip.astype(np.int64) << k
        return at

    def _longest(self, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """From ``at`` on, the longest of those that end before; -1 without one."""
        at, best = at.copy(), np.full(len(at), -1, np.int64)
        for k, (key, worth) in enumerate(self.blocks):
            use = np.flatnonzero((at < self.n) & ((at >> k) & 1 == 1))
            block = at[use] >> k
            seen = np.searchsorted(key, block * self.span + rank[use]) - 1
            some = seen >= (block << k)
            best[use[some]] = np.maximum(best[use[some]], worth[seen[some]])
            at[use] += 1 << k
        zero = np.flatnonzero(at == 0)
        if len(zero):
            key, worth = self.blocks[-1]
            seen = np.searchsorted(key, rank[zero]) - 1
            best[zero[seen >= 0]] = np.maximum(best[zero[seen >= 0]], worth[seen[seen >= 0]])
        return np.where(best >= 0, self.by_length[best], -1)

    def _nearest(self, group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a group of one start that of the nearest start or end, and how near."""
        low, high, away = self.opens[group], self.closes[group], np.abs(self.starts[group] - start)
        at = np.searchsorted(self.place, group.astype(np.int64) * self.span + self._rank(start))
        up = np.where(at < high, self.z[np.minimum(at, self.n - 1)] - start, _FAR)
        down = np.where(at > low, start - self.z[np.maximum(at - 1, 0)], _FAR)
        above, below = np.minimum(at, self.n - 1), self.alike[np.maximum(at - 1, 0)]
        chosen = np.where((up < down) | ((up == down) & (self.ord[above] < self.ord[below])), above, below)
        near = np.minimum(up, down)
        return np.where(near >= away, self.least[low], chosen), np.minimum(near, away)

    def choose(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the best ones, overlap); of ``n`` = 0 there is none to choose."""
        n, count = self.n, len(start)
        at = np.searchsorted(self.a, start, side="right") - 1  # the last not begun later
        late = self._rank(end)
        own = np.where(at >= 0, np.minimum(end, self.reach[np.maximum(at, 0)]) - start, -1)
        over = self._after(at + 1, late)  # begins inside, ends no earlier
        inside = np.minimum(over, n - 1)
        most, other = np.where(over < n, end - self.a[inside], -1), self.least[inside]
        held = self._longest(at + 1, late)  # begins and ends inside
        length = np.where(held >= 0, self.z[held] - self.a[held], -1)
        better = (length > most) | ((length == most) & (self.a[held] < self.a[inside]))
        most, other = np.where(better, length, most), np.where(better, held, other)

        overlap = np.maximum(np.maximum(own, most), 0)
        place = other.copy()
        ask = np.flatnonzero((own >= most) | (overlap == 0))  # those that hold the start
        until = self._rank(start[ask] + overlap[ask])
        found = self._before(at[ask], until)
        some, none = found >= 0, ask[found < 0]
        ask, found, until = ask[some], found[some], until[some]
        group = self.group[found].astype(np.int64)
        head = np.searchsorted(self.place, group * self.span + until)
        place[ask] = np.where(self.z[head] - start[ask] < start[ask] - self.a[head], head, self.least[head])

        if len(none):  # no overlap, and none holds the start
            left, right, s = at[none], at[none] + 1, start[none]
            d_left = np.where(left >= 0, s - self.a[np.maximum(left, 0)], _FAR)
            d_right = np.where(right < n, self.a[np.minimum(right, n - 1)] - s, _FAR)
            one, near_one = self._nearest(self.group[np.maximum(left, 0)], s)
            two, near_two = self._nearest(self.group[np.minimum(right, n - 1)], s)
            tied = d_left == d_right
            first = (d_left < d_right) | (tied & ((near_one < near_two) | ((near_one == near_two) & (self.ord[one] < self.ord[two]))))
            place[none] = np.where(first, one, two)
        return place, overlap

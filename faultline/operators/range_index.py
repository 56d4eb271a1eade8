"""Statistics of many ranges of one array at once: each step is one array operation over all ranges, none visits the points of a range."""

from __future__ import annotations

import numpy as np


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean, squared deviations, least and greatest of two sets of values together; equal values stay without deviation."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros(len(n)), where=n > 0)
    apart = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + apart * share, b[1])
    return n, mean, a[2] + b[2] + apart * apart * a[0] * share, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])


class RangeIndex:
    """``values``: finite numbers in order of time. Ranges are first <= n < after."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.sorted = np.sort(values)
        node = (np.ones(len(values)), values, np.zeros(len(values)), values, values)
        self.nodes = [node]
        while len(node[0]) > 1:
            even = tuple(x[: len(node[0]) // 2 * 2] for x in node)  # a last odd node is read on its own level
            node = _joined(tuple(x[::2] for x in even), tuple(x[1::2] for x in even))
            self.nodes.append(node)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(values, kind="stable")] = np.arange(len(values))
        self.bits = []
        for bit in range(max(0, len(values) - 1).bit_length() - 1, -1, -1):
            high = (rank >> bit & 1).astype(bool)
            below = np.concatenate([[0], np.cumsum(~high)])
            self.bits.append((bit, below))
            rank = np.concatenate([rank[~high], rank[high]])

    def moments(self, first: np.ndarray, after: np.ndarray) -> tuple:
        """(n, mean, squared deviations, min, max) of each range."""
        low, high = first.copy(), after.copy()
        empty = lambda: [np.zeros(len(low)), np.zeros(len(low)), np.zeros(len(low)), np.full(len(low), np.inf), np.full(len(low), -np.inf)]
        left, right = empty(), empty()
        for node in self.nodes:
            for side, taken in ((left, (low < high) & (low & 1 == 1)), (right, (low < high) & (high & 1 == 1))):
                at = np.flatnonzero(taken & (low < high))
                if not len(at):
                    continue
                where = low[at] if side is left else high[at] - 1
                mine, other = tuple(s[at] for s in side), tuple(x[where] for x in node)
                for s, x in zip(side, _joined(mine, other) if side is left else _joined(other, mine)):
                    s[at] = x
                if side is left:
                    low[at] += 1
                else:
                    high[at] -= 1
            low, high = low >> 1, high >> 1
        return _joined(tuple(left), tuple(right))

    def smallest(self, first: np.ndarray, after: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with k smaller ones before it in each range, by the bits of its rank."""
        rank = np.zeros(len(first), np.int64)
        for bit, below in self.bits:
            low, high, ones = below[first], below[after], below[-1]
            right = k >= high - low
            rank |= right.astype(np.int64) << bit
            k = np.where(right, k - (high - low), k)
            first, after = np.where(right, ones + first - low, low), np.where(right, ones + after - high, high)
        return self.sorted[rank]

    def median(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        n = after - first
        return (self.smallest(first, after, (n - 1) // 2) + self.smallest(first, after, n // 2)) / 2

    def _distance(self, first: np.ndarray, after: np.ndarray, middle: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The distance to ``middle`` with k smaller ones in its range: the distances of the lower and of the upper half rise away from it."""
        half = (after - first) // 2
        below = lambda i: np.where(i < 0, -np.inf, np.where(i >= half, np.inf, np.abs(self.smallest(first, after, np.clip(half - 1 - i, 0, after - first - 1)) - middle)))
        above = lambda j: np.where(j < 0, -np.inf, np.where(j >= after - first - half, np.inf, np.abs(self.smallest(first, after, np.clip(half + j, 0, after - first - 1)) - middle)))
        low, high = np.maximum(0, k + 1 - (after - first - half)), np.minimum(k + 1, half)
        while (low < high).any():
            at = (low + high) // 2
            enough = above(k - at) <= below(at)
            low, high = np.where(enough | (low >= high), low, at + 1), np.where(enough & (low < high), at, high)
        return np.maximum(below(low - 1), above(k - low))

    def mad(self, first: np.ndarray, after: np.ndarray, middle: np.ndarray) -> np.ndarray:
        n = after - first
        return (self._distance(first, after, middle, (n - 1) // 2) + self._distance(first, after, middle, n // 2)) / 2

    @staticmethod
    def greatest(values: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The greatest value of each range (NaN is the greatest) from the maxima of 1, 2, 4 ... values in a row."""
        out, runs = np.full(len(first), -np.inf), values
        n = after - first
        for level in range(int(n.max(initial=0)).bit_length()):
            at = np.flatnonzero((n >> level) == 1)
            out[at] = np.maximum(runs[first[at]], runs[after[at] - (1 << level)])
            runs = np.maximum(runs[: max(0, len(runs) - (1 << level))], runs[1 << level :])
        return out

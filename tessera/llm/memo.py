"""Ids of byte spans, remembered by the hash of their bytes, so that each distinct span is encoded once a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Spans a worker remembers; beyond it, it starts anew.
LIMIT = 1_500_000


class SpanMemo:
    """Maps 64-bit span hashes to runs of ids.

    encode_new takes bytes, starts and ends of spans and returns their ids one after another and how many each has.
    """

    def __init__(self, encode_new: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.encode_new = encode_new
        self._clear()

    def _clear(self):
        # sorted keys and the places of their spans: what is older, and what came since; the latter joins the former as it grows to an eighth of it
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def _remember(self, keys: np.ndarray, place: np.ndarray):
        old, young = self.runs
        young = self._joined(young, (keys, place))
        self.runs = [self._joined(old, young), (young[0][:0], young[1][:0])] if 8 * len(young[0]) > len(old[0]) else [old, young]

    @staticmethod
    def _joined(a, b):
        where = np.searchsorted(a[0], b[0])
        return np.insert(a[0], where, b[0]), np.insert(a[1], where, b[1])

    def encode(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(ids of all spans one after another, number of ids of each span); span k is data[start[k]:end[k]] with hash h[k]."""
        if sum(len(k) for k, _ in self.runs) > LIMIT:
            self._clear()
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.full(len(uniq), -1, np.int64)
        for keys, place in self.runs:
            if len(keys):
                inside = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
                known = keys[inside] == uniq
                at[known] = place[inside[known]]
        new = np.flatnonzero(at < 0)
        if len(new):
            rows = first[new]
            flat, size = self.encode_new(data, start[rows], end[rows])
            n, total = sum(len(k) for k, _ in self.runs), len(flat)
            self.start, self.size = self._grown(self.start, n + len(new)), self._grown(self.size, n + len(new))
            self.flat = self._grown(self.flat, self.used + total)
            self.flat[self.used : self.used + total] = flat
            self.size[n : n + len(new)] = size
            self.start[n : n + len(new)] = self.used + np.cumsum(size) - size
            self.used += total
            at[new] = np.arange(n, n + len(new))
            self._remember(uniq[new], at[new].astype(np.int32))
        idx = at[back]
        size = self.size[idx]
        out = np.repeat(self.start[idx] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.flat[out], size


def spread(texts_ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Id sequences as one array and their lengths."""
    size = np.array([len(x) for x in texts_ids], np.int64)
    return np.fromiter((y for x in texts_ids for y in x), np.int32, int(size.sum())), size

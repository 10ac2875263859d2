"""Vectorised text kernels in numpy: words, word hashes and distinct word n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, U)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if len(have) <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of (byte + 1) * P**k over k in i..j-1, modulo 2**64."""
    s = np.zeros(len(data) + 1, U)
    x = data.astype(U)
    x += U(1)
    x *= _powers(P, len(data))
    np.cumsum(x, out=s[1:])
    return s


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << 5)


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, equal for equal bytes wherever they stand."""
    inv = _powers(P_INV, len(s))
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def gram_hashes(s: np.ndarray, begin: int, end: int, n: int) -> np.ndarray:
    """span_hash() of all spans of n bytes that start at begin..end."""
    inv = _powers(P_INV, len(s))
    return mix((s[begin + n : end + n] - s[begin:end]) * inv[begin:end] + U(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def solid(data: np.ndarray) -> np.ndarray:
    """Which bytes aren't in [\\x20\\x09-\\x0D]."""
    return (data != 32) & ((data - np.uint8(9)) > 4)


def words(data: np.ndarray, offs: np.ndarray):
    """Start, end and segment of every word (run without [\\x20\\x09-\\x0D]) of the segments offs[i]..offs[i+1]."""
    inside = solid(data)
    first, last = inside.copy(), inside.copy()
    np.greater(inside[1:], inside[:-1], out=first[1:])
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    b = offs[:-1][offs[:-1] < len(data)]
    first[b] = inside[b]
    e = offs[1:][offs[1:] > 0] - 1
    last[e] = inside[e]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    count = np.diff(np.searchsorted(start, offs))
    return start, end, np.repeat(np.arange(len(offs) - 1), count), count


def word_hashes(data: np.ndarray, offs: np.ndarray):
    """Hash of every word with A-Z lower-cased, its segment and the words of each segment."""
    start, end, seg, count = words(data, offs)
    return span_hash(prefix_hash(lower(data)), start, end), seg, count


def ngram_sets(data: np.ndarray, offs: np.ndarray, n: int):
    """Distinct word n-grams: (hash, segment) sorted by segment and hash, and the set size of each segment.

    A segment of 1 to n-1 words has its whole sequence as the one n-gram; one without words has none.
    """
    h, seg, count = word_hashes(data, offs)
    q, total = U(0xC2B2AE3D27D4EB4F), len(h)
    m = max(0, total - n + 1)
    g = np.zeros(m, U)
    for k in range(n):
        g = g * q + h[k : k + m]
    ok = seg[:m] == seg[n - 1 :] if m else np.zeros(0, bool)
    g, s = mix(g[ok]), seg[:m][ok]
    begin = np.cumsum(count) - count
    short = [(k, rows) for k in range(1, n) if len(rows := np.flatnonzero(count == k))]
    if short:
        for k, rows in short:
            x = np.zeros(len(rows), U)
            for i in range(k):
                x = x * q + h[begin[rows] + i]
            g, s = np.concatenate([g, mix(x ^ U(k * 0xA0761D6478BD642F & (1 << 64) - 1))]), np.concatenate([s, rows])
        order = np.argsort(s, kind="stable")
        g, s = g[order], s[order]
    at = np.searchsorted(s, np.arange(len(offs)))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i > 1:
            g[i:j].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
    g, s = g[keep], s[keep]
    return g, s, np.bincount(s, minlength=len(offs) - 1)


def set_keys(g: np.ndarray, size: np.ndarray):
    """A 64-bit key of each set, equal for equal sets (0 for empty ones)."""
    out = np.zeros(len(size), U)
    full = np.flatnonzero(size)
    if len(full):
        at = (np.cumsum(size) - size)[full]
        out[full] = mix(np.add.reduceat(g, at) + size[full].astype(U) * U(0x5851F42D4C957F2D))
    return out


def lines(data: np.ndarray, offs: np.ndarray):
    """Offsets of all lines (each with its ending \\n), the document of each line and the lines of each document.

    A document of k \\n has k+1 lines, the last of which may be empty.
    """
    nl = np.flatnonzero(data == 10) + 1
    ends = np.sort(np.concatenate([nl, offs[1:]]), kind="stable")
    per = np.diff(np.searchsorted(nl, offs, "right")) + 1
    return np.concatenate([[0], ends]), np.repeat(np.arange(len(offs) - 1), per), per

"""Plain single-machine versions of the operators, to hold results against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile("[\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w.translate(LOWER) for w in SPACE.split(text or "") if w]


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept = kept or i == keep
    return out


def classes(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(x)] = find(y)
    low = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        low[find(x)].append(i)
    pick = lambda x: min((j for j in low[find(x)] if j is not None), default=None)
    return [(i, len(s), pick(x)) for x, (i, s) in enumerate(sets)]


def lines(rows, n=5, num=80, den=100):
    """For rows of distinct, non-null ids: id -> what stays."""
    earlier, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            s = shingles(line, n)
            if not (s and any(den * len(s & e) >= num * len(s | e) for e in earlier)):
                kept.append(line)
            if s:
                earlier.append(s)
        out[i] = "\n".join(kept)
    return out


def repeats(rows, width=100):
    """For rows of distinct ids: id -> (bytes, removed, runs, digest of the rest)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            x = b[s : s + width]
            if x in seen:
                gone[s : s + width] = [True] * width
            seen.add(x)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def leaks(docs, items, n=5, num=80, den=100):
    def sh(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    d, it = defaultdict(set), defaultdict(set)
    for i, t in docs:
        d[i] |= sh(t)
    for i, t in items:
        it[i] |= sh(t)
    return [(i, j, len(b), len(a & b)) for i, a in d.items() for j, b in it.items() if b and den * len(a & b) >= num * len(b)]


def held_out(i, m):
    return i is not None and zlib.crc32(str(i).encode()) % m == 2


def unigram(rows):
    """id -> (tokens, known, base score), and the number of training tokens."""
    tok = lambda t: [*words(t), None]
    c = Counter(w for i, t in rows if not held_out(i, 7) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tok(t)), sum(c[w] > 0 for w in tok(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) for i, t in rows}, n

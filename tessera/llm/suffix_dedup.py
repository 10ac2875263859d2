"""Suffix-array dedup: bytes covered by a string of 100 bytes that starts earlier in the corpus are removed.

Where two texts share 100 bytes, both choose the same anchor in them: the least-hashed 32-gram of its 69. So all that
shares 100 bytes meets under an anchor, and whole corpora never need one suffix array. Only anchors that occur at
least twice go on (a bitmap that grows with their number up to a bound; chance bits add rows, no more). Of an anchor's occurrences with equal
surroundings, all but the first lie in repeats as a whole. The first ones, with different surroundings, are split by
where a window of 100 bytes can lie around the anchor, in PARTS parts whose windows share a core: parts with equal
bytes again repeat as a whole, and only parts with one core and different bytes remain. These are sorted by suffix
arrays, built by linear grouping, in which equal windows are neighbours. Groups of one core beyond HOT parts are cut
into their windows instead and grouped by DataFrame operations, so no group of any size enters one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel
from .kernel import U, mix

GRAM = 32
#: Bits of a bitmap, by the number of its members: about 16 for each, no fewer or more than these powers of two.
BITS = 20, 28
PARTS = 4
HOT = 1000
#: Symbols that one suffix array takes, or a few more: groups of one core stay together.
BLOCK = 60_000
#: Window starts handled at once; arrays of so many stay in a core's cache.
_STEP = 1 << 15
_LOW = U((1 << 20) - 1)


# --- linear grouping -------------------------------------------------------------------------------------------------


def suffix_array(text) -> list[int]:
    """Suffix array of a sequence of non-negative ints, by linear grouping.

    First, suffixes are grouped by their Lyndon prefixes: groups are visited from the largest to the smallest, each
    suffix s finds the nearest one before it in a smaller group, and those found move behind the rest of their group,
    the further the more suffixes of the visited group follow them. Then each group's order is read off from left to
    right: the suffix before a placed one, and on along the previous-smaller pointers, takes its group's next place.
    """
    t = [int(c) + 1 for c in text] + [0]
    n = len(t)
    order = sorted(range(n), key=t.__getitem__)
    place = [0] * n  # of each suffix in order
    group = [0] * n  # start of each suffix's group in order
    size = [0] * n  # of the group that starts there
    start = 0
    for i, s in enumerate(order):
        if i and t[s] != t[order[i - 1]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    prev = [-1] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = sorted(order[g:end])
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by: dict[int, list[int]] = {}
        for p, k in times.items():
            by.setdefault(k, []).append(p)
        for k in sorted(by, reverse=True):
            grown: dict[int, int] = {}
            for p in by[k]:
                old = group[p]
                to = old + size[old] - 1
                q = order[to]
                i = place[p]
                order[i], order[to], place[q], place[p] = q, p, i, to
                size[old] -= 1
                grown[old] = to
                group[p] = -1 - old
            for old, to in grown.items():
                for i in range(to, n):
                    p = order[i]
                    if group[p] != -1 - old:
                        break
                    group[p] = to
                    size[to] += 1
        end = g
    out = [-1] * n
    free = list(range(n))
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = prev[s]
    return out[1:]


# --- anchors ---------------------------------------------------------------------------------------------------------


def _anchors(data: np.ndarray, offs: np.ndarray, width: int):
    """All anchors of texts of at least width bytes: prefix hashes, positions, 32-gram hashes, texts, and the first
    and last start of the windows that have chosen each."""
    s = kernel.prefix_hash(data)
    n, reach = len(data), width - GRAM + 1
    end = np.repeat(offs[1:], np.diff(offs))
    found, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in range(0, max(0, n - width + 1), _STEP):
        e = min(n - GRAM + 1, b + _STEP + reach - 1)
        k = (kernel.gram_hashes(s, b, e, GRAM) & ~_LOW) | np.arange(e - b, dtype=U)
        k[np.arange(b + GRAM, e + GRAM) > end[b:e]] = ~U(0)
        span = 1
        while span * 2 <= reach:
            k = np.minimum(k[: len(k) - span], k[span:])
            span *= 2
        if span < reach:
            k = np.minimum(k[: len(k) - (reach - span)], k[reach - span :])
        at = np.arange(b, b + len(k))
        ok = at + width <= end[at]
        found.append((k[ok] & _LOW).astype(np.int64) + b)
        starts.append(at[ok])
    at, start = np.concatenate(found), np.concatenate(starts)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    first, last = start[new], start[np.r_[new[1:] - 1, len(at) - 1]] if len(at) else start
    at = at[new]
    doc = np.searchsorted(offs, at, "right") - 1
    return s, at, kernel.span_hash(s, at, at + GRAM), doc, first, last


def _bitmap(df: DataFrame, col: str) -> tuple[np.ndarray, int]:
    """A bitmap of df's rows, a table, and its bits."""
    bits = min(BITS[1], max(BITS[0], 4 + int(df.count()).bit_length()))
    return common.bitmap(df, col, bits), bits


def _place_key(h: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Hash of something at a place, as _place_column() has it."""
    return h ^ (ids.astype(np.int64).view(U) << U(20)) ^ pos.astype(np.int64).view(U)


def _place_column(h: str, doc: str, pos: str):
    return F.col(h).bitwiseXOR(F.shiftleft(F.coalesce(F.col(doc), F.lit(0).cast("long")), 20)).bitwiseXOR(F.col(pos))


def _part(q: int, reach: int) -> tuple[int, int]:
    """Least and largest distance of a window's start before its anchor, in part q."""
    step = reach // PARTS
    return q * step, (q + 1) * step - 1 if q < PARTS - 1 else reach - 1


def _salt(x: int) -> np.uint64:
    return U((x + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _spans(s, offs, at, doc, lo_d, hi_d, width):
    """Bytes around anchors in which windows at distances lo_d..hi_d lie: start, end, kept inside the text."""
    return np.maximum(offs[doc], at - hi_d), np.minimum(offs[doc + 1], at - lo_d + width)


def _i64(x):
    return x.astype(np.uint64).view(np.int64)


def _chunks(batches):
    for b in batches:
        for i, _, data, offs in common.chunks(b, "text"):
            yield b, i, data, offs


def _anchor_hashes(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for _, _, data, offs in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_i64(_anchors(data, offs, width)[2]))], ["a"])

    return docs.select("doc_id", "text").mapInArrow(run, "a long")


def _surroundings(docs: DataFrame, width: int, repeated: tuple[np.ndarray, int]) -> DataFrame:
    """(a, c, doc_id, pos) of the anchors in the bitmap: c hashes the bytes around one. c is null where the same task has
    met the same surroundings at an earlier place; such a place needs no further look."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches):
        for b in batches:
            got = []
            ids = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for i, _, data, offs in common.chunks(b, "text"):
                s, at, a, doc, _, _ = _anchors(data, offs, width)
                ok = common.in_bitmap(shared.value[0], a, shared.value[1])
                at, a, doc = at[ok], a[ok], doc[ok]
                lo, hi = _spans(s, offs, at, doc, 0, width - GRAM, width)
                c = mix(kernel.span_hash(s, lo, hi) + (at - lo).astype(U) * _salt(7))
                got.append((_i64(a), _i64(c), ids[doc + i], at - offs[doc]))
            if not got:
                continue
            a, c, doc, pos = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((pos, doc, c, a))
            a, c, doc, pos = a[order], c[order], doc[order], pos[order]
            again = np.zeros(len(a), bool)
            again[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            # rows at the very place of the first (they share a doc_id) aren't later ones
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(a)))) if len(a) else again
            again &= (doc != doc[head]) | (pos != pos[head])
            cols = [pa.array(a, mask=again), pa.array(c, mask=again), pa.array(doc, mask=doc == -(1 << 63)), pa.array(pos)]
            yield pa.RecordBatch.from_arrays(cols, ["a", "c", "doc_id", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "a long, c long, doc_id long, pos long")


def _told(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, p) from (a, c, doc_id, pos): places whose surroundings stand earlier too (p null), and the first places of
    surroundings whose anchor has several (p: hash of c and the place). Memory doesn't grow with a group."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        # of the run that goes on: anchor, surroundings, the place of their first row; the anchor's one first row not yet given out
        last, waiting = None, None
        for b in batches:
            a, c, pos = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            doc = b.column(2).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            n = len(a)
            if not n:
                continue
            new_c = np.ones(n, bool)
            new_c[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            new_a = np.ones(n, bool)
            new_a[1:] = a[1:] != a[:-1]
            if last is not None:
                new_a[0] = a[0] != last[0]
                new_c[0] = new_a[0] or c[0] != last[1]
            head = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            hd = np.where(head >= 0, doc[head], last[2] if last else 0)
            hp = np.where(head >= 0, pos[head], last[3] if last else 0)
            later = ~new_c & ((doc != hd) | (pos != hp))
            # firsts of anchors with several: those that follow another first of their anchor, and the one they follow
            first = np.flatnonzero(new_c)
            second = first[~new_a[first]]
            before = first[np.searchsorted(first, second) - 1]
            mine = np.searchsorted(first, second) > 0
            give = np.zeros(n, bool)
            give[second] = True
            give[before[mine]] = True
            out = [(doc[later], pos[later], None), (doc[give], pos[give], c[give])]
            if len(second) and not mine[0] and waiting is not None:
                out.append(tuple(np.array([x]) for x in waiting))
            if len(first):
                k = first[-1]
                waiting = None if give[k] else (doc[k], pos[k], c[k])
                last = (a[-1], c[-1], doc[k], pos[k])
            elif last is not None and len(second):
                waiting = None
            for d, x, h in out:
                if len(d):
                    none = d == -(1 << 63)
                    key = np.zeros(len(d), U) if h is None else _place_key(h.view(U), np.where(none, 0, d), x)
                    yield pa.RecordBatch.from_arrays([pa.array(d, mask=none), pa.array(x), pa.array(_i64(key), mask=np.full(len(d), h is None))], ["doc_id", "pos", "p"])

    dealt = rows.where("c is not null").repartition(parts, "a").sortWithinPartitions("a", "c", F.col("doc_id").asc_nulls_first(), "pos")
    return dealt.mapInArrow(run, "doc_id long, pos long, p long")


def _parts(docs: DataFrame, width: int, wanted: tuple[np.ndarray, int], by: str) -> DataFrame:
    """(s, k, q, doc_id, pos, lo, hi, [left, right]) of parts that hold a window of their anchor's: s hashes the bytes lo..hi, k the core.

    wanted is a bitmap of places: surroundings (by = 'c') or parts (by = 's'). For parts the bytes before and behind the
    core come too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    reach = width - GRAM + 1
    names = ["s", "k", "q", "doc_id", "pos", "lo", "hi"] + ["left", "right"] * (by == "s")

    def run(batches):
        for b, i, data, offs in _chunks(batches):
            s, at, a, doc, first, last = _anchors(data, offs, width)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            if by == "c":
                lo, hi = _spans(s, offs, at, doc, 0, width - GRAM, width)
                c = mix(kernel.span_hash(s, lo, hi) + (at - lo).astype(U) * _salt(7))
                ok = common.in_bitmap(shared.value[0], _place_key(c, ids[doc + i], at - offs[doc]), shared.value[1])
                at, doc, first, last = at[ok], doc[ok], first[ok], last[ok]
            for q in range(PARTS):
                d0, d1 = _part(q, reach)
                # the core lies in every window of the part, and one window at least has chosen the anchor
                ok = (at - d0 >= offs[doc]) & (at - d1 + width <= offs[doc + 1]) & (first <= at - d0) & (last >= at - d1)
                x, dx = at[ok], doc[ok]
                lo, hi = _spans(s, offs, x, dx, d0, d1, width)
                h = mix(kernel.span_hash(s, lo, hi) + (x - lo).astype(U) * _salt(11 + q))
                k = mix(kernel.span_hash(s, x - d0, x - d1 + width) + _salt(31 + q))
                if by == "s":
                    ok = common.in_bitmap(shared.value[0], _place_key(h, ids[dx + i], x - offs[dx]), shared.value[1])
                    x, dx, lo, hi, h, k = x[ok], dx[ok], lo[ok], hi[ok], h[ok], k[ok]
                base = offs[dx]
                cols = [pa.array(_i64(h)), pa.array(_i64(k)), pa.array(np.full(len(x), q, np.int32)), b.column(0).take(pa.array(dx + i))]
                cols += [pa.array(y - base) for y in (x, lo, hi)]
                if by == "s":
                    cols.append(pa.array([data[u:v].tobytes() for u, v in zip(lo.tolist(), (x - d0).tolist())], pa.binary()))
                    cols.append(pa.array([data[u:v].tobytes() for u, v in zip((x - d1 + width).tolist(), hi.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "s long, k long, q int, doc_id long, pos long, lo long, hi long" + ", left binary, right binary" * (by == "s")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sorted_windows(rows: list[tuple], width: int) -> list[tuple[int, int, int]]:
    """(row, lo, hi) of the runs of rows' bytes that lie in windows which an earlier place has too.

    rows: core, part, doc_id, lo, bytes before and behind the core, in order of cores. A core stands in the text that is
    sorted as one symbol of its own, so a window of part q always has as many symbols as its part has starts, and one.
    """
    reach = width - GRAM + 1
    text, owner, start, core, skew, need = [], [], [], 256, [], []
    for r, (k, q, _, _, left, right) in enumerate(rows):
        d0, d1 = _part(q, reach)
        core += r == 0 or k != rows[r - 1][0]
        text += [c + 1 for c in left]
        text.append(core + 1)
        text += [c + 1 for c in right]
        text.append(0)
        skew.append(d1 - d0 - len(left))
        need.append(d1 - d0 + 1)
        owner.append(np.full(len(left) + len(right) + 2, r))
        start.append(np.arange(len(left) + len(right) + 2))
    x = np.array(text)
    owner, start = np.concatenate(owner), np.concatenate(start)
    nl, nr, skew, need = np.array([len(r[4]) for r in rows]), np.array([len(r[5]) for r in rows]), np.array(skew), np.array(need)
    sa = np.array(suffix_array(text))
    own = owner[sa]
    # windows start before the core or at it, and what they take behind it must be there
    sa = sa[(start[sa] <= nl[own]) & (start[sa] + skew[own] <= nr[own])]
    if len(sa) < 2:
        return []
    own = owner[sa]
    x = np.r_[x, np.zeros(int(need.max()), x.dtype)]
    same = need[own][1:] == need[own][:-1]
    for k in range(int(need.max())):
        same &= (x[sa[1:] + k] == x[sa[:-1] + k]) | (k >= need[own][1:])
    klass = np.r_[0, np.cumsum(~same)]
    doc = np.array([r[2] for r in rows])[own]
    at = np.array([r[3] for r in rows])[own] + start[sa]
    order = np.lexsort((at, doc, klass))
    # a window may stand in two parts of one text; only other places than the class's first are late
    head = np.maximum.accumulate(np.where(np.r_[True, klass[order][1:] != klass[order][:-1]], np.arange(len(order)), 0))
    late = (doc[order] != doc[order][head]) | (at[order] != at[order][head])
    late = order[late]
    late = late[np.lexsort((at[late], own[late]))]
    if not len(late):
        return []
    r, p = own[late], at[late]
    cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] > p[:-1] + width)])
    return list(zip(r[cut].tolist(), p[cut].tolist(), (p[np.r_[cut[1:] - 1, len(p) - 1]] + width).tolist()))


def _by_suffixes(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, lo, hi): windows of parts that an earlier part of the same core has."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def emit(block):
        found = _sorted_windows(block, width)
        ids = [None if block[r][2] == -(1 << 63) else block[r][2] for r, _, _ in found]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids, [x for _, x, _ in found], [y for _, _, y in found])], ["doc_id", "lo", "hi"])

    def run(batches):
        block, group, key, size = [], [], None, 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(6))):
                if row[0] != key:
                    if size > BLOCK:
                        yield emit(block)
                        block, size = [], 0
                    block += group
                    group, key = [], row[0]
                k, q, doc, lo, left, right = row
                size += len(left) + len(right) + 2
                group.append((k, q, doc if doc is not None else -(1 << 63), lo, left, right))
        block += group
        if block:
            yield emit(block)

    dealt = rows.select("k", "q", "doc_id", "lo", "left", "right").repartition(parts, "k").sortWithinPartitions("k")
    return dealt.mapInArrow(run, "doc_id long, lo long, hi long")


def _by_windows(rows: DataFrame, width: int) -> DataFrame:
    """The same by grouping all windows, for cores with many parts."""
    span = F.array(*[F.lit(_part(q, width - GRAM + 1)[1] - _part(q, width - GRAM + 1)[0]) for q in range(PARTS)])
    skew = F.get(span, F.col("q")) - F.length("left")
    most = F.least(F.length("left"), F.length("right") - skew)
    at = F.explode(F.when(most >= 0, F.sequence(F.lit(0), most)).otherwise(F.array().cast("array<int>")))
    windows = rows.select("doc_id", "lo", "k", "q", "left", "right", skew.alias("skew"), at.alias("o"))
    key = F.struct("k", "q", "o", "skew", F.substring("left", F.col("o") + 1, F.length("left")).alias("l"), F.substring("right", F.lit(1), F.col("o") + F.col("skew")).alias("r"))
    text = F.concat(F.col("w.k").cast("string"), F.lit("|"), F.col("w.q").cast("string"), F.lit("|"), F.hex("w.l"), F.lit("|"), F.hex("w.r"))
    windows = windows.select("doc_id", (F.col("lo") + F.col("o")).alias("lo"), key.alias("w")).select("doc_id", "lo", F.sha2(text, 256).alias("w"))
    least = windows.groupBy("w").agg(F.min(F.struct("doc_id", "lo")).alias("f"), F.count("*").alias("m")).where("m > 1")
    return windows.join(least, "w").where(F.struct("doc_id", "lo") != F.col("f")).select("doc_id", "lo", (F.col("lo") + width).alias("hi"))


def repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, lo, hi): runs of bytes lo..hi covered by strings of width bytes that also start earlier.

    They may overlap, and hi may lie beyond the text's end.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    counts = _anchor_hashes(docs, width).groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    counts = common.table(counts.select("a"), "repeated")
    common.free(spark)
    repeated = _bitmap(counts, "a")
    common.drop(counts)
    rows = common.table(_surroundings(docs, width, repeated), "anchors")
    told = common.table(_told(rows), "told")
    common.free(spark)
    around = F.greatest(F.lit(0).cast("long"), F.col("pos") - (width - GRAM)).alias("lo"), (F.col("pos") + width).alias("hi")
    full = rows.where("c is null").select("doc_id", *around).union(told.where("p is null").select("doc_id", *around))
    unclear = told.where("p is not null")
    parts = common.table(_parts(docs, width, _bitmap(unclear, "p"), "c"), "parts")
    first_part = common.table(parts.groupBy("s", "q", "k").agg(F.min(F.struct("doc_id", "pos", "lo", "hi")).alias("f")), "first-parts")
    full_part = (
        parts.join(first_part, ["s", "q", "k"]).where(F.struct("doc_id", "pos") != F.struct("f.doc_id", "f.pos")).select("doc_id", "lo", "hi")
    )
    cores = first_part.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    open_parts = common.table(first_part.join(cores, "k").select("s", "k", "q", "n", "f.doc_id", "f.pos", "f.lo"), "open-parts")
    places = _bitmap(open_parts.select(_place_column("s", "doc_id", "pos").alias("p")), "p")
    raw = _parts(docs, width, places, "s").select("s", "k", "q", F.col("doc_id").alias("d"), F.col("pos").alias("p"), "left", "right")
    same = (F.col("pos") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d"))
    held = common.table(open_parts.join(raw, ["s", "q", "k"]).where(same).drop("d", "p"), "held")
    common.free(spark)
    found = full.union(full_part).union(_by_suffixes(held.where(F.col("n") <= HOT), width))
    return found.union(_by_windows(held.where(F.col("n") > HOT), width))


def suffix_dedup(docs: DataFrame, width: int = 100) -> DataFrame:
    """Per document: doc_id, kept (bytes that stay), spans (removed runs, start and end), n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null counts as empty, matches never cross texts. A byte goes if a string of width bytes
    that covers it also starts earlier: in a text of smaller doc_id, or earlier in the same text; overlaps count, and
    strings are judged on the input. A null doc_id comes first. Rows that share a doc_id count as one place: they
    don't remove each other's bytes, and runs found for one are removed from all, as far as they reach. Texts shorter
    than width lose nothing. Only doc_id and text are read.
    """
    before = len(common.CREATED)
    found = repeats(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("lo"), F.col("hi"))).alias("runs"))
    found = common.table(found, "runs")
    # the texts are shuffled next; all that the runs come from goes first
    for path in common.CREATED[before:]:
        if path != found._scratch_path:
            common.remove(docs.sparkSession, path)
    common.free(docs.sparkSession)
    found = found.withColumnRenamed("doc_id", "d")
    joined = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "runs.lo", "runs.hi")

    def run(batches):
        for b in batches:
            for i, j, data, offs in common.chunks(b, "text"):
                kept, spans, n, gone, many, sha = [], [], [], [], [], []
                los, his = b.column(2).slice(i, j - i).to_pylist(), b.column(3).slice(i, j - i).to_pylist()
                for r in range(j - i):
                    x = data[offs[r] : offs[r + 1]]
                    depth = np.zeros(len(x) + 1, np.int64)
                    if los[r]:
                        np.add.at(depth, np.minimum(los[r], len(x)), 1)
                        np.add.at(depth, np.minimum(his[r], len(x)), -1)
                    out = np.cumsum(depth)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                    stay = x[~out].tobytes()
                    kept.append(stay)
                    spans.append([{"start": int(u), "end": int(v)} for u, v in zip(edge[::2], edge[1::2])])
                    n.append(len(x))
                    gone.append(int(out.sum()))
                    many.append(len(edge) // 2)
                    sha.append(hashlib.sha256(stay).hexdigest())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(sha)],
                    ["doc_id", "kept", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [joined.schema["doc_id"], T.StructField("kept", T.BinaryType()), T.StructField("spans", span), T.StructField("n_bytes", T.LongType()),
         T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    )
    return joined.mapInArrow(run, schema)

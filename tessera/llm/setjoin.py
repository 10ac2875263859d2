"""Exact Jaccard self-join of word n-gram sets by prefix filters under one or more global token orders.

A *unit* is a distinct n-gram set, named by a 64-bit key; documents or lines with equal sets share a unit. Two units can
only reach the threshold if their prefixes (the first n - ceil(t n) + 1 tokens of each under one global order) share a
token, whatever the order.

* Orders go by rarity: the FREQUENT most frequent tokens by count come last, by their counts; all others stand before
  them, by a hash. The counts travel to the tasks; their number is fixed, whatever the input.
* Prefix tokens are packed into blobs by hash of the token, one shuffle for each order; those of the second order and later ones
  only of units that the first has left in a pair. The number of blobs follows the
  counted prefixes, so each has a bounded size. Rows of frequent tokens are dealt by unit, so no token's rows meet.
* Units that meet under a token give pairs, cut by the length and positional filters; a pair must come out of every order
  (the filters are intersected). Parity sketches (which buckets hold an odd number of a set's tokens: buckets that differ are at
  most the tokens that do) cut them once more before their sets are compared.
* A token is *hot* if it is frequent or if more than a few prefixes hold it. The units under one hot token make a tile, or
  parts of bounded size that meet two by two; units without a common hot token never meet. In a tile the sketches of units of
  like sizes are compared at once, but for pairs that share the frequent token before, too: these have met under that one. First
  only a spanning forest of the pairs that the sketches allow, or each unit's earliest one, leaves the task to be verified.
  The pairs that this leaves open (across the components found, or of units without an earlier match) never leave the task: the
  sets of their units come to the tile and are compared there, and a forest of the links goes out, or one link of each unit.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, kernel
from .kernel import U, mix

#: Tokens whose counts travel to the tasks.
FREQUENT = 1 << 17
#: Prefix tokens in a blob, about.
BLOB = 300_000
#: Buckets of a sketch at most; bytes of sketches in a tile's part, about.
MOST_BITS, BLOCK = 1 << 17, 16 << 20
#: Bytes of tokens in a part of a tile whose sets are compared, about.
SETS = 32 << 20
#: Pairs of a tile whose sketches are compared at once, and the words of these.
AT_ONCE = 200_000, 2_000_000
#: Tokens a task counts at once, prefix tokens it packs at once.
COUNTED, PACKED = 1_500_000, 400_000
#: Where a document without an id stands: before all others.
NOWHERE = -(1 << 62)
#: Bit of frequent tokens' names.
_FREQUENT = U(1 << 62)
_ROW = np.dtype([("token", "<u8"), ("unit", "<u8"), ("before", "<u8"), ("n", "<i4"), ("pos", "<i4")])


@dataclass(frozen=True)
class Spec:
    """n: words in an n-gram; num / den: the Jaccard threshold; by_line: units are lines, else whole texts; orders: how many global
    orders (8 at most); often: a count that can make a token frequent; large: units under one token whose pairs are named one by
    one; tile: units in a tile's part. The last three only shift work from one path to the other. bits: a sketch's, at least."""

    n: int
    num: int
    den: int
    by_line: bool = False
    orders: int = 2
    often: int = 64
    large: int = 48
    tile: int = 4000
    bits: int = 1024

    def prefix(self, size):
        """Length of the prefix of sets of these sizes; 0 for empty ones."""
        return np.where(size > 0, size - (self.num * size + self.den - 1) // self.den + 1, 0)


def _i64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sets(batch, spec: Spec):
    """Yields (ids of the segments' rows, segment's number in its row, tokens, segment of each token, sizes, units)."""
    ids = batch.column(0)
    if not len(ids):
        return
    for i, j, data, offs in common.chunks(batch, "text"):
        if spec.by_line:
            offs, row, per = kernel.lines(data, offs)
            number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            mine = ids.take(pa.array(row + i))
        else:
            mine, number = ids.slice(i, j - i), np.zeros(j - i, np.int64)
        g, s, size = kernel.ngram_sets(data, offs, spec.n)
        yield mine, number, g, s, size, kernel.set_keys(g, size)


class _Seen:
    """Tells units that a task has met lately from new ones; a fixed table, so a unit may count as new again."""

    def __init__(self):
        self.table = np.zeros(1 << 18, U)

    def first(self, units: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mask of the segments that aren't empty and whose unit is new."""
        full = np.flatnonzero(size)
        u, at = np.unique(units[full], return_index=True)
        slot = (u & U(len(self.table) - 1)).astype(np.int64)
        new = self.table[slot] != u
        self.table[slot] = u
        out = np.zeros(len(size), bool)
        out[full[at[new]]] = True
        return out


def _sketches(g, s, size, least: int) -> list[bytes]:
    """Sketches of the sets: which of 2 ** k buckets hold an odd number of tokens, about two buckets a token but least to MOST_BITS in all.

    A sketch of half as many buckets is the XOR of one's halves, so sketches of any two sizes can be compared.
    """
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(1, 2 * size))).astype(np.int64), least, MOST_BITS)
    out: list[bytes] = [b""] * len(size)
    for n in np.unique(bits[size > 0]).tolist():
        rows = np.flatnonzero((bits == n) & (size > 0))
        place = np.full(len(size), -1)
        place[rows] = np.arange(len(rows))
        mine = place[s] >= 0
        odd = np.bincount(place[s[mine]] * n + (g[mine] & U(n - 1)).astype(np.int64), minlength=len(rows) * n) & 1
        packed = np.packbits(odd.astype(np.uint8).reshape(-1, n), axis=1)
        for r, x in zip(rows.tolist(), packed):
            out[r] = x.tobytes()
    return out


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketch of so many words from a larger one."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def scan(docs: DataFrame, spec: Spec) -> DataFrame:
    """(kind, doc_id, line, u, n, sketch): kind 0 for every text or line (n = 0 and u = 0 without words); kind 1 for tokens u that stand
    n times in the units a task has met, if more than once among COUNTED tokens or so."""

    def counted(tokens):
        t, n = np.unique(np.concatenate(tokens), return_counts=True)
        t, n = t[n > 1], n[n > 1]
        none = pa.nulls(len(t), pa.int64())
        return _batch([np.ones(len(t), np.int32), none, none, _i64(t), n, pa.nulls(len(t), pa.binary())], SCAN)

    def run(batches):
        seen, held, some = _Seen(), [], 0
        for b in batches:
            for ids, number, g, s, size, units in _sets(b, spec):
                yield _batch([np.zeros(len(number), np.int32), ids, number, _i64(units), size, _sketches(g, s, size, spec.bits)], SCAN)
                new = seen.first(units, size)
                held.append(g[new[s]])
                some += len(held[-1])
                if some > COUNTED:
                    yield counted(held)
                    held, some = [], 0
        if held:
            yield counted(held)

    return docs.select("doc_id", "text").mapInArrow(common.released(run), SCAN)


SCAN = "kind int, doc_id long, line long, u long, n long, sketch binary"


def _batch(cols, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([c.cast(kinds[k]) if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, k in zip(cols, types)], list(names))


def units_of(scanned: DataFrame) -> DataFrame:
    """(doc_id, line, n, u, sketch) of every text or line."""
    return scanned.where("kind = 0").drop("kind")


@dataclass
class Frequent:
    """token: sorted; place: each token's place among the frequent ones, by order; bits: a bitmap of the tokens, to skip most lookups."""

    token: np.ndarray
    place: np.ndarray
    bits: np.ndarray

    BITS = 22

    def look(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of g are frequent, and their index here."""
        at = np.flatnonzero(common.in_bitmap(self.bits, g, self.BITS))
        if not len(self.token):
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(self.token, g[at]), len(self.token) - 1)
        ok = self.token[where] == g[at]
        return at[ok], where[ok]


def frequent(scanned: DataFrame, spec: Spec) -> Frequent:
    """The FREQUENT tokens of the highest counts, as far as they reach spec.often; all of one count or none."""
    counts = scanned.where("kind = 1").groupBy("u").agg(F.sum("n").alias("c")).where(F.col("c") >= spec.often)
    counts = common.table(counts, "frequent")
    spread = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(FREQUENT).collect()
    least, have = 1 << 62, 0
    for r in spread:
        if have + r["n"] > FREQUENT:
            break
        least, have = r["c"], have + r["n"]
    rows = counts.where(F.col("c") >= least).toArrow()
    common.drop(counts)
    token = rows.column("u").to_numpy().astype(np.int64).view(U)
    c = rows.column("c").to_numpy().astype(np.int64)
    order = np.argsort(token)
    token, c = token[order], c[order]
    place = np.zeros((spec.orders, len(token)), np.int64)
    for o in range(spec.orders):
        # the first order goes by the very count, the others by its magnitude and then by their hash
        place[o, np.lexsort((_hash(token, o), c if o == 0 else np.log2(c + 1).astype(int)))] = np.arange(len(token))
    bits = np.zeros(1 << (Frequent.BITS - 3), np.uint8)
    pos = (token & U((1 << Frequent.BITS) - 1)).astype(np.int64)
    np.bitwise_or.at(bits, pos >> 3, (1 << (pos & 7)).astype(np.uint8))
    return Frequent(token, place, bits)


def _hash(g: np.ndarray, order: int) -> np.ndarray:
    """62-bit place of each token in an order of its own; it also names the token there."""
    return mix(g ^ U((order + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1)) >> U(2)


def _prefixes(g, s, size, units, spec: Spec, order: int, often: Frequent) -> np.ndarray:
    """Rows of the prefix tokens of all sets under an order: token, unit, the token before, set size, 8 * place + order."""
    key = _hash(g, order)
    at, which = often.look(g)
    key[at] = _FREQUENT | U(order << 40) | often.place[order][which].astype(U)
    end = np.cumsum(size)
    begin = end - size
    for a, b in zip(begin.tolist(), end.tolist()):
        if b - a > 1:
            key[a:b].sort()
    rank = np.arange(len(key)) - begin[s]
    ok = np.flatnonzero(rank < spec.prefix(size)[s])
    out = np.empty(len(ok), _ROW)
    out["token"], out["unit"], out["n"], out["pos"] = key[ok], units[s[ok]], size[s[ok]], 8 * rank[ok] + order
    out["before"] = np.where(rank[ok] > 0, key[ok - 1], 0)
    return out


def prefixes(docs: DataFrame, spec: Spec, often: Frequent, buckets: int, order: int = 0, places: DataFrame | None = None) -> DataFrame:
    """(bucket, rows): the prefix tokens of every unit, or of those at places, under an order, packed by bucket: that of the token, or of the
    unit if it is frequent."""
    shared = docs.sparkSession.sparkContext.broadcast((often, None if places is None else wanted(places)))

    def packed(parts):
        rows = np.concatenate(parts)
        bucket = mix(np.where(rows["token"] >= _FREQUENT, rows["unit"], rows["token"])) % U(buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cut[1:], len(rows)]
        for k in range(0, len(cut), 256):
            some = list(zip(cut[k : k + 256].tolist(), ends[k : k + 256].tolist()))
            yield _batch([bucket[cut[k : k + 256]].astype(np.int32), [rows[a:b].tobytes() for a, b in some]], "bucket int, rows binary")

    def run(batches):
        seen, held, some = _Seen(), [], 0
        often, only = shared.value
        for b in batches:
            for ids, number, g, s, size, units in _sets(only.texts(b) if only else b, spec):
                new = seen.first(units, np.where(only.units(ids, number, units), size, 0) if only else size)
                m = new[s]
                g, s, size = g[m], s[m], np.where(new, size, 0)
                held.append(_prefixes(g, s, size, units, spec, order, often))
                some += len(held[-1])
                if some > PACKED:
                    yield from packed(held)
                    held, some = [], 0
        if some:
            yield from packed(held)

    return docs.select("doc_id", "text").mapInArrow(common.released(run), "bucket int, rows binary")


FOUND = "kind int, a long, b long, na long, nb long, o int"


def _pairs_of(rows: np.ndarray, spec: Spec):
    """Of one blob's rows: pairs of units under one token (kind 0: a, b and their sizes, o: the order's bit), and rows of hot tokens (kind 1: unit a, token b,
    size na, nb: the token before, 0 if that isn't frequent)."""
    often = rows["token"] >= _FREQUENT
    hot = [rows[often]]
    rows = rows[~often]
    rows = rows[np.argsort(rows["token"], kind="stable")]
    tok = rows["token"]
    alone = np.ones(len(tok), bool)
    same = tok[1:] == tok[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    rows = rows[~alone]
    rows = rows[np.lexsort((rows["unit"], rows["token"]))]
    tok, unit = rows["token"], rows["unit"]
    if len(rows):
        rows = rows[np.r_[True, (tok[1:] != tok[:-1]) | (unit[1:] != unit[:-1])]]
        tok = rows["token"]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        size = np.diff(np.r_[start, len(tok)])
        hot += [rows[a : a + m] for a, m in zip(start[size > spec.large].tolist(), size[size > spec.large].tolist())]
        for m in range(2, spec.large + 1):  # all groups of one size at a time
            first = start[size == m]
            i, j = np.triu_indices(m, 1)
            for k in range(0, len(first), max(1, 200_000 // len(i))):
                some = first[k : k + max(1, 200_000 // len(i))]
                yield from _filtered(rows, (some[:, None] + i).ravel(), (some[:, None] + j).ravel(), spec)
    hot = np.concatenate(hot)
    if len(hot):
        zero = np.zeros(len(hot), np.int64)
        before = np.where(hot["before"] >= _FREQUENT, hot["before"], 0)
        yield _batch([zero + 1, _i64(hot["unit"]), _i64(hot["token"]), hot["n"], _i64(before), zero], FOUND)


def _filtered(rows, i, j, spec: Spec):
    before = rows["before"]
    # where the tokens before are one and the same, the pair has come up with that one
    ok = (before[i] != before[j]) | (before[i] == 0)
    ok &= (rows["pos"][i] & 7) == (rows["pos"][j] & 7)
    i, j = i[ok], j[ok]
    na, nb = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64)
    pa_, pb = rows["pos"][i] >> 3, rows["pos"][j] >> 3
    ok = spec.den * np.minimum(na, nb) >= spec.num * np.maximum(na, nb)
    ok &= (spec.num + spec.den) * (np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)) >= spec.num * (na + nb)
    i, j, na, nb = i[ok], j[ok], na[ok], nb[ok]
    if len(i):
        a, b, bit = rows["unit"][i], rows["unit"][j], 1 << (rows["pos"][i] & 7)
        order = np.lexsort((bit, b, a))
        new = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (bit[order][1:] != bit[order][:-1])]]
        yield _batch([np.zeros(len(new), np.int32), _i64(a[new]), _i64(b[new]), na[new], nb[new], bit[new].astype(np.int32)], FOUND)


def _met(packed: DataFrame, spec: Spec, buckets: int) -> DataFrame:
    """What _pairs_of() finds in each bucket; the rows of a bucket stand together and are held one bucket at a time."""

    def run(batches):
        held, bucket = [], None
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                if k != bucket and held:
                    yield from _pairs_of(np.concatenate(held), spec)
                    held = []
                bucket = k
                held.append(np.frombuffer(x.as_buffer(), _ROW))
        if held:
            yield from _pairs_of(np.concatenate(held), spec)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(common.released(run), FOUND)


def _candidates(found: DataFrame, spec: Spec, places: DataFrame) -> DataFrame:
    """(a, b, na, nb) of the pairs that share prefix tokens under every order and whose sketches allow the threshold; a is the smaller unsigned key."""
    pairs = found.where("kind = 0")
    if spec.orders == 1:
        pairs = pairs.select("a", "b", "na", "nb").distinct()
    else:
        pairs = (
            pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.bit_or("o").alias("o"))
            .where(F.col("o") == (1 << spec.orders) - 1).drop("o")
        )
    for c in "ab":
        pairs = pairs.join(places.select(F.col("u").alias(c), F.col("sketch").alias(f"s{c}")), c)

    def run(batches):
        for b in batches:
            n = b.column("na").to_numpy() + b.column("nb").to_numpy()
            differ = np.zeros(len(n), np.int64)
            for k, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                words = min(len(x), len(y))
                differ[k] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(dtype=np.int64)
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array((spec.den + spec.num) * differ <= (spec.den - spec.num) * n))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(common.released(run), "a long, b long, na long, nb long")


@dataclass
class Wanted:
    """Places of units that are asked for, and their documents, as bitmaps: their size follows the number of places up to 2 ** 27 bits;
    beyond that more units come than are asked for. Texts without such a place aren't cut into words."""

    bits: int
    docs: np.ndarray
    places: np.ndarray

    def texts(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        d = batch.column(0).fill_null(NOWHERE).to_numpy(zero_copy_only=False).view(U)
        return batch.filter(pa.array(common.in_bitmap(self.docs, d ^ (d >> U(32)), self.bits)))

    def units(self, ids, number, units) -> np.ndarray:
        d = ids.fill_null(NOWHERE).to_numpy(zero_copy_only=False).view(U)
        return common.in_bitmap(self.places, units ^ (d << U(7)) ^ number.view(U), self.bits)


def wanted(places: DataFrame) -> Wanted:
    """places: a table (u, d, line)."""
    bits = min(27, max(20, 4 + int(places.count()).bit_length()))
    key = F.col("u").bitwiseXOR(F.shiftleft("d", 7)).bitwiseXOR(F.col("line"))
    d = F.col("d").bitwiseXOR(F.shiftrightunsigned("d", 32))
    return Wanted(bits, common.bitmap(places.select(d.alias("p")), "p", bits), common.bitmap(places.select(key.alias("p")), "p", bits))


def unit_tokens(docs: DataFrame, spec: Spec, places: DataFrame) -> DataFrame:
    """(u, tokens): the sets of the units at places, a table (u, d, line), each once a task at most; more sets may come."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted(places))

    def run(batches):
        seen = _Seen()
        for b in batches:
            for ids, number, g, s, size, units in _sets(shared.value.texts(b), spec):
                ok = shared.value.units(ids, number, units)
                ok &= seen.first(units, np.where(ok, size, 0))
                begin = np.cumsum(size) - size
                rows = np.flatnonzero(ok)
                for c in range(0, len(rows), 500):
                    part = rows[c : c + 500]
                    n = np.r_[0, np.cumsum(size[part])].astype(np.int32)
                    flat = np.concatenate([g[begin[x] : begin[x] + size[x]] for x in part])
                    yield pa.RecordBatch.from_arrays([pa.array(_i64(units[part])), pa.ListArray.from_arrays(pa.array(n), pa.array(_i64(flat)))], ["u", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(common.released(run), "u long, tokens array<long>")


def _verified(spec: Spec, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("u").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("u").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(a, "a").join(b, "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    return both.where(F.lit(spec.num + spec.den) * inter >= F.lit(spec.num) * (F.col("na") + F.col("nb"))).select("a", "b")


# --- hot tokens ------------------------------------------------------------------------------------------------------


def _tiles(hot: DataFrame, spec: Spec) -> DataFrame:
    """(tile, mine, u, n, before) of hot rows (u, token, n, before): the units under each token that several have, whole or in parts
    dealt by unit, each two of which make a tile; mine: 1 in the first part, and where a part meets itself. Tokens all of whose
    units have met under the one before are left out."""
    size = F.greatest(F.count("*") / spec.tile, F.sum(F.least(F.lit(MOST_BITS), F.greatest(4 * F.col("n"), F.lit(spec.bits)))) / (8 * BLOCK))
    tokens = hot.groupBy("token").agg(F.count("*").alias("c"), F.ceil(size).cast("int").alias("parts"), F.min("before").alias("low"), F.max("before").alias("high"))
    tokens = tokens.where("c > 1 and (low = 0 or low < high)").select("token", "parts")
    part = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
    rows = hot.join(tokens, "token").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other"))
    return rows.select(tile.alias("tile"), (F.col("part") <= F.col("other")).cast("int").alias("mine"), "u", "n", "before")


def _differ(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Buckets in which the sketches x[i] and y[j] differ."""
    out = np.zeros(len(i), np.int64)
    step = max(1, AT_ONCE[1] // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        out[k : k + step] = np.bitwise_count(x[i[k : k + step]] ^ y[j[k : k + step]]).sum(1, dtype=np.int64)
    return out


def _allowed(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, bx: np.ndarray, by: np.ndarray, spec: Spec) -> np.ndarray:
    """Matrix of the pairs of units (sketches x and y, sizes nx and ny, the frequent tokens before bx and by) whose sizes and sketches
    allow the threshold and that don't share the token before."""
    out = np.zeros((len(x), len(y)), bool)
    if not len(x) or not len(y):
        return out
    rows, cols = np.argsort(nx, kind="stable"), np.argsort(ny, kind="stable")
    sizes = ny[cols]
    some = max(1, x.shape[1] // 4)
    k = 0
    while k < len(rows):
        # sizes that fit the smallest of the next rows, up to those that fit the largest
        low = np.searchsorted(sizes, -(-spec.num * nx[rows[k]] // spec.den))
        high = np.searchsorted(sizes, spec.den * nx[rows[min(len(rows), k + 64) - 1]] // spec.num, "right")
        r, c = rows[k : k + min(64, max(1, AT_ONCE[0] // max(1, high - low)))], cols[low:high]
        k += len(r)
        n, m = nx[r][:, None], ny[c][None, :]
        i, j = np.nonzero((spec.den * np.minimum(n, m) >= spec.num * np.maximum(n, m)) & ((bx[r][:, None] != by[c][None, :]) | (bx[r] == 0)[:, None]))
        i, j = r[i], c[j]
        # a part of the sketches rules most pairs out
        most = (spec.den - spec.num) * (nx[i] + ny[j])
        differ = _differ(x[:, :some], y[:, :some], i, j)
        ok = (spec.den + spec.num) * differ <= most
        i, j, most, differ = i[ok], j[ok], most[ok], differ[ok]
        ok = (spec.den + spec.num) * (differ + _differ(x[:, some:], y[:, some:], i, j)) <= most
        out[i[ok], j[ok]] = True
    return out


def _forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the graph with these links between rows and columns; same: rows are columns."""
    n, m = linked.shape
    rows, cols, edges = np.ones(n, bool), np.ones(m, bool), []
    for r in range(n):
        if not rows[r]:
            continue
        rows[r] = False
        front = [(r, True)]
        while front:
            x, is_row = front.pop()
            if same:
                new = np.flatnonzero(linked[x] & rows)
                rows[new] = False
                edges += [(x, int(y)) for y in new]
                front += [(int(y), True) for y in new]
                continue
            new = np.flatnonzero(linked[x] & cols) if is_row else np.flatnonzero(linked[:, x] & rows)
            (cols if is_row else rows)[new] = False
            edges += [(x, int(y)) if is_row else (int(y), x) for y in new]
            front += [(int(y), not is_row) for y in new]
    return edges


class _Tile:
    """One tile's units from rows (mine, u, n, before, d, line, state, sketch), each once. rows, cols: those that meet; same: all meet
    each other; ok: which pairs of rows and cols the sizes and sketches allow; take: the rows of part the units come from."""

    def __init__(self, part: pa.Table, spec: Spec):
        col = lambda c: part.column(c).to_numpy()
        self.take = new = np.unique(col("u"), return_index=True)[1]
        u, n, state, before, left = (col(c)[new] for c in ("u", "n", "state", "before", "mine"))
        left = left.astype(bool)
        self.u, self.n, self.state = u, n, state
        self.line, self.d = col("line")[new], col("d")[new]
        x = [np.frombuffer(v.as_buffer(), U) for v in part.column("sketch").combine_chunks().take(pa.array(new))]
        self.same = same = bool(left.all())
        self.rows, self.cols = rows, cols = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        self.ok = ok = np.zeros((len(rows), len(cols)), bool)
        words = np.array([len(v) for v in x])
        for w in np.unique(words).tolist():
            # sketches meet at the size of the smaller one
            fit = {w: np.flatnonzero(words == w)} | {v: np.flatnonzero(words == v) for v in set(words.tolist()) if v > w and (n[words == v].min() * spec.num <= n[words == w].max() * spec.den)}
            for a, b in [(w, v) for v in fit] + [(v, w) for v in fit if v > w]:
                r, c = np.flatnonzero(np.isin(rows, fit[a])), np.flatnonzero(np.isin(cols, fit[b]))
                if len(r) and len(c):
                    i, j = rows[r], cols[c]
                    y, z = (np.stack([_folded(x[k], w) for k in t]) for t in (i, j))
                    ok[np.ix_(r, c)] = _allowed(y, z, n[i], n[j], before[i], before[j], spec)
        if same:
            np.fill_diagonal(ok, False)

    def rank(self) -> np.ndarray:
        """Place of each unit in the order of (d, line, u)."""
        r = np.empty(len(self.u), np.int64)
        r[np.lexsort((self.u, self.line, self.d))] = np.arange(len(r))
        return r

    def sides(self):
        """(matrix, units, units they look at) so that every unit looks at all that it meets."""
        one = (self.ok, self.rows, self.cols)
        return (one,) if self.same else (one, (self.ok.T, self.cols, self.rows))


def _tile_pairs(part: pa.Table, spec: Spec, by_rank: bool, rest: bool):
    """Of one tile, without rest: pairs to verify (kind 0), a forest, or by rank each unit's earliest pair and then the units that occur
    in any (kind 2). With rest: the rows of the units that occur in a pair which is still open, that is, across components (state), or
    by rank of a later unit without a match (state 0)."""
    before, state = part.column("before").to_numpy(), part.column("state").to_numpy()
    if before[0] != 0 and (before == before[0]).all() or rest and (state.all() if by_rank else (state == state[0]).all()):
        return
    t = _Tile(part, spec)
    u, n, rows, cols = t.u, t.n, t.rows, t.cols
    r = t.rank()
    if rest:
        some = np.zeros(len(u), bool)
        for k, x in enumerate(rows.tolist()):
            y = cols[t.ok[k]]
            y = y[np.where(r[y] > r[x], t.state[y], t.state[x]) == 0] if by_rank else y[t.state[y] != t.state[x]]
            some[y] = True
            some[x] |= len(y) > 0
        if some.any():
            yield from part.take(pa.array(np.sort(t.take[some]))).combine_chunks().to_batches()
        return
    if by_rank:
        pairs = []
        for mat, a, b in t.sides():
            # a's rows look for earlier ones among b
            best, first = np.zeros(len(a), np.int64), np.full(len(a), len(u))
            for k in range(0, len(a) if len(b) else 0, 500):
                at = np.where(mat[k : k + 500], r[b][None, :], len(u))
                best[k : k + 500], first[k : k + 500] = at.argmin(1), at.min(1)
            late = np.flatnonzero(first < r[a])
            pairs.append((a[late], b[best[late]]))
        i, j = (np.concatenate(z) for z in zip(*pairs))
    else:
        e = np.array(_forest(t.ok, t.same), np.int64).reshape(-1, 2)
        i, j = rows[e[:, 0]], cols[e[:, 1]]
    low, high = np.where(u[i].view(U) < u[j].view(U), (i, j), (j, i))
    yield _batch([np.zeros(len(low), np.int32), u[low], u[high], n[low], n[high], np.zeros(len(low), np.int32)], FOUND)
    if by_rank:
        some = np.concatenate([rows[t.ok.any(1)], cols[t.ok.any(0)]])
        zero = np.zeros(len(some), np.int64)
        yield _batch([zero + 2, u[some], zero, n[some], zero, zero], FOUND)


def _tile_links(part: pa.Table, spec: Spec, by_rank: bool):
    """Links (a, b) of one tile's open units, whose sets come along (tokens): a spanning forest of all links across components, or by
    rank one link to an earlier unit for each that has one. Open pairs are compared here, so rows follow the units."""
    t = _Tile(part, spec)
    held = part.column("tokens").combine_chunks()
    flat, ends = held.values.to_numpy(), held.offsets.to_numpy().astype(np.int64)
    begin, size = ends[:-1][t.take], np.diff(ends)[t.take]
    n, state, r = t.n, t.state, t.rank()
    root = np.unique(state, return_inverse=True)[1]
    found: list[tuple[int, int]] = []

    def linked(x: int, y: np.ndarray) -> np.ndarray:
        mine = np.sort(flat[begin[x] : begin[x] + size[x]])
        at = np.repeat(begin[y] - (np.cumsum(size[y]) - size[y]), size[y]) + np.arange(int(size[y].sum()))
        shared = mine[np.minimum(np.searchsorted(mine, flat[at]), len(mine) - 1)] == flat[at]
        both = np.add.reduceat(shared, np.cumsum(size[y]) - size[y], dtype=np.int64)
        return y[(spec.num + spec.den) * both >= spec.num * (n[x] + n[y])]

    for mat, a, b in t.sides() if by_rank else t.sides()[:1]:
        for k, x in enumerate(a.tolist()):
            if by_rank and state[x]:
                continue
            y = b[mat[k] & (r[b] < r[x])] if by_rank else b[k + 1 :][mat[k, k + 1 :]] if t.same else b[mat[k]]
            some = 8
            while len(y) and not (by_rank and state[x]):
                y = y if by_rank else y[root[y] != root[x]]
                # more at a time, but not too many tokens
                few = max(1, min(some, int(np.searchsorted(np.cumsum(size[y]), AT_ONCE[1]))))
                hit, y, some = linked(x, y[:few]) if len(y) else y, y[few:], 2 * some
                if by_rank and len(hit):
                    found.append((x, int(hit[0])))
                    state[x] = 1
                elif len(hit):
                    own, first = np.unique(root[hit], return_index=True)
                    found += [(x, int(z)) for z in hit[first]]
                    root[np.isin(root, own)] = root[x]
    e = np.array(found, np.int64).reshape(-1, 2)
    yield _batch([t.u[e[:, 0]], t.u[e[:, 1]]], "a long, b long")


MEMBER = "tile long, mine int, u long, n long, before long, d long, line long, state long, sketch binary"


def _in_tiles(spec: Spec, members: DataFrame, by_rank: bool, each, *more: bool, schema: str = FOUND) -> DataFrame:
    """What each() gives for each tile of members (tile, ...)."""
    parts = max(8, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        # tiles stand one after another; the rows of one are held at a time
        held, key = [], None
        for b in batches:
            tiles = b.column(0).to_numpy()
            cut = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]]) if len(tiles) else []
            for x, y in zip(cut, np.r_[cut[1:], len(tiles)].tolist() if len(tiles) else []):
                if tiles[x] != key and held:
                    yield from each(pa.Table.from_batches(held), spec, by_rank, *more)
                    held = []
                key = tiles[x]
                held.append(b.slice(int(x), y - int(x)))
        if held:
            yield from each(pa.Table.from_batches(held), spec, by_rank, *more)

    return members.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(common.released(run), schema)


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of tiles with the units' tokens; a tile whose tokens take more than SETS bytes is parted once more."""
    tiles = rows.groupBy("tile").agg(F.ceil(F.sum(8 * F.col("n")) / SETS).cast("int").alias("parts"), F.min("mine").alias("alike"))
    part = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
    rows = rows.join(tiles, "tile").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("tile", F.least("part", "other"), F.greatest("part", "other"))
    mine = F.when(F.col("alike") == 1, (F.col("part") <= F.col("other")).cast("int")).otherwise(F.col("mine"))
    rows = rows.select(tile.alias("tile"), mine.alias("mine"), "u", "n", "before", "d", "line", "state", "sketch")
    return rows.join(sets, "u").select(rows.columns + ["tokens"])


def _thinned(pairs: DataFrame) -> DataFrame:
    """Of a table of pairs (kind, a, b, na, nb) those that connect what all connect: tiles have a forest each, and units meet in several.
    Each task makes one forest of about graph.ONE_TASK pairs."""

    def run(batches):
        root: dict[int, int] = {}

        def top(x):
            while (y := root.setdefault(x, x)) != x:
                root[x] = x = root[y]
            return x

        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                x, y = top(x), top(y)
                keep[k] = x != y
                root[x] = y
            yield b.filter(pa.array(keep))

    return pairs.coalesce(pairs.count() // graph.ONE_TASK + 1).mapInArrow(common.released(run), "kind int, a long, b long, na long, nb long")


def _later_first(out: DataFrame, places: DataFrame) -> DataFrame:
    """Links (a, b) turned so that b's unit stands before a's."""
    for c in "ab":
        out = out.join(places.select(F.col("u").alias(c), F.struct("d", "line", "u").alias(f"at_{c}")), c)
    late = F.col("at_a") > F.col("at_b")
    return out.select(F.when(late, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(late, F.col("b")).otherwise(F.col("a")).alias("b"))


def _found(docs: DataFrame, spec: Spec, scanned: DataFrame, places: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """What _pairs_of() finds under each order, a table each, and the places of the units in it (with n, and whether in a pair). The prefixes
    of further orders travel only for units that the first one has left in a pair: no other pairs come out of every order, and those
    under hot tokens have their tiles."""
    spark = docs.sparkSession
    often = frequent(scanned, spec)
    length = F.sum(F.col("n") - F.ceil(F.col("n") * spec.num / spec.den) + 2)
    total = scanned.where("kind = 0 and n > 0").agg(length).first()[0]
    out, near, paired = [], places, None
    for o in range(spec.orders):
        if o:
            paired = near.where("paired")
            total = paired.agg(length).first()[0]
        buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total or 0) // BLOB + 1)
        out.append(common.table(_met(prefixes(docs, spec, often, buckets, o, paired), spec, buckets), "found"))
        common.free(spark)
        if not o:
            a = out[0].select(F.col("a").alias("u"), F.col("na").alias("n"), (F.col("kind") == 0).alias("paired"))
            units = a.union(out[0].where("kind = 0").select("b", "nb", F.lit(True))).groupBy("u").agg(F.max("n").alias("n"), F.max("paired").alias("paired"))
            near = common.table(places.select("u", "d", "line", "sketch").join(units, "u"), "near")
    return out, near


def links(docs: DataFrame, spec: Spec, scanned: DataFrame, places: DataFrame, by_rank: bool = False) -> DataFrame:
    """Verified links (a, b) between different units of docs.

    scanned is scan()'s result; places (u, d, line, sketch) says where each unit stands first, as far as ids tell (d: doc_id or
    NOWHERE). Without by_rank the links connect exactly the units that the threshold connects. With by_rank every unit that
    has a match before it in the order of (d, line, u) has a link (a, b) from it to one; further such links may come too.
    """
    spark = docs.sparkSession
    each, places = _found(docs, spec, scanned, places)
    found = functools.reduce(DataFrame.union, each)
    pairs = _candidates(found, spec, places)
    hot = found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("token"), F.col("na").alias("n"), F.col("nb").alias("before")).distinct()
    members = None
    if not found.where("kind = 1").isEmpty():
        hot = common.table(hot, "hot")
        units = _tiles(hot, spec).join(places.select("u", "d", "line", "sketch"), "u")
        members = common.table(units.withColumn("state", F.lit(0).cast("long")).select([x.split()[0] for x in MEMBER.split(", ")]), "members")
        met = _in_tiles(spec, members, by_rank, _tile_pairs, False).select("kind", "a", "b", "na", "nb")
        met = met if by_rank else _thinned(common.table(met.distinct(), "met"))
        pairs = pairs.withColumn("kind", F.lit(0)).unionByName(met)
    else:
        pairs = pairs.withColumn("kind", F.lit(0))
    pairs = common.table(pairs.distinct(), "pairs")
    for x in each:
        common.drop(x)
    units = pairs.select(F.col("a").alias("u")).union(pairs.where("kind = 0").select("b")).distinct()
    at = common.table(places.select("u", "d", "line").join(units, "u", "left_semi"), "at")
    sets = common.table(unit_tokens(docs, spec, at), "sets")
    common.free(spark)
    named = pairs.where("kind = 0").drop("kind")
    out = _verified(spec, named, sets)
    if by_rank:
        out = _later_first(out, places)
    if members is None:
        return out
    out = common.table(out, "links")
    common.free(spark)
    if by_rank:
        state = out.select(F.col("a").alias("u"), F.lit(1).cast("long").alias("s")).distinct()
    else:
        state = graph.connected_components(out.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("u"), F.col("component").alias("s"))
    state = common.table(state, "state")
    told = members.drop("state").join(state, "u", "left").withColumn("state", F.coalesce("s", F.lit(0).cast("long") if by_rank else F.col("u")))
    rest = common.table(_in_tiles(spec, told.select(members.columns), by_rank, _tile_pairs, True, schema=MEMBER), "open")
    more = _in_tiles(spec, _with_sets(rest, sets), by_rank, _tile_links, schema="a long, b long")
    return out.union(common.table(more.distinct(), "more-links"))

"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

The model predicts the next output (one of the OUTPUTS most frequent tokens, or 'another token') from the two before
it: s(w | u, v) = q_w . (c1 * r_u + c2 * r_v) + b_w with embeddings r, q and per-position weights c1, c2. Training texts are dealt into
shards by a hash of what they hold, so that shards and with them scores don't depend on how the input lies in files. Each
shard trains over all its texts from one start, with noise drawn from the unigram distribution; the shards' parameters are
averaged by their tokens. Two matrix products give all scores, and normalisers for every context follow in batches,
so token log-probabilities are normalised exactly. 'Another token' is shared out by its add-one unigram frequency.

Token counts cover all training texts. The counts of the most frequent tokens (at most KNOWN, a fixed bound) travel
to the tasks; all other tokens look theirs up by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernel
from .kernel import U

OUTPUTS = 1000
KNOWN = 1 << 19
DIM = 24
#: Tokens a shard trains on, about.
SHARD = 4_000_000
END = U(0)  # no word hashes to the end but by chance


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(data: np.ndarray, offs: np.ndarray):
    """Hashes of all tokens (words with A-Z lower-cased, then END, of each text) and the tokens of each text."""
    h, seg, count = kernel.word_hashes(data, offs)
    size = count + 1
    out = np.full(int(size.sum()), END, U)
    out[np.arange(len(h)) + seg] = h
    return out, size


def _counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token stands in docs; each task adds up first."""

    def run(batches):
        for b in batches:
            parts = [tokens(data, offs)[0] for _, _, data, offs in common.chunks(b, "text")]
            if parts:
                h, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """hash, count: the known tokens sorted by hash; output: their place among the model's outputs (0: another token)."""

    hash: np.ndarray
    count: np.ndarray
    output: np.ndarray
    n_outputs: int
    total: int
    distinct: int
    rest_total: int
    rest_distinct: int

    def look(self, h: np.ndarray):
        """Index of each token among the known ones, -1 if it is none."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def outputs(self, at: np.ndarray):
        return np.where(at >= 0, self.output[at], 0) if len(self.hash) else np.zeros(len(at), np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals over all tokens, and the known ones: all with at least the least count that keeps them within KNOWN."""
    spread = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(KNOWN).collect()
    sums = counts.agg(F.sum("c").alias("t"), F.count("*").alias("v")).first()
    least, have = 1 << 62, 0
    for r in spread:
        if have + r["n"] > KNOWN:
            break
        least, have = r["c"], have + r["n"]
    rows = counts.where(F.col("c") >= least).toArrow()
    h = rows.column("h").to_numpy().astype(np.int64).view(U) if len(rows) else np.zeros(0, U)
    c = rows.column("c").to_numpy().astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    top = np.lexsort((h, -c))[:OUTPUTS]
    output = np.zeros(len(h), np.int64)
    output[top] = np.arange(1, len(top) + 1)
    total, distinct = sums["t"] or 0, sums["v"] or 0
    return Vocabulary(h, c, output, len(top) + 1, total, distinct, int(total - c[top].sum()), int(distinct - len(top)))


def _start(n: int):
    rng = np.random.default_rng(7)
    r, q = rng.normal(0, 0.1, (n, DIM)), rng.normal(0, 0.1, (n, DIM))
    return {"r": r, "q": q, "c": np.stack([np.full(DIM, 0.6), np.full(DIM, 0.4)]), "b": np.zeros((n, 1))}


def _unigram(v: Vocabulary) -> np.ndarray:
    p = np.zeros(v.n_outputs)
    known = v.output > 0
    p[v.output[known]] = v.count[known]
    p[0] = v.rest_total + v.rest_distinct + 1
    return (p + 1) / (p + 1).sum()


def contexts(out: np.ndarray, size: np.ndarray, end: int):
    """The two outputs before each token; END before a text's first."""
    u, v = np.empty_like(out), np.empty_like(out)
    u[1:], v[2:] = out[:-1], out[:-2]
    begin = np.cumsum(size) - size
    u[begin], v[begin] = end, end
    second = begin[size > 1] + 1
    v[second] = end
    return u, v


def nce_steps(par: dict, acc: dict, out, u, v, p: np.ndarray, rng, rate: float, batch: int = 2048, noise: int = 100) -> None:
    """One pass of noise-contrastive estimation over tokens, in place (Adagrad; acc: its sums of squares); a batch shares its noise."""
    n, cum = len(p), np.cumsum(p)
    for i in range(0, len(out), batch):
        w, a, z = out[i : i + batch], u[i : i + batch], v[i : i + batch]
        m = len(w)
        x = np.minimum(np.searchsorted(cum, rng.random(noise)), n - 1)
        ra, rz, qw, qx = par["r"][a], par["r"][z], par["q"][w], par["q"][x]
        h = ra * par["c"][0] + rz * par["c"][1]
        # b is kept relative to the unigram log-probability, so that the noise term cancels but for log(noise)
        dw = (h * qw).sum(1) + par["b"][w, 0] - np.log(noise)
        dx = h @ qx.T + par["b"][x, 0] - np.log(noise)
        gw = 1 / (1 + np.exp(np.clip(dw, -30, 30)))
        gx = -1 / (1 + np.exp(np.clip(-dx, -30, 30)))
        gh = gw[:, None] * qw + gx @ qx
        gq = gw[:, None] * h
        dr, dq, db = np.zeros_like(par["r"]), np.zeros_like(par["q"]), np.zeros_like(par["b"])
        for d in range(DIM):
            dr[:, d] = np.bincount(a, gh[:, d] * par["c"][0, d], n) + np.bincount(z, gh[:, d] * par["c"][1, d], n)
            dq[:, d] = np.bincount(w, gq[:, d], n)
        np.add.at(dq, x, gx.T @ h)
        db[:, 0] = np.bincount(w, gw, n)
        np.add.at(db[:, 0], x, gx.sum(0))
        dc = np.stack([(gh * ra).sum(0), (gh * rz).sum(0)])
        for name, g in (("r", dr), ("q", dq), ("b", db), ("c", dc)):
            acc[name] += g * g
            par[name] += rate * g / np.sqrt(acc[name])


def train(docs: DataFrame, v: Vocabulary, passes: int = 1, rate: float = 0.05) -> dict:
    """Parameters averaged over all shards, each weighted by its tokens. Every training text takes part, in the order of its hash."""
    p = _unigram(v)
    end = int(v.outputs(v.look(np.array([END], U)))[0])
    shared = docs.sparkSession.sparkContext.broadcast(v)
    names = ("r", "q", "c", "b")

    def run(batches):
        voc, par, seen = shared.value, _start(len(p)), 0
        acc = {name: np.full_like(par[name], 1e-6 if name != "c" else 1e4) for name in names}
        rng = np.random.default_rng(11)
        for b in batches:
            for _, _, data, offs in common.chunks(b, "text"):
                h, size = tokens(data, offs)
                out = voc.outputs(voc.look(h))
                a, z = contexts(out, size, end)
                for _ in range(passes):
                    nce_steps(par, acc, out, a, z, p, rng, rate)
                seen += len(out)
        if seen:
            for name in names:
                x = par[name].astype(np.float32)
                k = np.arange(x.size)
                yield pa.RecordBatch.from_arrays([pa.array([name] * x.size), pa.array(k), pa.array(x.ravel() * np.float64(seen)), pa.array(np.full(x.size, float(seen)))], ["name", "k", "x", "w"])

    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("at")).repartition(v.total // SHARD + 1, "at").sortWithinPartitions("at")
    rows = dealt.select("text").mapInArrow(run, "name string, k long, x double, w double")
    mean = rows.groupBy("name", "k").agg((F.sum("x") / F.sum("w")).alias("x")).toArrow()
    par = _start(len(p))
    name, k, x = mean.column("name").to_numpy(zero_copy_only=False), mean.column("k").to_numpy(), mean.column("x").to_numpy()
    for n in names:
        flat = par[n].ravel()
        mine = name == n
        flat[k[mine]] = x[mine]
        par[n] = flat.reshape(par[n].shape)
    return par


@dataclass
class Scorer:
    """s1[u, w] + s2[v, w] - z[u, v]: natural log-probability of output w after v, u (u the nearer)."""

    s1: np.ndarray
    s2: np.ndarray
    z: np.ndarray
    end: int


def scorer(par: dict, v: Vocabulary) -> Scorer:
    b = par["b"][:, 0] + np.log(_unigram(v))
    s1 = ((par["r"] * par["c"][0]) @ par["q"].T + b).astype(np.float32)
    s2 = ((par["r"] * par["c"][1]) @ par["q"].T).astype(np.float32)
    e1, m1 = np.exp(s1 - s1.max(1, keepdims=True)), s1.max(1)
    e2, m2 = np.exp(s2 - s2.max(1, keepdims=True)), s2.max(1)
    # sum over w of exp(s1[u, w] + s2[v, w]) for all contexts (u, v) by one matrix product
    z = np.log(e1.astype(np.float64) @ e2.astype(np.float64).T) + m1[:, None] + m2[None, :]
    return Scorer(s1, s2, z.astype(np.float32), int(v.outputs(v.look(np.array([END], U)))[0]))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of a probability).

    All texts are scored whole; those whose crc32(doc_id as text) mod 7 is 2 are not learnt from. A null or empty
    text is the one token 'end'. A null doc_id counts as not held out. Rows may repeat and then count repeatedly.
    Without training texts N = V = 0 and both scores are 0 (one unseen token type has all the probability).
    """
    base = docs.select("doc_id", "text")
    learnt = base.where(~held_out(F.col("doc_id")))
    counts = common.table(_counts(learnt), "counts")
    v = vocabulary(counts)
    model = scorer(train(learnt, v), v)
    sc = base.sparkSession.sparkContext
    shared = sc.broadcast((v, model))

    def run(batches):
        voc, m = shared.value
        norm, rest = np.log10(voc.total + voc.distinct + 1), np.log10(voc.rest_total + voc.rest_distinct + 1)
        log_c = np.log10(voc.count + 1.0)
        for b in batches:
            for i, j, data, offs in common.chunks(b, "text"):
                h, size = tokens(data, offs)
                at = voc.look(h)
                out = voc.outputs(at)
                a, z = contexts(out, size, m.end)
                lp = (m.s1[a, out] + m.s2[z, out] - m.z[a, z]).astype(np.float64) / np.log(10)
                known = at >= 0
                c = np.where(known, log_c[at], 0.0) if len(log_c) else np.zeros(len(at))
                lp += np.where(out == 0, c - rest, 0.0)
                doc = np.repeat(np.arange(len(size)), size)
                n = len(size)
                add = lambda x: np.bincount(doc, x, n)  # noqa: B023, E731
                other = ~known
                # tokens that are not known, each distinct one of a text once: (hash, times)
                order = np.lexsort((h[other], doc[other]))
                oh, od = h[other][order], doc[other][order]
                new = np.ones(len(oh), bool)
                new[1:] = (oh[1:] != oh[:-1]) | (od[1:] != od[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.r_[first, len(oh)])
                per = np.bincount(od[first], minlength=n)
                lists = np.r_[0, np.cumsum(per)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(add(known).astype(np.int64)),
                        pa.array(add(c) - size * norm), pa.array(add(lp)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(oh[first].view(np.int64))), pa.ListArray.from_arrays(pa.array(lists), pa.array(times.astype(np.int64))),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "hs", "times"],
                )

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, hs array<long>, times array<long>"
    part = base.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    part = common.table(part, "lm-parts")
    least = int(v.count.min()) if len(v.count) else 1 << 62
    rare = counts.where(F.col("c") < least)
    asked = part.select("row", F.explode(F.arrays_zip("hs", "times")).alias("t")).select("row", F.col("t.hs").alias("h"), F.col("t.times").alias("n"))
    more = asked.join(rare, "h").groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    zero = F.lit(0)
    return part.join(more, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )

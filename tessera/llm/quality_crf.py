"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Features are figures of a line and of its two neighbours, counted in numpy from bytes. Every line of a labelled text
takes the text's label in training (L2-regularised likelihood, forward-backward, Adam). A text's score is the mean
marginal of 'good' over its lines, weighted by their length, stretched so that the value which best parts the training
texts comes to CUT.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernel

#: Bounds of the training sample: labelled texts, and lines of a text that takes part.
SAMPLE = 3000
SAMPLE_LINES = 2000
#: Score from which a text counts as good.
CUT = 0.7
_CLASS = np.zeros((5, 256), bool)
_CLASS[0, 65:91] = True  # upper case
_CLASS[1, 97:123] = True  # lower case
_CLASS[2, 48:58] = True  # digits
_CLASS[3, [c for c in range(33, 127) if chr(c) in "#$%&*+/<=>@[\\]^_`{|}~"]] = True  # symbols
_CLASS[4, [ord("!"), ord("?")]] = True
N_BASE = 12


def line_features(data: np.ndarray, offs: np.ndarray):
    """(features of lines with their neighbours, text of each line, lines of each text, weight of each line)."""
    at, doc, per = kernel.lines(data, offs)
    start, end, seg, count = kernel.words(data, at)
    size = np.diff(at)
    f = np.zeros((len(doc), N_BASE), np.float32)
    solid = np.maximum(1, np.diff(np.r_[0, np.cumsum(kernel.solid(data))][at]))
    for k in range(5):
        f[:, k] = np.diff(np.r_[0, np.cumsum(_CLASS[k][data])][at]) / solid
    words = np.maximum(1, count)
    per_line = lambda mask: np.bincount(seg[mask], minlength=len(doc)) / words
    h = kernel.span_hash(kernel.prefix_hash(data), start, end)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (seg[1:] == seg[:-1])
    f[:, 5] = per_line(again)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    f[:, 6] = per_line(_CLASS[3][last])
    f[:, 7] = per_line(_CLASS[4][last])
    f[:, 8] = per_line((end - start == 1) & _CLASS[3][data[start]] if len(start) else np.zeros(0, bool))
    f[:, 9] = np.minimum(1, np.log1p(count) / 6)
    f[:, 10] = np.minimum(2, solid / words / 10)
    f[:, 11] = count == 0
    first = np.zeros(len(doc), bool)
    first[np.cumsum(per) - per] = True
    final = np.zeros(len(doc), bool)
    final[np.cumsum(per) - 1] = True
    prev, nxt = np.roll(f, 1, 0), np.roll(f, -1, 0)
    prev[first], nxt[final] = 0, 0
    return np.concatenate([f, prev, nxt, np.ones((len(doc), 1), np.float32)], 1), doc, per, np.maximum(size, 1e-6)


@dataclass
class Model:
    """w: weights of the features for label good; a: 2 x 2 transition scores (from, to); part: mean marginal that comes to CUT."""

    w: np.ndarray
    a: np.ndarray
    part: float = CUT


def marginals(e: np.ndarray, per: np.ndarray, a: np.ndarray, pairs: bool = False):
    """P(good) of each line, given line scores e, lines per text (each at least one) and transitions; pairs: also expected transitions."""
    order = np.argsort(-per, kind="stable")
    begin = (np.cumsum(per) - per)[order]
    length, t_max = per[order], int(per.max())
    active = np.searchsorted(-length, -np.arange(t_max), "left")  # texts longer than t
    active = np.array([int((length > t).sum()) for t in range(t_max)]) if t_max < 64 else active
    e = np.clip(e, -30, 30)
    psi = np.stack([np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))], 1)
    tr = np.exp(a - a.max())
    alpha = np.empty((len(e), 2))
    x = np.full((len(per), 2), 1.0)
    for t in range(t_max):
        n = active[t]
        at = begin[:n] + t
        x = (x[:n] if t == 0 else x[:n] @ tr) * psi[at]
        x = x / x.sum(1, keepdims=True)
        alpha[at] = x
    beta = np.ones((len(e), 2))
    xi = np.zeros((2, 2))
    for t in range(t_max - 1, 0, -1):
        n = active[t]
        at = begin[:n] + t
        y = psi[at] * beta[at]
        if pairs:
            j = alpha[at - 1][:, :, None] * tr[None] * y[:, None, :]
            xi += (j / j.sum((1, 2), keepdims=True)).sum(0)
        z = y @ tr.T
        beta[at - 1] = z / z.sum(1, keepdims=True)
    p = alpha * beta
    p = p[:, 1] / p.sum(1)
    return (p, xi) if pairs else p


def fit(x: np.ndarray, per: np.ndarray, label: np.ndarray, rounds: int = 80, l2: float = 1e-3) -> Model:
    """CRF fitted to texts whose lines all have the text's label; without both labels, weights of zero (mean marginal 0.5)."""
    w, a = np.zeros(x.shape[1]), np.zeros((2, 2))
    if len(set(label.tolist())) < 2:
        return Model(w, a)
    y = np.repeat(label, per).astype(float)
    # texts count alike whatever their number of lines
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (per[label == k] - 1).sum()
    theta, m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for i in range(1, rounds + 1):
        p, xi = marginals(x @ theta[:-4], per, theta[-4:].reshape(2, 2), pairs=True)
        g = np.concatenate([x.T @ (y - p), (seen - xi).ravel()]) / len(y) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def best_part(score: np.ndarray, label: np.ndarray) -> float:
    """The value with the fewest texts on its wrong side, in the middle of its gap."""
    order = np.argsort(score)
    s, y = np.r_[0, score[order], 1], label[order]
    wrong = np.r_[0, np.cumsum(y == 1)] + np.r_[np.cumsum((y == 0)[::-1])[::-1], 0]
    wide = np.where(wrong == wrong.min(), np.diff(s), -1)
    k = int(wide.argmax())
    return float(np.clip((s[k] + s[k + 1]) / 2, 0.05, 0.95))


def stretched(score: np.ndarray, part: float) -> np.ndarray:
    return np.where(score < part, score / part * CUT, CUT + (score - part) / (1 - part) * (1 - CUT))


def score_texts(data: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    x, doc, per, size = line_features(data, offs)
    p = marginals(x @ model.w, per, model.a)
    mean = np.bincount(doc, p * size, len(per)) / np.bincount(doc, size, len(per))
    return np.clip(stretched(mean, model.part), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model:
    """Model from at most ``sample`` labelled texts, those of the smallest hashes, outside the held-out quarter.

    Texts of more than ``sample_lines`` lines take no part. A doc_id with several labels has their rounded mean.
    """
    known = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
        .where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # bounded by ``sample`` rows
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y")

    def run(batches):
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            for i, _, data, offs in common.chunks(b, "text"):
                x, _, per, size = line_features(data, offs)
                begin = np.r_[0, np.cumsum(per)]
                for k in range(len(per)):
                    if per[k] <= sample_lines:
                        mine = slice(begin[k], begin[k + 1])
                        row = [[int(y[i + k])], [int(per[k])], [x[mine].astype("<f4").tobytes()], [size[mine].astype("<f8").tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["y", "per", "x", "size"])

    rows = texts.mapInArrow(common.released(run), "y long, per long, x binary, size binary").collect()
    rows.sort(key=lambda r: (r["per"], bytes(r["x"])))
    width = 3 * N_BASE + 1
    if not rows:
        return Model(np.zeros(width), np.zeros((2, 2)))
    x = np.concatenate([np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, width) for r in rows]).astype(np.float64)
    per, label = np.array([r["per"] for r in rows]), np.array([r["y"] for r in rows])
    model = fit(x, per, label)
    if model.w.any():
        size = np.concatenate([np.frombuffer(bytes(r["size"]), "<f8") for r in rows])
        doc = np.repeat(np.arange(len(rows)), per)
        mean = np.bincount(doc, marginals(x @ model.w, per, model.a) * size) / np.bincount(doc, size)
        model.part = best_part(mean, label)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row from its whole text: probability that label 1 holds.

    A null or empty text has one empty line and the score of that. Repeated rows stay; a null doc_id stays null.
    """

    def run(batches):
        for b in batches:
            for i, j, data, offs in common.chunks(b, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(score_texts(data, offs, model))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(common.released(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least threshold."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        for b in batches:
            for i, j, data, offs in common.chunks(b.rename_columns([f"c{k}" if k != at else "text" for k in range(b.num_columns)]), "text"):
                yield b.slice(i, j - i).filter(pa.array(score_texts(data, offs, model) >= threshold))

    return docs.mapInArrow(common.released(run), schema)

"""SentencePiece encoding and decoding by a weighted finite-state transducer in the tropical semiring.

The model file is compiled into three machines: the normaliser (white space to U+2581, dummy prefix), the pieces (a
trie whose final states emit ids, with byte fallback for characters no piece has) and, for BPE models, a context
machine over pairs of neighbouring symbols. A text is composed with them lazily and the shortest path is taken.

Unigram models put -score on the arcs. In a BPE model a segmentation is the library's exactly if merging any two of
its neighbours' characters alone gives these two symbols again, so the context machine weighs such a pair 0 and any
other infinity; its arcs are worked out when a text first needs them and remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, kernel
from .memo import SpanMemo, spread

MARK = "▁"
INF = float("inf")
#: Pairs whose weight a worker remembers.
PAIRS = 400_000
_MACHINES: dict[str, "Machine"] = {}


class Machine:
    """Compiled model; encode() and decode() agree with the library's ids and text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        if norm.precompiled_charsmap or kind not in (1, 2) or any(p.type in (4, 5) for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models without character map, user-defined or unused pieces are compiled")
        self.squeeze, self.dummy, self.bpe = norm.remove_extra_whitespaces, norm.add_dummy_prefix, kind == 2
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.pieces = [p.piece if p.type in (1, 2) else "" for p in model.pieces]
        self.pieces[self.unk] = " ⁇ "
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.name = list(self.pieces)  # by symbol: pieces, then characters without a piece
        self.other: dict[str, int] = {}
        self.pair: dict[int, bool] = {}
        self.memo = SpanMemo(self._new)
        self.low = min(self.score.values(), default=0.0) - 10.0
        # no piece crosses from another character to the mark, so paths never do
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.score)
        self.trie: dict = {}
        for i, p in enumerate(model.pieces):
            if p.type == 1 and (not self.bpe or self._merged(list(p.piece)) == [p.piece]):
                node = self.trie
                for c in p.piece:
                    node = node.setdefault(c, {})
                node[""] = i

    def _merged(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges, best score first, the leftmost among equals."""
        while len(symbols) > 1:
            best, at = -INF, -1
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _joined(self, a: int, b: int) -> bool:
        """Whether the context machine lets b follow a (weight 0) or not (infinity)."""
        key = a << 32 | b
        ok = self.pair.get(key)
        if ok is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            x, y = self.name[a], self.name[b]
            ok = self.pair[key] = self._merged([*x, *y]) == [x, y]
        return ok

    def _symbol(self, c: str) -> int:
        i = self.other.get(c)
        if i is None:
            i = self.other[c] = len(self.name)
            self.name.append(c)
        return i

    def _path(self, text: str) -> tuple[int, ...]:
        """Ids on the shortest path of a normalised text through the composed machine."""
        n, trie, bpe, joined, pair = len(text), self.trie, self.bpe, self._joined, self.pair
        # per position: state of the context machine -> (distance, position before, state before); one state without context
        states: list[dict | None] = [None] * (n + 1)
        states[0] = {-1: (0.0, -1, -1)}
        for j in range(n):
            here = states[j]
            if here is None:
                continue
            node, k, found = trie, j, False
            while k < n:
                node = node.get(text[k])
                if node is None:
                    break
                k += 1
                i = node.get("")
                if i is not None:
                    found = found or k == j + 1
                    self._relax(states, here, j, k, i, 0.0 if bpe else -self.score[self.pieces[i]])
            if not found:
                self._relax(states, here, j, j + 1, self._symbol(text[j]), 0.0 if bpe else -self.low)
        if not states[n]:
            raise ValueError("no path")
        at, ctx, out = n, min(states[n], key=lambda c: states[n][c][0]), []
        while at > 0:
            d, back, before = states[at][ctx]
            out.append(ctx if bpe else d[1])
            at, ctx = back, before
        ids: list[int] = []
        for s in reversed(out):
            if s < len(self.pieces):
                ids.append(s)
            elif self.byte:
                ids += [self.byte[b] for b in self.name[s].encode()]
            elif not ids or ids[-1] != self.unk:
                ids.append(self.unk)
        return tuple(ids)

    def _relax(self, states, here, j, k, symbol, weight):
        to = states[k]
        if to is None:
            to = {}
        if self.bpe:
            for ctx in here:
                if (ctx < 0 or self._joined(ctx, symbol)) and symbol not in to:
                    to[symbol] = (0.0, j, ctx)
        else:
            d = here[-1][0][0] if j else 0.0
            if -1 not in to or d + weight < to[-1][0][0]:
                to[-1] = ((d + weight, symbol), j, -1)
        if to:
            states[k] = to

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        text = self.normalise(text)
        units = _WORDS.findall(text) if self.by_word else [text] * bool(text)
        return [i for u in units for i in self._path(u)]

    def _unit(self, raw: str) -> str:
        """A unit of encode_many() as normalised text: \\x00 in front stands for the start of a text."""
        return (MARK if self.dummy else "") + raw[1:].replace(" ", MARK) if raw[0] == "\x00" else raw.replace(" ", MARK)

    def _new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        raw = data.tobytes()
        return spread([self._path(self._unit(raw[i:j].decode())) for i, j in zip(start.tolist(), end.tolist())])

    def encode_many(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[offs[i]:offs[i + 1]] one after another, and how many each has.

        Units are runs of spaces with what follows up to the next space; each distinct one is encoded once a worker.
        """
        size = np.diff(offs)
        raw = data.tobytes()
        plain = self.by_word and not self.squeeze and b"\xe2\x96\x81" not in raw and b"\x00" not in raw
        if not plain:
            ids = [self.encode(raw[i:j].decode()) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]
            return np.fromiter((y for x in ids for y in x), np.int32, sum(map(len, ids))), np.array([len(x) for x in ids], np.int64)
        # a \x00 before each text that isn't empty
        full = np.flatnonzero(size)
        wide = np.zeros(len(data) + len(full), np.uint8)
        doc = np.repeat(np.arange(len(full)), size[full])
        wide[np.arange(len(data)) + doc + 1] = data
        head = offs[:-1][full] + np.arange(len(full))
        space = wide == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[head] = True
        new[head[head + 1 < len(wide)] + 1] = False  # spaces at a text's start join the prefix's unit
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(wide)]
        h = kernel.span_hash(kernel.prefix_hash(wide), start, end)
        ids, n = self.memo.encode(h, wide, start, end)
        owner = full[np.searchsorted(head, start, "right") - 1]
        return ids, np.bincount(owner, n, len(size)).astype(np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the machine read from its output side, bytes joined, the dummy prefix dropped."""
        pieces, of_byte = self.pieces, self.of_byte
        ids = ids if isinstance(ids, list) else list(ids)
        if not of_byte.keys() & set(ids):
            text = "".join([pieces[i] for i in ids])
        else:
            parts, raw = [], bytearray()
            for i in ids:
                if i in of_byte:
                    raw.append(of_byte[i])
                else:
                    if raw:
                        parts.append(raw.decode("utf-8", "replace"))
                        raw.clear()
                    parts.append(pieces[i])
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
            text = "".join(parts)
        text = text.replace(MARK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


#: A run of marks with the word after it, or a word without a mark before it.
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def machine(path: str) -> Machine:
    """The compiled model, one for each worker."""
    if path not in _MACHINES:
        _MACHINES[path] = Machine(path)
    return _MACHINES[path]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, decoded, ids_crc32 (of the ids as little-endian unsigned 32-bit).

    A null or empty text has no ids and decodes to ''. decoded equals the text, but that U+2581 in it comes back as
    a space. Rows may repeat; a null doc_id stays null; only doc_id and text are read.
    """

    def run(batches):
        m = machine(model)
        for b in batches:
            for i, j, data, offs in common.chunks(b, "text"):
                flat, size = m.encode_many(data, offs)
                at = np.r_[0, np.cumsum(size)].astype(np.int32)
                raw = flat.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i), pa.array(size), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                        pa.array([m.decode(flat[x:y].tolist()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()),
                        pa.array([zlib.crc32(memoryview(raw[x:y])) for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(common.released(run), "doc_id long, n_tokens long, ids array<int>, decoded string, ids_crc32 long")

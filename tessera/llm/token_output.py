"""Token-ID output: Parquet list columns in ascending doc_id order, with page indexes and controlled row groups.

One folder holds files part-*: rows (doc_id long, part int, n_tokens int, tokens array<int>), each file a range of
doc_ids and sorted by doc_id. Ids are dictionary-encoded where that pays and else delta-encoded (writer version 2);
column and offset indexes let a reader fetch lengths, or the ids of a few documents, without the other pages.
"""

from __future__ import annotations

import os
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common, kernel
from .memo import SpanMemo

END = 1
WRITER = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts by the tokenizers library, asked once for each distinct word.

    Exact for tokenizers whose pre-tokens never cross white space and whose normaliser drops it, as the word BPE
    file has it: ids of a text are those of its words, one after another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo = SpanMemo(self._new)

    def _new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, a thousand at a time with spaces between; each token's offset tells its word."""
        width = end - start + 1
        to = np.cumsum(width)
        joined = np.full(int(to[-1]), 32, np.uint8)
        k = np.repeat(start - (to - width), width) + np.arange(len(joined))
        last = np.zeros(len(joined), bool)
        last[to - 1] = True
        joined[~last] = data[k[~last]]
        raw = joined.tobytes()
        chars = np.r_[0, np.cumsum((joined & 0xC0) != 0x80)]
        cuts = np.r_[0, to[999::1000][: (len(start) - 1) // 1000], to[-1]]
        parts, sizes = [], []
        done = self.tok.encode_batch([raw[i:j].decode() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())], add_special_tokens=False)
        for g, e in enumerate(done):
            mine = slice(1000 * g, 1000 * g + 1000)
            edge = chars[np.r_[cuts[g], to[mine]]] - chars[cuts[g]]
            where = np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e))
            sizes.append(np.diff(np.searchsorted(where, edge)))
            parts.append(np.array(e.ids, np.int32))
        return np.concatenate(parts), np.concatenate(sizes)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[offs[i]:offs[i + 1]] one after another, each text's followed by END; ids per text."""
        start, end, _, count = kernel.words(data, offs)
        # pre-tokens never cross from a letter to one of these signs either
        cut = np.flatnonzero(_SIGN[data[1:]] & _LETTER[data[:-1]]) + 1
        cut = cut[np.searchsorted(offs, cut, "right") == np.searchsorted(offs, cut - 1, "right")]
        start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
        doc = np.searchsorted(offs, start, "right") - 1
        # the tokenizer lower-cases, but for its special tokens, which are case-sensitive
        plain = b"<|" in data.tobytes()
        h = kernel.span_hash(kernel.prefix_hash(data if plain else kernel.lower(data)), start, end)
        ids, size = self.memo.encode(h, data, start, end)
        per = np.bincount(doc, size, len(count)).astype(np.int64) + 1
        out = np.full(int(per.sum()), END, np.int32)
        out[np.arange(len(ids)) + np.repeat(doc, size)] = ids
        return out, per


def encoder(path: str) -> WordEncoder:
    """One for each worker, with what it has seen."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for i, j, data, offs in common.chunks(b, "text"):
                ids, size = enc.encode(data, offs)
                offs = np.r_[0, np.cumsum(size)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids))],
                    ["doc_id", "part", "n_tokens", "tokens"],
                )

    return docs.mapInArrow(run, "doc_id long, part int, n_tokens int, tokens array<int>")


def write(docs: DataFrame, tokenizer: str, path: str, parts: int | None = None) -> None:
    """Encodes every whole text of docs (doc_id, text; null: empty) and writes the files to path.

    Each document ends with id 1. Rows with equal doc_id stay side by side, null doc_ids come first; an empty
    table gives files without rows. The ranges come from approximate quantiles of doc_id alone, so texts are
    encoded once and only ids are shuffled.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))[: parts - 1]
    part = F.lit(0)
    if cuts:
        known = F.array(*[F.lit(int(c)) for c in cuts])
        part = F.coalesce(F.size(F.filter(known, lambda c: c < F.col("doc_id"))), F.lit(0))
    rows = _encode(docs.select("doc_id", "text", part.cast("int").alias("part")), tokenizer)
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id")
    dealt.write.options(**WRITER).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, n_tokens int, tokens array<int>").parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Rows that share a doc_id (or have none) follow in the order of their checksum and length.
    """

    def run(batches):
        for b in batches:
            lists = b.column(2)
            offs = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(memoryview(flat[x:y])) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path)
    kind = T.StructType([T.StructField(c, T.IntegerType() if c == "part" else T.LongType()) for c in ("doc_id", "part", "n_tokens", "ids_crc32")])
    per = rows.select("doc_id", "part", "tokens").mapInArrow(run, kind)
    # lengths alone: one row per part, as many as there are files
    total = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("t"))
    before = total.select("part", (F.sum("t").over(W.orderBy("part")) - F.col("t")).alias("before"))
    inside = W.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    return per.join(before, "part").select(
        "doc_id", (F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"
    )

"""Corpus pipeline: operators of tessera.llm applied to documents one after another, with a table between them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, exact_dedup, ngram_join, quality_crf, sentencepiece_wfst

#: Score under which the quality stage rejects a text.
REJECT = 0.6


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, all columns. Null and empty texts are scored like any other; no row goes for its id."""
    return quality_crf.keep_good(docs, quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), REJECT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (null: empty), that of the smallest doc_id, all columns."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class linked by five-word shingles at 0.8; all columns.

    Rows that share a doc_id stay or go together; rows without one stay, as do null, empty and blank texts.
    """
    gone = ngram_join.classes(docs, n=5, num=80, den=100).where(F.col("doc_id") != F.col("component_id"))
    gone = common.table(gone.select(F.col("doc_id").alias("_gone")).distinct(), "near")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, all columns; rows that share a doc_id count as one text. An empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them; null counts as empty."""
    return sentencepiece_wfst.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("ids_crc32")


_LEFT: list[str] = []


def _tidy(stage):
    """stage, which first removes what the stage before it left in the shared folder, unless its docs still read that."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _LEFT and not any(path.rsplit("/", 1)[1] in file for file in docs.inputFiles() for path in _LEFT):
            for path in _LEFT:
                common.remove(spark, path)
            _LEFT.clear()
            common.free(spark)
        common.small_batches(spark)
        before = len(common.CREATED)
        out = stage(spark, docs, sf_dir)
        _LEFT.extend(common.CREATED[before:])
        return out

    return run_stage


STAGES = [
    ("quality classifier", _tidy(quality)),
    ("exact dedup", _tidy(exact)),
    ("n-gram Jaccard join", _tidy(near)),
    ("benchmark decontamination", _tidy(clean)),
    ("SentencePiece encoding and decoding", _tidy(encode)),
]

#: Trained scores and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result but the last is written to the shared folder and read back."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.table(docs, f"stage{k}")
    return docs

"""Registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, exact_dedup, html_extract, lbl_model, line_dedup, ngram_join, quality_crf, sentencepiece_wfst, suffix_dedup, token_output
from .common import documents

#: Score from which op2 predicts label 1.
GOOD = 0.7


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score(docs, model).select(
        "doc_id", quality_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_wfst.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    token_output.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_output.digests(spark, path)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.pages_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_model.lm_scores(documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir), n=4, num=85, den=100)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_crf": op2_quality_crf,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_output": op4_token_output,
    "op5_html_extract": op5_html_extract,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

#: DuckDB's regular expressions have no \\x20 class problem: the class is spelled out.
_NORMAL = "regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
with d as (select doc_id, {_NORMAL} as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
""",
    "op8_decontaminate": decontaminate.LEAKS_SQL,
}

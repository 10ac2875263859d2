"""Verification: normal forms without ids, multiset differences, expectations, byte anchors and SQL checks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalised_symbols(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Symbols by name, kind and linkage with the number of their declarations and definitions; duplicates stay."""
    seen = occurrences.groupBy(F.col("symbol_id").alias("id")).agg(F.count_if(F.col("role") == 0).alias("declarations"), F.count_if(F.col("role") == 1).alias("definitions"))
    zero = F.lit(0).cast("bigint")
    return symbols.join(seen, "id", "left").select("kind", "qualified_name", "linkage", F.coalesce("declarations", zero).alias("declarations"), F.coalesce("definitions", zero).alias("definitions"))


def normalised_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    name = symbols.select(F.col("id").alias("_i"), F.col("qualified_name").alias("_n"))
    a, b = name.select(F.col("_i").alias("source_id"), F.col("_n").alias("source")), name.select(F.col("_i").alias("target_symbol"), F.col("_n").alias("target"))
    return edges.join(a, "source_id").join(b, "target_symbol").select("kind", "source", "target", "resolution", "dispatch")


def semantic_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side beyond the other's, with their multiplicity: side '-' expected only, '+' actual only."""
    cols = expected.columns
    n = lambda df, s: df.groupBy(*cols).agg(F.lit(s).cast("bigint").alias("s"), F.count("*").alias("k")).select(*cols, (F.col("s") * F.col("k")).alias("d"))
    both = n(expected, -1).union(n(actual.select(*cols), 1)).groupBy(*cols).agg(F.sum("d").alias("d"))
    return both.where("d <> 0").select(*cols, F.when(F.col("d") > 0, "+").otherwise("-").alias("side"), F.abs("d").alias("times"))


def find_symbols(rows: DataFrame, name: str = "", kind: int | None = None) -> DataFrame:
    out = rows.where(F.col("qualified_name") == name) if name else rows
    return out if kind is None else out.where(F.col("kind") == kind)


def find_relationships(rows: DataFrame, source: str = "", kind: int | None = None, target: str = "") -> DataFrame:
    for c, v in (("source", source or None), ("kind", kind), ("target", target or None)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows


def unmet(expectations: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expectations (keys, count) whose number of actual rows differs, with what was found."""
    have = actual.groupBy(*keys).agg(F.count("*").alias("found"))
    found = F.coalesce("found", F.lit(0).cast("bigint"))
    return expectations.join(have, keys, "left").where(found != F.col("count")).select(*keys, "count", found.alias("found"))


def _bytes(text: pa.Array):
    """Bytes of a batch of texts, where each begins (and the last ends), and where its newlines are; null counts as empty."""
    text = text.fill_null("").cast(pa.large_binary())
    begin = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: begin[-1]]
    return begin, np.flatnonzero(data[begin[0] :] == 10) + begin[0]


def line_ends(texts: DataFrame) -> DataFrame:
    """Anchors (file_id, offset) of texts (file_id, text): each newline, and the end; of a null text 0."""
    def run(batches):
        for b in batches:
            begin, lf = _bytes(b.column("text"))
            doc = np.searchsorted(begin, lf, "right") - 1
            rows = np.r_[doc, np.arange(len(begin) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(pa.array(rows)), pa.array(np.r_[lf - begin[doc], np.diff(begin)])], ["file_id", "offset"])

    return texts.select(F.col("file_id").cast("bigint"), "text").mapInArrow(run, "file_id long, offset long")


def positions(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (file_id, offset) with line and column (from 1) counted over the bytes of texts (file_id, text).

    A text is scanned once for all its anchors. Offsets beyond its ends count as the ends; a null text or offset has no position.
    """
    def run(batches):
        for b in batches:
            text, at = b.column("text"), b.column("at")
            begin, lf = _bytes(text)
            rows = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
            offset = at.flatten().field(0)
            lost = np.array(offset.is_null()) | np.array(text.is_null())[rows]
            place = begin[rows] + np.clip(offset.fill_null(0).to_numpy(), 0, np.diff(begin)[rows])
            before, first = np.searchsorted(lf, place), np.searchsorted(lf, begin[rows])
            last = np.where(before > first, np.r_[0, lf][before], begin[rows] - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("file_id").take(pa.array(rows)), offset, pa.array(before - first + 1, mask=lost), pa.array(place - last, mask=lost)], ["file_id", "offset", "line", "column_no"]
            )

    at = anchors.groupBy(F.col("file_id").cast("bigint").alias("_f")).agg(F.collect_list(F.struct(F.col("offset").cast("bigint").alias("offset"))).alias("at"))
    both = texts.join(at, F.col("file_id").eqNullSafe(F.col("_f"))).select(F.col("file_id").cast("bigint"), "text", "at")
    return both.mapInArrow(run, "file_id long, offset long, line long, column_no long")


def sql_check(spark, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Runs one SELECT or WITH over model tables; anything else is refused."""
    if not re.match(r"\s*(select|with)\b", sql, re.I):
        raise ValueError("only SELECT and WITH statements are audited")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)

"""Line dedup: lines that repeat, exactly or nearly, an earlier line of the corpus are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, setjoin


def line_dedup(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, **split: int) -> DataFrame:
    """One row per document: doc_id, text (what stays), n_lines, n_removed, kept_sha256.

    Lines are what \\n separates. Each line's tokens are its distinct n-word shingles (fewer words: the whole
    sequence as one), ordered by rarity for the prefix filter. A line goes when an earlier line, by (doc_id, line
    number), has Jaccard similarity of num / den or more, whether or not that earlier line stays itself. Lines
    without words always stay. A null text counts as empty and gives ''; a null doc_id comes before all others.
    Rows that share a doc_id count as one place: their equal lines of one number don't remove each other, and a
    number that goes for one of them goes for all. Other columns are not read.
    split: setjoin.Spec's often, large and tile.
    """
    spec = setjoin.Spec(n, num, den, by_line=True, orders=1, bits=128, **split)
    base = docs.select("doc_id", "text")
    scanned = common.table(setjoin.scan(base, spec), "lines")
    units = setjoin.units_of(scanned).where("n > 0")
    at = F.struct(F.coalesce("doc_id", F.lit(setjoin.NOWHERE)).alias("d"), "line")
    places = common.table(units.groupBy("u").agg(F.min(at).alias("at"), F.first("sketch").alias("sketch")).select("u", "at.d", "at.line", "sketch"), "places")
    found = setjoin.links(base, spec, scanned, places, by_rank=True)
    late = found.select(F.col("a").alias("u")).distinct().withColumn("late", F.lit(True))
    first = places.join(late, "u", "left").select("u", F.struct("d", "line").alias("first"), "late")
    gone = (
        units.join(first.hint("shuffle_hash"), "u").where(F.col("late").isNotNull() | (at != F.col("first")))
        .groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.col("line").cast("int")).alias("gone"))
    )
    # gone has one row per document: it is hashed, the texts aren't sorted
    gone = gone.hint("shuffle_hash")
    return _strip(base.join(gone, base["doc_id"].eqNullSafe(gone["_d"]), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "gone"))


def _strip(df: DataFrame) -> DataFrame:
    """Texts without the lines whose numbers are in gone."""
    # columns of their own, as a lambda would split the text again for each line; only a text that loses lines is split
    df = df.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    # what stays, in order: the sets of numbers are compared by hash
    df = df.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda k: F.get("lines", k)), "\n"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("lines") - F.size("left"))
    df = df.select("doc_id", kept.alias("text"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
    return df.withColumn("kept_sha256", F.sha2("text", 256))

"""Exact dedup as a stateful stream, with DataFrame functions only.

A first pass writes what arrives: digest, doc_id and content locator (file and row) of every document. A Structured
Streaming aggregation over it keeps, per digest, the row that stays and the number of rows, in a RocksDB state store
under the query's checkpoint in the shared folder, without expiry. The state is then read back as a table. Rows that
hit a digest seen before have their full bytes compared with the content the locator names; texts that differ under
one digest are told apart by those bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACES = "[\\x20\\x09-\\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one group that are compared in one task at most, about.
SALT_ROWS = 500


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _located(docs: DataFrame) -> DataFrame:
    """docs with the locator of each row: file and row number; docs that don't come straight from files are written first."""
    def at(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("doc_id", "text", meta["file_path"].alias("file"), meta["row_index"].alias("row"))

    try:
        return at(docs)
    except AnalysisException:
        return at(common.table(docs.select("doc_id", "text"), "content"))


def _state(spark, arrivals: str, schema, files_per_batch: int) -> DataFrame:
    """(digest, first struct<none, doc_id, file, row>, n) of all arrivals, from the stream's state store."""
    # without fallocate, or each store sets 4 MB aside for its manifest
    ours = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    old = {key: spark.conf.get(key, None) for key in ours}
    for key, value in ours.items():
        spark.conf.set(key, value)
    ckpt = common.new_path(spark, "dedup-state")
    try:
        seen = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
            .groupBy("digest")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("first"), F.count("*").alias("n"))
        )
        query = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    state = spark.read.format("statestore").load(ckpt)
    value = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("first"), F.col(f"value.`{value[1]}`").alias("n")
    )


def groups(docs: DataFrame, digest: Callable[[Column], Column] | None = None, files_per_batch: int = 1000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the locator file, row.

    Texts are equal when identical after replacing each run of [\\x20\\x09-\\x0D] by one space; null counts as empty.
    Of equal texts the row with the smallest doc_id stays (a null doc_id comes last); among rows that share it, the
    one at the smallest locator. An empty table gives no rows. Only doc_id and text are read, so further columns may
    have any name. digest (text -> string) is SHA-256 unless given; whatever it is, the bytes decide.
    """
    spark = docs.sparkSession
    located = _located(docs)
    text = normalised(F.col("text"))
    sha = F.sha2(text, 256)
    arrived = common.new_path(spark, "arrivals")
    arrivals = located.select("doc_id", "file", "row", sha.alias("sha"), (digest(text) if digest else sha).alias("digest"))
    arrivals.write.option("compression", "zstd").parquet(arrived)
    rows = spark.read.schema(arrivals.schema).parquet(arrived)
    state = common.table(_state(spark, arrived, arrivals.schema, files_per_batch), "state")
    several = common.table(rows.join(state.where("n > 1"), "digest"), "several")
    is_first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    # the full bytes of all rows that share a digest, each beside its keeper's
    hits = common.table(
        located.select("file", "row", normalised(F.col("text")).alias("text"))
        .join(several.select("file", "row", "doc_id", "sha", "digest", "first", "n").hint("merge"), ["file", "row"]),
        "hits",
    )
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    keeper = hits.where(is_first).select(
        "digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    member = hits.where(~is_first).withColumn("salt", F.pmod(F.xxhash64("file", "row"), salts).cast("int"))
    differ = member.join(keeper, ["digest", "salt"]).where("text <> kept_text").select("digest").distinct()
    differ = common.table(differ, "differ")
    single = rows.join(state.where("n = 1").select("digest"), "digest", "left_semi").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"), "file", "row",
    )
    out = ["doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), is_first.alias("kept"), F.col("sha").alias("text_sha256"), "file", "row"]
    if differ.isEmpty():
        return single.union(several.select(*out))
    apart = hits.join(differ, "digest", "left_semi")
    told = common.table(
        apart.groupBy("digest", "text").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("first"), F.count("*").alias("n")
        ),
        "told",
    )
    return (
        single.union(several.join(differ, "digest", "left_anti").select(*out))
        .union(apart.drop("first", "n").join(told, ["digest", "text"]).select(*out))
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    try:
        meta = docs.metadataColumn("_metadata")
        src = docs
    except AnalysisException:
        src = common.table(docs, "content")
        meta = src.metadataColumn("_metadata")
    gone = groups(src).where("not kept").select(F.col("file").alias("_gone_file"), F.col("row").alias("_gone_row"))
    gone = common.table(gone, "gone")
    return src.join(gone, (meta["file_path"] == gone["_gone_file"]) & (meta["row_index"] == gone["_gone_row"]), "left_anti")

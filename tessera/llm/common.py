"""Shared helpers of the corpus operators: scratch tables, Arrow text access, fixed-size bitmaps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: All fresh paths, in order of their creation.
CREATED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p)
    CREATED.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark removes the shuffle files of a query at its end, not at some garbage collection of the driver.
REMOVES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors. The shuffle files of the
    write go at its end, as only the table is read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(REMOVES, None)
    spark.conf.set(REMOVES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(REMOVES) if before is None else spark.conf.set(REMOVES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what table() has written, once nothing that is still to run reads it."""
    remove(df.sparkSession, df._scratch_path)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that are no longer referred to; else it waits for a garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def released(run):
    """run for mapInArrow; at its end the worker gives freed memory back to the system. Workers stay, idle, beside all later stages."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


#: Rows and bytes of an Arrow batch; a batch is held several times over on its way.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch to BATCH_ROWS and BATCH_BYTES, unless they are fewer."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(spark.conf.get(key).removesuffix("b"))
        except ValueError:  # given with another unit
            now = 0
        if not 0 < now <= most:
            spark.conf.set(key, most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bitmap(df: DataFrame, col: str, bits: int) -> np.ndarray:
    """Bytes of a bitmap of 2**bits bits with bit (col mod 2**bits) set for every row.

    Its size is fixed by ``bits`` whatever the input, so it may be collected and broadcast.
    """
    mask = (1 << bits) - 1
    pos = F.col(col).bitwiseAND(F.lit(mask).cast("long")) + 1
    rows = (
        df.where(F.col(col).isNotNull())
        .select(pos.alias("p"))
        .groupBy(F.expr("bitmap_bucket_number(p)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
        .collect()
    )
    size = 1 << max(bits - 3, 12)
    out = np.zeros(size, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at : at + len(r["m"])] |= np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def in_bitmap(bm: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    pos = values.astype(np.uint64) & np.uint64((1 << bits) - 1)
    return (bm[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 != 0


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    if len(offs) == 0:
        offs = np.zeros(1, np.int64)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = 250_000):
    """Yields (first row, end row, bytes, offsets) over runs of rows of about ``limit`` bytes, whose arrays stay in a core's cache; a longer
    text comes alone and whole."""
    data, offs = utf8(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j

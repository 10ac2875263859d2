"""Atomic Parquet snapshots: a version folder per publication and a pointer that names the current one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 4


class NoSnapshot(ValueError):
    """There is no snapshot yet; one of another schema is a plain ValueError."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside path and renames it over path."""
    tmp, fs = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    final, _ = _fs(spark, path)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename.getField("OVERWRITE").get(None)
    context.rename(tmp, final, options)


def _get(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    return spark.sparkContext.wholeTextFiles(path).values().first()


def publish(tables: dict[str, DataFrame], path: str, validate: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> str:
    """Writes tables as a new version, reads them back, compares, and only then moves the pointer; returns the version.

    If validate finds an issue or a table reads back differently, the version is removed, the old one stays, and ValueError says why.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v={uuid.uuid4().hex}"
    try:
        if validate is not None and (issue := validate(tables).first()) is not None:
            raise ValueError(f"snapshot is not valid: {tuple(issue)}")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{version}/{name}")
        for name, df in tables.items():
            back = spark.read.parquet(f"{path}/{version}/{name}")
            if not df.exceptAll(back).isEmpty() or not back.exceptAll(df).isEmpty():
                raise ValueError(f"table {name} reads back differently")
        _put(spark, f"{path}/current", json.dumps({"version": version, "schema": SCHEMA_VERSION, "tables": sorted(tables)}))
    except BaseException:
        p, fs = _fs(spark, f"{path}/{version}")
        fs.delete(p, True)
        raise
    return version


def checkpoint(tables: dict[str, DataFrame], path: str) -> str:
    """publish() without validation."""
    return publish(tables, path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of the current version; NoSnapshot if there is none, ValueError if its schema is another."""
    text = _get(spark, f"{path}/current")
    if text is None:
        raise NoSnapshot("no snapshot")
    meta = json.loads(text)
    if meta["schema"] != SCHEMA_VERSION:
        raise ValueError(f"snapshot has schema {meta['schema']}, not {SCHEMA_VERSION}")
    return {name: spark.read.parquet(f"{path}/{meta['version']}/{name}") for name in meta["tables"]}


def remove(spark: SparkSession, path: str) -> None:
    """Removes a snapshot with all its versions, if there is one."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)

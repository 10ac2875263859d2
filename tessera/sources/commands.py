"""Compilation databases, target manifests, fixture manifests and file contents as DataFrames."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

ENTRY = "directory string, file string, arguments array<string>, command string"
#: Target kinds as manifests write them, by ordinal.
TARGET_KINDS = {"executable": 1, "static-library": 2, "shared-library": 3, "object-library": 4, "test": 5}
FIXTURE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("language", T.StringType()), T.StructField("standard", T.StringType()),
    *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("sources", "include_paths", "defines", "compiler_arguments")],
    T.StructField("expect", T.StructType([
        T.StructField("translation_units", T.LongType()), T.StructField("failed_translation_units", T.LongType()),
        T.StructField("symbols", T.ArrayType(T.StructType([T.StructField("qualified_name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("count", T.LongType()), T.StructField("declarations", T.LongType()), T.StructField("definitions", T.LongType())]))),
        T.StructField("relationships", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("target", T.StringType()), T.StructField("count", T.LongType())]))),
    ])),
])


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """One row per distinct command: directory, source, compiler, arguments, semantic (arguments that bear on meaning), settings, configuration, invocation.

    arguments win over command; an entry without directory, file or any argument is an error, as is text that is no JSON array of objects.
    """
    raw = spark.read.schema(ENTRY + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    wrong = F.col("_corrupt").isNotNull() | F.col("directory").isNull() | F.col("file").isNull() | (F.col("arguments").isNull() & F.col("command").isNull())
    raw = raw.select(F.when(wrong, F.raise_error("malformed compilation database entry")).otherwise(F.col("directory")).alias("directory"), "file", "arguments", "command")
    args = F.when(F.col("arguments").isNotNull(), F.col("arguments")).otherwise(X.split_command(F.col("command")))
    return interpret_commands(raw.select("directory", "file", args.alias("arguments")))


@F.pandas_udf(T.StructType([T.StructField("driver", T.IntegerType()), T.StructField("source", T.StringType())]))
def _place(arguments: pd.Series, directory: pd.Series, file: pd.Series) -> pd.DataFrame:
    for a in arguments:
        if not len(a):
            raise ValueError("a compile command has no arguments")
    return pd.DataFrame({"driver": [X.driver_position(list(a)) for a in arguments], "source": [X.normal_path(f, d) for d, f in zip(directory, file)]})


def interpret_commands(raw: DataFrame) -> DataFrame:
    """raw (directory, file, arguments) with what the arguments mean and digests of configuration and invocation."""
    at = raw.withColumn("p", _place("arguments", "directory", "file")).select("directory", "arguments", "p.driver", "p.source")
    compiler = F.get("arguments", F.col("driver"))
    tail = F.slice("arguments", F.col("driver") + 2, F.size("arguments"))
    at = at.select("directory", "source", compiler.alias("compiler"), "arguments", X.semantic_arguments(tail, F.col("directory"), F.col("source"), compiler).alias("semantic"))
    keyed = lambda c: F.aggregate(c, F.lit("").cast("string"), lambda acc, x: F.concat(acc, X.append_key(x)))
    at = at.withColumn("settings", X.interpret("semantic", "directory", "source"))
    config = F.sha2(F.concat(F.lit("configuration|"), X.append_key(F.col("compiler"), F.col("settings.language").cast("string")), keyed(F.col("semantic"))), 256)
    call = F.sha2(F.concat(F.lit("invocation|"), X.append_key(F.col("directory"), F.col("compiler")), keyed(F.col("arguments"))), 256)
    return at.withColumns({"configuration": config, "invocation": call}).dropDuplicates(["source", "configuration", "invocation"])


def read_manifest(spark: SparkSession, path: str, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, memberships, dependencies) of a '|'-separated manifest; units (tu_id, path) are its members.

    Blank lines and '#' comments don't count, CRLF does no harm. Any other record, an unknown kind, target or member, or a
    repeated target is an error once its table is read.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("v")).where("v <> '' and not startswith(v, '#')")
    f = F.split("v", "\\|")
    rec = lines.select("v", F.trim(F.get(f, F.lit(0))).alias("r"), F.trim(F.get(f, F.lit(1))).alias("a"), F.trim(F.get(f, F.lit(2))).alias("b"), F.size(f).alias("n"))
    bad = (F.col("n") != 3) | ~F.col("r").isin("target", "member", "depends")
    rec = rec.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("malformed manifest record: "), F.col("v")))).otherwise(F.col("r")))
    kinds = F.create_map(*[x for k, v in TARGET_KINDS.items() for x in (F.lit(k), F.lit(v))])
    kind = F.coalesce(F.try_element_at(kinds, F.col("b")), F.raise_error(F.concat(F.lit("unknown target kind: "), F.col("b"))))
    targets = rec.where("r = 'target'").groupBy("a").agg(F.count("*").alias("k"), F.min("b").alias("b"))
    name = F.when(F.col("k") > 1, F.raise_error(F.concat(F.lit("repeated target: "), F.col("a")))).otherwise(F.col("a"))
    targets = targets.select(X.digest("build-target", F.col("a")).alias("id"), name.alias("name"), kind.cast("int").alias("kind"), F.lit(True).alias("topology_authoritative"))
    known = targets.select(F.col("name").alias("a"), "id")
    must = lambda c, what: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.col("a"))))
    members = (
        rec.where("r = 'member'").join(known, "a", "left").join(units.select(F.col("path").alias("b"), "tu_id"), "b", "left")
        .select(must("id", "target").alias("target_id"), must("tu_id", "member of").alias("tu_id")).distinct()
    )
    on = known.select(F.col("a").alias("b"), F.col("id").alias("dep"))
    depends = rec.where("r = 'depends'").join(known, "a", "left").join(on, "b", "left").select(must("id", "target").alias("consumer_id"), must("dep", "dependency of").alias("dependency_id")).distinct()
    return targets, members, depends


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash, size) of whole files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixture manifests below a folder, by category and name; malformed or nameless ones are an error."""
    rows = spark.read.schema(FIXTURE).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "fixture.json").json(path)
    good = F.col("name").rlike("^[a-z][a-z0-9_]*$") & (F.size("sources") > 0)
    return rows.withColumn("name", F.when(good, F.col("name")).otherwise(F.raise_error("malformed fixture manifest"))).orderBy("category", "name")


def read_expectations(path: str) -> list[dict]:
    """Checks of an audit specification: name, sql, and expected rows or the least number of rows."""
    import json

    with open(path) as f:
        checks = json.load(f)["checks"]
    for c in checks:
        if "sql" not in c or not ({"expected", "min_rows"} & set(c)):
            raise ValueError(f"malformed check: {c.get('name')}")
    return checks


def below(path: str, root: str) -> bool:
    p = posixpath.normpath(path)
    return p == root or p.startswith(root.rstrip("/") + "/")

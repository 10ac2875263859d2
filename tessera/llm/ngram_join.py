"""N-gram Jaccard join: documents linked by word n-gram sets, under several global token orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, setjoin


def classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, orders: int = 2, **split: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when den * |A and B| >= num * |A or B| of their sets of distinct n-word shingles, words
    being runs without [\\x20\\x09-\\x0D] with A-Z lower-cased. A text of fewer than n words has its whole sequence
    as the one shingle; one that is null, empty or blank has an empty set and links with nothing. Repeated rows
    keep their rows and share a component. A null doc_id keeps its row and its links, is never a component's id, and if
    all of a class have none the component is null. Only doc_id and text are read, so other columns may have any name.
    split: setjoin.Spec's often, large and tile.
    """
    spec = setjoin.Spec(n, num, den, orders=orders, **split)
    scanned = common.table(setjoin.scan(docs, spec), "units")
    units = setjoin.units_of(scanned)
    places = units.where("n > 0").groupBy("u").agg(F.min("doc_id").alias("low"), F.first("sketch").alias("sketch"))
    places = common.table(places.withColumns({"d": F.coalesce("low", F.lit(setjoin.NOWHERE)), "line": F.lit(0).cast("long")}), "places")
    found = setjoin.links(docs, spec, scanned, places)
    parts = graph.connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "u")
    named = common.table(places.select("u", "low").join(parts, "u", "left").withColumn("component", F.coalesce("component", "u")), "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.select("u", "component").join(least, "component").select("u", "component_id")
    return units.join(named, "u", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )

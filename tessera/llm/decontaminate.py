"""Benchmark decontamination: short test items inside long documents, with DataFrame functions only.

Items are sketched by MinHash: an item of n shingles keeps the k(n) = n - ceil(t n) + 1 smallest hashes of its
shingles. A document that contains a share t of the item's shingles must hold one of these, however long it is, so a
probe with the sketch alone misses nothing. Documents are partitioned by the size of their shingle sets (powers of
two); an item probes only the partitions whose sets are large enough to contain t of it. Candidates are verified by
exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

N = 5


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def shingles(w: Column, n: int = N) -> Column:
    """Hashes of all runs of n words; none if there are fewer."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))


def shingled(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, hs). The words are a column of their own, so that they are split once and not for every shingle.

    Users explode hs by explode_outer: explode() would have a filter on the size of hs pushed below, words and all.
    """
    return df.select(key, words(F.col("text")).alias("w")).select(key, shingles(F.col("w"), n).alias("hs"))


def _class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def leaks(docs: DataFrame, items: DataFrame, t_num: int = 80, t_den: int = 100, n: int = N) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): all pairs where the document holds t_num / t_den or more of the item's
    distinct n-word shingles.

    A null text counts as empty. Texts and items of fewer than n words have no shingles and match nothing. Rows with
    a null doc_id or item_id keep it as one more id; rows that share an id count as one text each way: the document
    side takes the union of their shingles, the item side too. Only doc_id, item_id and text are read.
    """
    item = shingled(items, "item_id", n).select("item_id", F.explode_outer("hs").alias("h")).where("h is not null").distinct()
    sized = item.groupBy("item_id").agg(F.count("*").alias("n_item")).withColumnRenamed("item_id", "i")
    item = common.table(item.join(sized, F.col("item_id").eqNullSafe(F.col("i"))).drop("i"), "items")
    need = F.floor((F.lit(t_num) * F.col("n_item") + (t_den - 1)) / t_den)
    ranked = item.groupBy("item_id", "n_item").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    sketch = common.table(
        ranked.select("item_id", _class(need).alias("least"), F.explode(F.slice("hs", F.lit(1), (F.col("n_item") - need + 1).cast("int"))).alias("h")),
        "sketch",
    )
    probe = shingled(docs, "doc_id", n).select("doc_id", _class(F.size("hs")).alias("size_class"), F.explode_outer("hs").alias("h"))
    # coalesced: a filter on size_class alone would be pushed below the split into words
    big = F.coalesce(F.col("size_class"), F.lit(0)) >= F.coalesce(F.col("least"), F.lit(0))
    hits = probe.join(sketch, "h").select("doc_id", "item_id", big.alias("big")).distinct()
    # the size of one row says nothing of a text of several
    several = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("r"), F.lit(True).alias("several"))
    held_in = hits.join(several, F.col("doc_id").eqNullSafe(F.col("r")), "left").where(F.col("big") | F.coalesce("several", F.lit(False)))
    found = common.table(held_in.select("doc_id", "item_id").distinct(), "leaks")
    suspects = found.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(suspects.withColumnRenamed("doc_id", "s"), F.col("doc_id").eqNullSafe(F.col("s")), "left_semi")
    held = (
        shingled(texts, "doc_id", n).select("doc_id", F.explode_outer(F.array_distinct("hs")).alias("h")).join(item, "h")
        .groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("h").alias("n_shared"))
    )
    pairs = found.withColumnsRenamed({"doc_id": "d", "item_id": "i"})
    return held.where(F.col("n_shared") * t_den >= F.col("n_item") * t_num).join(
        pairs, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi"
    ).select("doc_id", "item_id", "n_item", "n_shared")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    bad = common.table(leaks(docs, items).select(F.col("doc_id").alias("_bad")).distinct(), "bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


#: leaks() over documents and benchmark, for DuckDB.
LEAKS_SQL = """
with d as (
    select doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from documents
), i as (
    select item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from benchmark
), ds as (
    select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d)
), its as (
    select distinct item_id, array_to_string(w[k:k + 4], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 3)) as k from i)
), sized as (select item_id, count(*) as n_item from its group by item_id)
select ds.doc_id, its.item_id, any_value(n_item) as n_item, count(*) as n_shared
from ds join its using (s) join sized on sized.item_id = its.item_id
group by ds.doc_id, its.item_id having count(*) * 100 >= any_value(n_item) * 80
"""

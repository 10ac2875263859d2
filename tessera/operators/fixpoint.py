"""Semi-naive fixpoints: reachability, reachability by source, and peeling of acyclic parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import table


def reachable(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(id): all nodes that (src, dst) edges reach from seeds (id), seeds included. hops joins are done for each written round."""
    edges = table(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    front = table(seeds.select("id").where("id is not null").distinct(), "front")
    seen = front
    while not front.isEmpty():
        step, found = front, None
        for _ in range(hops):
            step = step.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
            found = step if found is None else found.union(step)
        front = table(found.distinct().join(seen, "id", "left_anti"), "front")
        seen = seen.union(front)
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): all pairs joined by one edge or more, by doubling; cycles end as nothing new comes."""
    base = table(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "closure")
    seen, new = base, base
    while not new.isEmpty():
        right = seen.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        left = seen.select("src", F.col("dst").alias("mid"))
        fresh_r = new.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        fresh_l = new.select("src", F.col("dst").alias("mid"))
        found = fresh_l.join(right, "mid").union(left.join(fresh_r, "mid")).select("src", F.col("to").alias("dst")).distinct()
        new = table(found.join(seen, ["src", "dst"], "left_anti"), "closure")
        seen = seen.union(new)
    return seen


def propagate(copies: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value) closed over copies (src, dst): a value at src is one at dst."""
    copies = table(copies.select("src", "dst").distinct(), "copies")
    new = table(values.select("node", "value").distinct(), "values")
    seen = new
    while not new.isEmpty():
        moved = new.join(copies, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "value").distinct()
        new = table(moved.join(seen, ["node", "value"], "left_anti"), "values")
        seen = seen.union(new)
    return seen


def cyclic(parents: DataFrame) -> DataFrame:
    """(id) of nodes whose chain of (id, parent) never ends: what stays when nodes without a parent are peeled off."""
    left = table(parents.where("parent is not null").select("id", "parent").distinct(), "chains")
    while True:
        nxt = table(left.join(left.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("id", "parent"), "chains")
        if nxt.count() == left.count():
            return nxt.select("id")
        left = nxt

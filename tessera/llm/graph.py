"""Connected components: by union-find in one task while the links are few, else by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that one task may close; their number is counted first.
ONE_TASK = 1 << 20
#: A node with more than this share of all links meets its minimum by a broadcast; there are at most 2 / HOT of them.
HOT = 0.002


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links (u, v) and the smallest node each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        # every link lowers the roots of both its ends to the smaller one, and roots are followed to their own
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, low = _least(*(np.concatenate(x) for x in zip(*parts)))
            for k in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(low[k : k + 100_000])], ["node", "component"])

    return links.coalesce(1).mapInArrow(common.released(run), "node long, component long")


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m, the least of u and all its v; nodes of many rows aren't dealt by u."""
    low = common.table(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c")), "least")
    hot = F.broadcast(low.where(F.col("c") > max(100, HOT * total)).select("u", "m"))
    rest = low.where(F.col("c") <= max(100, HOT * total)).select("u", "m")
    return rows.join(hot, "u").unionByName(rows.join(hot.select("u"), "u", "left_anti").join(rest, "u"))


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(u, v) links of long ids to (node, component): the smallest id reachable. Nodes without links are absent.

    Self-links, repeated links and nulls are ignored. Each round is written to the shared folder; the only
    thing that comes to the driver is a count and a checksum per round.
    """
    cur = common.table(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc",
    )
    seen = (cur.count(), None)
    if seen[0] <= one_task:
        return _in_one_task(cur)
    while True:
        both = cur.union(cur.select("v", "u"))
        large = _with_least(both, 2 * seen[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.table(large, "cc")
        small = _with_least(large, seen[0])
        nxt = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = common.table(nxt, "cc")
        sign = nxt.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        common.drop(cur)
        common.drop(large)
        if (sign["n"], sign["x"]) == seen:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                nxt.select(F.col("v"), F.col("v")).distinct()
            )
        seen, cur = (sign["n"], sign["x"]), nxt

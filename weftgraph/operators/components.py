"""Connected components: spanning forests of partitions, then alternating large-star and small-star rounds.

``edges`` has two long columns ``u`` and ``v``.  First each partition joins its own
edges in arrays and hands on a spanning forest only, every node with the
smallest of its part, so what is shuffled follows the nodes and not the edges.
Each round then points nodes at smaller neighbours (Kiveris et al., Connected
Components in MapReduce and Beyond, 2014) and contracts the partitions of its
result again.  The smallest neighbour is a partial aggregation; it meets the edges by ``split_join``, so a
hub with a third of all nodes stays spread over all tasks.  Once no more than
``LOCAL_EDGES`` are left, proved by the count of the written table, one task
finishes them.  Every round is written to the shared folder: lineage stays short
and lost executors reread it; its count and fingerprint are observed in the write itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.work import drop, observed, split_join, table

#: Most edges that one task may finish, and that a partition joins at a time.
LOCAL_EDGES, LOT = 1 << 21, 1 << 20


def smallest_of_part(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes ascending, smallest node of the component of each) of edges held in arrays."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    f = np.arange(len(nodes))
    while len(a):
        np.minimum.at(f, np.maximum(f[a], f[b]), np.minimum(f[a], f[b]))
        while not np.array_equal(g := f[f], f):  # every node at its root
            f = g
        open_ = f[a] != f[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[f]


def forests(edges: DataFrame, lot: int = LOT) -> DataFrame:
    """(u, v): for each partition of ``edges`` its nodes u with the smallest node v of their part; a node without another one has u = v."""

    def run(batches):
        u = v = np.zeros(0, np.int64)
        new, size = [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            nodes, low = smallest_of_part(np.concatenate([u, *[x for x, _ in new]]), np.concatenate([v, *[y for _, y in new]]))
            alone = np.bincount(np.searchsorted(nodes, low), minlength=len(nodes)) == 1
            keep = (nodes != low) | alone
            return nodes[keep], low[keep]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            new.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            size += b.num_rows
            if size >= lot:
                u, v = joined()
                new, size = [], 0
                if len(u) > 4 * lot:  # a partition with too many nodes to hold goes on in pieces
                    yield out()
                    u = v = np.zeros(0, np.int64)
        if new:
            u, v = joined()
        yield out()

    return edges.mapInArrow(run, "u bigint, v bigint")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, with their number and an order-free fingerprint, both seen while writing."""
    t, seen = observed(edges, "components", links=F.count(F.lit(1)), fingerprint=F.bit_xor(F.xxhash64("u", "v")))
    return t, (seen["links"], seen["fingerprint"])


def _met(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """Edges with the ``m`` of their ``u``; keys of many edges are broadcast, so none makes a task."""
    return split_join(edges, table(low, "low"), ["u"], count="c", total=n)


def large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    return _met(both, low, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    moved = _met(down, low, n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Self-loops and repeated edges change nothing (a node with only a self-loop is its
    own component); rows with a null end are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    first, mark = _written(forests(pairs))
    now = first
    for _ in range(max_rounds):
        n = mark[0]
        if n <= local_edges:
            now = table(forests(now.coalesce(1)), "round")
            break
        before, old = now, mark
        linked = now.where("u != v")
        large = table(large_star(linked, n), "large")
        now, mark = _written(forests(small_star(large, large.count())))
        drop(large)
        if mark == old:
            break
        if before is not first:
            drop(before)
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    stars = now.where("u != v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    ends = stars.select(F.col("component").alias("node")).unionByName(first.where("u = v").select(F.col("u").alias("node"))).distinct()
    return stars.unionByName(ends.join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))

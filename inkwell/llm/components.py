"""Connected components of an edge table: parts of it contracted in one task each, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, reachable

#: Edges that one task contracts: 16 bytes each, about 100 bytes while it works.
PART_EDGES = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) for each node but the smallest of its component.

    Roots hook to the smallest root beside them, and paths are halved until they have one step, so that rounds are few
    and each is a handful of array operations.
    """
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: u.size], ends[u.size :]
    root = np.arange(nodes.size)
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        open_ = high != low
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    far = np.flatnonzero(root != np.arange(nodes.size))
    return nodes[far], nodes[root[far]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """u, v: each part's edges as stars around the smallest nodes that they reach within the part; no shuffle.

    A part is at most about PART_EDGES edges, read from files that lie side by side.
    """

    def contract(batches):
        import pyarrow as pa

        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def held():
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us[:], vs[:] = [u], [v]

        grown = 0
        for batch in batches:
            us.append(batch.column("u").to_numpy())
            vs.append(batch.column("v").to_numpy())
            grown += batch.num_rows
            if grown > PART_EDGES:  # what is known so far shrinks to a forest
                held()
                grown = 0
        held()
        yield pa.RecordBatch.from_arrays([pa.array(us[0], pa.int64()), pa.array(vs[0], pa.int64())], names=["u", "v"])

    reachable(edges.sparkSession)
    return edges.coalesce(parts).mapInArrow(contract, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """a, b (long) -> node, component: every node with an edge to another, and the smallest node it reaches.

    Edges are read in parts of PART_EDGES, each contracted to stars by one task without a shuffle. Where there is one
    part, these are the components. With more parts, every node hands its larger neighbours, then its smaller ones, to
    the smallest of them, and parts are contracted again, until nothing changes: O(log^2 n) rounds at most, no task
    ever holds a node's whole neighbourhood. Minima are combined before the shuffle; both sides of a join are written
    tables, so that Spark can broadcast small ones and split hot nodes. Null ends and loops are left out.
    """
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        parts = -(-now.count() // PART_EDGES)
        now = materialize(_contracted(now, max(1, parts)), "edges")
        if parts <= 1 or (state := _state(now)) == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("low")), "stars")
        # Large star: larger neighbours go to the smallest of u and all its neighbours.
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).where("u <> v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("low")), "stars")
        # Small star: u and its smaller neighbours go to the smallest of these.
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        now = materialize(small.unionByName(least.withColumnRenamed("low", "v")).distinct(), "edges")
    # Stars now: each node's one edge leads to its component's smallest node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

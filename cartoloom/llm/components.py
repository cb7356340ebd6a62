"""Connected components of a link table, without gathering links on one machine.

Each partition first shrinks its links with a local union-find (a forest has fewer links than
nodes), then alternating star contraction joins the forests: every round hooks the larger
neighbours of a node to its smallest one, which needs only grouped minima and equi-joins, so
a node with very many links is handled by partial aggregation and skew-join splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged
from .workers import lean


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links ``a``-``b``: each node that is not a root, and the root (smallest id) of its tree."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    left, right = flat[: len(a)], flat[len(a) :]
    while True:
        low, high = root[left], root[right]
        open_ = low != high
        if not open_.any():
            break
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(root, np.maximum(low, high), np.minimum(low, high))
        while True:  # path halving for all nodes at once
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for rows in batches:
        a = np.concatenate([a, rows.column(0).to_numpy()])
        b = np.concatenate([b, rows.column(1).to_numpy()])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
            if len(a) > 1 << 19:  # still large: hand on what there is, so memory stays bounded
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
                a = b = np.zeros(0, np.int64)
    a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def components(links: DataFrame, a: str = "u", b: str = "v", rounds: int = 60) -> DataFrame:
    """Map every linked node to the smallest node it can reach.

    ``links`` has two long columns; nulls and self links are ignored, repeated links are
    harmless, and an empty table gives an empty result. Returns ``node, component`` for every
    node that has a link and is not its own smallest. Raises if ``rounds`` do not suffice.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = edges.mapInArrow(lean(_local), "u long, v long")
    for _ in range(rounds):
        edges = staged(edges, "links")
        # Done once every node has one parent and no parent has one itself.
        heads = edges.select(F.col("v").alias("h")).join(edges, F.col("h") == F.col("u"), "left_semi")
        counts = edges.agg(F.count("*") == F.count_distinct("u")).first()
        if counts[0] and heads.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # u > v in every row: hook larger neighbours, then smaller ones, to the minimum seen.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = large.join(low, "u").select(F.explode(hooked).alias("e")).select("e.*").where("u <> v").distinct()
    raise RuntimeError(f"components did not settle in {rounds} rounds")

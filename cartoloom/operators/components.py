"""Connected components and reachability over link tables, in rounds that halve the graph.

Each round gives every node the neighbour (or itself) that comes first in an order drawn anew for the round, and relabels
all links by that choice. Links stay links or fall together, so components stay apart and whole, and about half of the nodes
of even a long chain are left: rounds grow with the logarithm of the longest path. The smallest member is carried along, and the choices are
followed back at the end, each by one join. What is left of at most ``SMALL`` links is settled at once, a group of keys a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import release, staged

SMALL = 1 << 17


def roots(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """The smallest member of each node's component, over links between nodes ``0 .. count - 1``."""
    root = np.arange(count)
    while len(left):
        low, high = root[left], root[right]
        apart = low != high
        left, right, low, high = left[apart], right[apart], low[apart], high[apart]
        np.minimum.at(root, np.maximum(low, high), np.minimum(low, high))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _settled(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, node, parent`` of links few enough for one task."""
    kind = dict(edges.dtypes)["u"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(pd.concat([pdf["u"], pdf["v"]], ignore_index=True), sort=True)
        root = roots(code[: len(pdf)], code[len(pdf) :], len(names))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "node": names, "parent": names[root]})

    fields = "".join(f"`{k}` {dict(edges.dtypes)[k]}, " for k in keys)
    return edges.withColumn("_one", F.lit(0)).groupBy(*(keys or ["_one"])).applyInPandas(run, f"{fields}node {kind}, parent {kind}")


def contract(edges: DataFrame, keys: Sequence[str] = (), small: int = SMALL, rounds: int = 64) -> DataFrame:
    """``keys, node, component`` of every linked node: the smallest node it can reach.

    ``edges`` holds ``u, v`` of one orderable type and key columns within which links lie. Null ends and self links are ignored, repeated
    links are harmless, and no links give no rows. Raises if ``rounds`` do not suffice.
    """
    keys = list(keys)
    one = edges.select(*keys, "u", "v").where("u <> v")
    now = staged(one.unionByName(one.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    steps: list[tuple[DataFrame, DataFrame]] = []
    least: DataFrame | None = None
    for turn in range(rounds + 1):
        size = now.count()
        if size == 0:
            break
        if turn == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        if size <= small:
            step, more = _settled(now, keys), None
        else:
            drawn = lambda c: F.struct(F.xxhash64(*keys, c, F.lit(turn)).alias("h"), F.col(c).alias("parent"))  # noqa: B023, E731
            first = now.groupBy(*keys, "u").agg(F.min(drawn("v")).alias("f"))
            step = staged(first.select(*keys, F.col("u").alias("node"), F.least("f", drawn("u"))["parent"].alias("parent")), "choices")
            to = lambda end: step.select(*keys, F.col("node").alias(end), F.col("parent").alias(f"_{end}"))  # noqa: B023, E731
            moved = now.join(to("u"), [*keys, "u"]).join(to("v"), [*keys, "v"]).where("_u <> _v")
            more = staged(moved.select(*keys, F.col("_u").alias("u"), F.col("_v").alias("v")).distinct(), "links")
        held = step.withColumn("least", F.col("node")) if least is None else step.join(least, [*keys, "node"])
        least = staged(held.groupBy(*keys, F.col("parent").alias("node")).agg(F.min("least").alias("least")), "least")
        if more is None:
            step = staged(step, "choices")
        steps.append((step, least))
        release(now)
        if more is None:
            break
        now = more
    if not steps:
        return now.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    names: DataFrame | None = None
    for step, reached in reversed(steps):
        own = reached.select(*keys, F.col("node").alias("parent"), "least")
        if names is not None:
            told = names.select(*keys, F.col("node").alias("parent"), F.col("component").alias("_told"))
            own = own.join(told, [*keys, "parent"], "left").select(*keys, "parent", F.coalesce("_told", "least").alias("least"))
        names = step.join(own, [*keys, "parent"]).select(*keys, "node", F.col("least").alias("component"))
    out = staged(names, "components")
    for step in steps:
        release(*step)
    return out


def renamed(rows: DataFrame, names: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``column`` replaced by its component; values without links stay."""
    told = names.select(*keys, F.col("node").alias(column), F.col("component").alias("_component"))
    both = rows.join(told, [*keys, column], "left")
    return both.withColumn(column, F.coalesce("_component", column)).drop("_component")


def reachable(edges: DataFrame, seeds: DataFrame, small: int = SMALL) -> DataFrame:
    """``node``: all that can be reached from ``seeds`` (``node``) along ``edges`` (``a`` to ``b``), the seeds included.

    Nodes linked both ways fall together first, in few rounds; of the one-way links left, at most ``small``
    are followed in one task, and of more a round follows those of the newly reached.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "ways")
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    names = contract(edges.join(back, ["a", "b"], "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v")), small=small)
    ways = renamed(renamed(edges, names, "a"), names, "b").where("a <> b").select("a", "b").distinct()
    seeds = seeds.select("node").distinct()
    ways, known = staged(ways, "ways"), staged(renamed(seeds, names, "node").distinct(), "reached")
    if ways.count() <= small:
        kind = dict(ways.dtypes)["a"]
        both = known.select(F.lit(0).alias("k"), "node"), ways.select(F.lit(0).alias("k"), "a", "b")
        known = both[0].groupBy("k").cogroup(both[1].groupBy("k")).applyInPandas(_followed, f"node {kind}")
        return _members(known, names, seeds)
    new = known
    reached = [known]
    while not new.isEmpty():
        met = ways.join(new.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        new = staged(met.join(_union(reached), "node", "left_anti"), "reached")
        reached.append(new)
    return _members(_union(reached), names, seeds)


def _followed(seeds: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """All that few links reach from few seeds."""
    code, names = pd.factorize(pd.concat([ways["a"], ways["b"], seeds["node"]], ignore_index=True))
    a, b, first = np.split(code, [len(ways), 2 * len(ways)])
    known = np.zeros(len(names), bool)
    known[first] = True
    while True:
        new = known[a] & ~known[b]
        if not new.any():
            return pd.DataFrame({"node": names[known]})
        known[b[new]] = True


def _members(known: DataFrame, names: DataFrame, seeds: DataFrame) -> DataFrame:
    own = names.join(known.select(F.col("node").alias("component")), "component", "left_semi").select("node")
    return _union([known, own, seeds]).distinct()


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)

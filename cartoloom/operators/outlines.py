"""Outlines of masks as rings, and simpler lines: rounds of joins instead of one walk along each ring.

Rounds are for large grids and long stretches only; small ones are settled whole, each in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stage import release, staged
from .components import contract
from .raster import TILE, components

#: Most points of a stretch that is settled in one task.
STRETCH = 1 << 10
#: Steps along x and y of a cell's four sides, the cell on their left; a left turn adds one.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def _sides(cells: DataFrame) -> DataFrame:
    """Sides of set cells that no set cell shares: ``grid_id, part, x, y, way``; ``way`` is the place in :data:`STEPS`."""
    corner = ((0, 0), (1, 0), (1, 1), (0, 1))
    four = F.array(*(F.struct((F.col("col") + dx).alias("x"), (F.col("row") + dy).alias("y"), F.lit(k).alias("way")) for k, (dx, dy) in enumerate(corner)))
    own = cells.select("grid_id", "part", F.explode(four).alias("s")).select("grid_id", "part", "s.*")
    # Both cells of an inner side give it, in opposite ways: named by its smaller end it occurs twice.
    level = F.col("way") % 2
    least = (F.col("x") - (F.col("way") == 2).cast("int")).alias("_x"), (F.col("y") - (F.col("way") == 3).cast("int")).alias("_y"), level.alias("_level")
    once = own.select("*", *least).groupBy("grid_id", "_x", "_y", "_level").agg(F.count("*").alias("_n"), F.first(F.struct("part", "x", "y", "way")).alias("s"))
    return once.where("_n = 1").select("grid_id", "s.*")


def _traced(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corners of the rings of one grid's cells ``row, col, part``."""
    row, col, part = (pdf[c].to_numpy() for c in ("row", "col", "part"))
    held = np.zeros((row.max() + 3, col.max() + 3), bool)
    held[row + 1, col + 1] = True
    corner, beside = ((0, 0), (1, 0), (1, 1), (0, 1)), ((0, -1), (1, 0), (0, 1), (-1, 0))
    outer = [~held[row + 1 + dy, col + 1 + dx] for dx, dy in beside]
    x, y = (np.concatenate([v[o] + c[k] for o, c in zip(outer, corner, strict=True)]) for k, v in ((0, col), (1, row)))
    way, part = np.repeat(np.arange(4), [o.sum() for o in outer]), np.concatenate([part[o] for o in outer])
    side = y.astype("int64") << 33 | x.astype("int64") << 2 | way
    order = np.argsort(side)
    x, y, way, part, side = x[order], y[order], way[order], part[order], side[order]
    at = np.full((*held.shape, 4), -1)
    at[y, x, way] = np.arange(len(side))
    step = np.array(STEPS)[way]
    turns = [at[y + step[:, 1], x + step[:, 0], (way + turn) % 4] for turn in (1, 0, 3)]
    after = np.where(turns[0] >= 0, turns[0], np.where(turns[1] >= 0, turns[1], turns[2]))
    ring, ahead = np.arange(len(side)), after
    for _ in range(len(side).bit_length()):
        ring, ahead = np.minimum(ring, ring[ahead]), ahead[ahead]
    last = after == ring
    left, ahead = (~last).astype("int32"), np.where(last, np.arange(len(side)), after)
    for _ in range(len(side).bit_length()):
        left, ahead = left + left[ahead], ahead[ahead]
    before = np.empty_like(way)
    before[after] = way
    kept = way != before
    found = {"part": part, "ring": side[ring], "place": left[ring] - left, "x": x, "y": y}
    return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], **{k: v[kept] for k, v in found.items()}})


def ring_points(cells: DataFrame, mask: str, tile: int = TILE) -> DataFrame:
    """Corners of the rings around a mask's parts: ``grid_id, part, ring, place, x, y`` in cell units, x along columns, y along rows.

    ``cells``: ``grid_id, row, col`` and the mask. Parts are connected 4 ways and named as by :func:`raster.components`; each has one ring
    with its cells on the left, and one for each hole, the other way round. Rings that touch in a corner stay apart. Points on
    straight runs are left out, and places count from a ring's first side. Each side finds the next one by a join, rings are told
    apart by contraction, and places come from jumps that double, so the longest ring takes a logarithm of its length in rounds.
    Where no grid has ``tile`` rows or columns, each is traced in one task, as it is labelled.
    """
    parts = components(cells, mask, diagonal=False, tile=tile).withColumnRenamed("component", "part")
    most = cells.agg(F.max(F.greatest("row", "col"))).first()[0]
    if most is None or most < tile:
        return parts.groupBy("grid_id").applyInPandas(_traced, f"grid_id {dict(cells.dtypes)['grid_id']}, part long, ring long, place int, x int, y int")
    number = F.shiftleft(F.col("y").cast("long"), 33) + F.shiftleft(F.col("x").cast("long"), 2) + F.col("way")
    sides = staged(_sides(parts).withColumn("side", number), "sides")
    step = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in STEPS)), F.col("way") + 1)
    ends = sides.select("grid_id", "side", "way", (F.col("x") + step(0)).alias("x"), (F.col("y") + step(1)).alias("y"))
    after = sides.select("grid_id", "x", "y", F.col("side").alias("next"), F.col("way").alias("_way"))
    # Where two parts or two corners of one meet in a point, the leftmost turn stays with the cell.
    turn = F.pmod(F.col("_way") - F.col("way") + 2, F.lit(4))
    chain = ends.join(after, ["grid_id", "x", "y"]).groupBy("grid_id", "side").agg(F.max_by("next", turn).alias("next"))
    chain = staged(chain, "chain")
    names = contract(chain.select("grid_id", F.col("side").alias("u"), F.col("next").alias("v")), ["grid_id"]).select("grid_id", F.col("node").alias("side"), F.col("component").alias("ring"))
    far = chain.join(names, ["grid_id", "side"]).withColumn("next", F.when(F.col("next") != F.col("ring"), F.col("next"))).withColumn("left", F.when(F.col("next").isNotNull(), 1).otherwise(0))
    far = staged(far, "far")
    while not far.where("next IS NOT NULL").isEmpty():
        ahead = far.select("grid_id", F.col("side").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        jumped = far.join(ahead, ["grid_id", "next"], "left").select("grid_id", "side", "ring", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"))
        old, far = far, staged(jumped, "far")
        release(old)
    size = far.groupBy("grid_id", "ring").agg(F.max("left").alias("_most"))
    placed = far.join(size, ["grid_id", "ring"]).select("grid_id", "side", "ring", (F.col("_most") - F.col("left")).alias("place"))
    both = sides.join(placed, ["grid_id", "side"])
    # A corner is where the side before goes another way; the first side's is the last one.
    before = chain.join(sides.select("grid_id", "side", "way"), ["grid_id", "side"]).select("grid_id", F.col("next").alias("side"), F.col("way").alias("_before"))
    return both.join(before, ["grid_id", "side"]).where("way <> _before").select("grid_id", "part", "ring", "place", "x", "y")


def ring_areas(points: DataFrame) -> DataFrame:
    """``grid_id, part, ring, corners, area, length`` of rings; the area of a hole is negative."""
    along = Window.partitionBy("grid_id", "ring").orderBy("place")
    first = F.first(F.struct("x", "y")).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = points.withColumn("_q", F.coalesce(F.lead(F.struct("x", "y")).over(along), first))
    size = F.sum(F.col("x") * F.col("_q.y") - F.col("_q.x") * F.col("y")) / 2
    way = F.sum(F.abs(F.col("_q.x") - F.col("x")) + F.abs(F.col("_q.y") - F.col("y")))
    return after.groupBy("grid_id", "part", "ring").agg(F.count("*").alias("corners"), size.alias("area"), way.cast("long").alias("length"))


def polygons(points: DataFrame, cell_w: float = 1.0, cell_h: float = 1.0) -> DataFrame:
    """``grid_id, part, rings``: a polygon a part, its outer ring first, then its holes."""
    corner = F.struct((F.col("x") * cell_w).alias("x"), (F.col("y") * cell_h).alias("y"))
    rings = points.groupBy("grid_id", "part", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", corner.alias("p")))), lambda s: s["p"]).alias("points"))
    own = rings.join(ring_areas(points).select("grid_id", "ring", "area"), ["grid_id", "ring"])
    ordered = F.array_sort(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), "ring", "points")))
    return own.groupBy("grid_id", "part").agg(F.transform(ordered, lambda s: s["points"]).alias("rings"))


def _needed(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, limit: float) -> np.ndarray:
    """Which points of stretches (``sizes`` points each, one after the other) must stay for squared gaps of at most ``limit``. Masked points never do."""
    kept = np.zeros(len(x), bool)
    ends = np.cumsum(sizes)
    p, q = np.repeat(ends - sizes, sizes), np.repeat(ends - 1, sizes)
    at = np.flatnonzero((np.arange(len(x)) > p) & (np.arange(len(x)) < q))
    p, q = p[at], q[at]
    while len(at):
        dx, dy = x[q] - x[p], y[q] - y[p]
        size = dx * dx + dy * dy
        with np.errstate(all="ignore"):
            share = np.where(size > 0, ((x[at] - x[p]) * dx + (y[at] - y[p]) * dy) / size, 0.0)
            share = np.fmax(0.0, np.fmin(1.0, share))
            ex, ey = x[at] - x[p] - share * dx, y[at] - y[p] - share * dy
            gap = np.ma.filled(ex * ex + ey * ey, -1.0)
        gap[np.isnan(gap)] = np.inf
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        count = np.diff(np.r_[first, len(at)])
        most = np.maximum.reduceat(gap, first)
        far = np.minimum.reduceat(np.where(gap == np.repeat(most, count), at, len(x)), first)
        kept[far[most > limit]] = True
        far, open_ = np.repeat(far, count), np.repeat(most > limit, count) & (at != np.repeat(far, count))
        at, p, q, far = at[open_], p[open_], q[open_], far[open_]
        p, q = np.where(at > far, far, p), np.where(at < far, far, q)
    return kept


def _masked(values: pa.Array) -> np.ndarray:
    own = values.to_numpy(zero_copy_only=False).astype("float64")
    return np.ma.array(own, mask=values.is_null().to_numpy(zero_copy_only=False)) if values.null_count else own


def _settled(stretches: DataFrame, tolerance: float, key: str) -> DataFrame:
    """Inner points to keep of stretches ``key, points``, which hold ``seq, x, y`` in order, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("points")
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
            x, y = (_masked(flat.field(c)) for c in "xy")
            at = np.flatnonzero(_needed(x, y, sizes, tolerance * tolerance))
            points = flat.take(pa.array(at))
            own = rows.column(key).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[at]))
            yield pa.RecordBatch.from_arrays([own, *(points.field(c) for c in ("seq", "x", "y"))], [key, "seq", "x", "y"])

    point = stretches.schema["points"].dataType.elementType
    return stretches.mapInArrow(run, T.StructType([stretches.schema[key], *(T.StructField(f.name, f.dataType) for f in point.fields)]))


def simplified(points: DataFrame, tolerance: float, key: str = "line_id", most: int = STRETCH) -> DataFrame:
    """Points of lines ``key, seq, x, y`` that are needed so that no point left out is further than ``tolerance`` from the line kept.

    All stretches between kept points are looked at together: the furthest point of each, if it is too far, is kept, until none is. A
    line whose ends are one point is parted at the point furthest from it. Ties go to the smaller ``seq``; lines are told apart by ``key``.
    Rounds of joins part what has more than ``most`` points between its ends; shorter stretches are settled at once, each in one task.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")
    ends = points.groupBy(key).agg(F.min("seq").alias("_a"), F.max("seq").alias("_b"))
    kept = ((F.col("seq") == F.col("_a")) | (F.col("seq") == F.col("_b"))).alias("_kept")
    now = staged(points.join(ends, key).select(key, "seq", "x", "y", kept), "lines")
    before, after = (Window.partitionBy(key).orderBy("seq").rowsBetween(*r) for r in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    end = F.when(F.col("_kept"), F.struct("seq", "x", "y"))
    while True:
        held = now.withColumn("_p", F.last(end, True).over(before)).withColumn("_q", F.first(end, True).over(after))
        inner = held.where(~F.col("_kept")).withColumn("_from", F.col("_p.seq"))
        long = staged(inner.groupBy(key, "_from").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, "_from"), "long")
        if long.isEmpty():
            break
        dx, dy = F.col("_q.x") - F.col("_p.x"), F.col("_q.y") - F.col("_p.y")
        size = dx * dx + dy * dy
        share = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("_p.x")) * dx + (F.col("y") - F.col("_p.y")) * dy) / F.when(size > 0, size))), F.lit(0.0))
        ex, ey = F.col("x") - F.col("_p.x") - share * dx, F.col("y") - F.col("_p.y") - share * dy
        far = inner.join(long, [key, "_from"]).withColumn("_gap", F.coalesce(ex * ex + ey * ey, F.lit(-1.0)))
        best = far.groupBy(key, "_from").agg(F.max(F.struct("_gap", (-F.col("seq")).alias("_down"))).alias("_m"))
        # A long stretch is parted at its furthest point, or has no point to keep.
        told = best.select(key, F.col("_from").alias("_in"), F.when(F.col("_m._gap") > tolerance * tolerance, -F.col("_m._down")).alias("_far"), F.lit(True).alias("_told"))
        own = held.withColumn("_in", F.when(~F.col("_kept"), F.col("_p.seq"))).join(told, [key, "_in"], "left")
        left = own.where(F.col("_told").isNull() | F.col("_far").isNotNull())
        old, now = now, staged(left.select(key, "seq", "x", "y", (F.col("_kept") | F.coalesce(F.col("seq") == F.col("_far"), F.lit(False))).alias("_kept")), "lines")
        release(old, long)
    # A kept point ends the stretch before it and begins the next one.
    of = F.when(~F.col("_kept"), F.array("_p.seq")).when(F.col("_q").isNull(), F.array("_p.seq")).otherwise(F.array("_p.seq", "seq"))
    spread = held.select(key, "seq", "x", "y", F.explode(of).alias("_from")).where("_from IS NOT NULL")
    stretches = spread.groupBy(key, "_from").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("points")).where("size(points) > 2").select(key, "points")
    return now.where("_kept").select(key, "seq", "x", "y").unionByName(_settled(stretches, tolerance, key))

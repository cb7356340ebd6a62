"""Regions moved outwards and inwards: narrow gaps closed, narrow parts found.

A region grows by the capsules around its border's segments, and shrinks by what they cover; both are overlays of
polygons, tile by tile. Regions are tables of trapezoids as :mod:`overlay` makes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlay import SIDES, TILE, _overlaid, border, once, triangulated, union


def as_polygons(trapezoids: DataFrame, key: str) -> DataFrame:
    """``key, rings``: each trapezoid as a ring."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "low0"), corner("x1", "low1"), corner("x1", "high1"), corner("x0", "high0"))
    return trapezoids.select(key, F.array(ring).alias("rings"))


def borders(trapezoids: DataFrame, key: str) -> DataFrame:
    """``key, x0, y0, x1, y1, turn``: the segments around each region, the region on their left. A region is one group, linear in its trapezoids.

    ``turn``: 1 where the border turns left at the segment's start, -1 to the right, 0 straight on; null where it turns back or parts touch.
    """
    kind = dict(trapezoids.dtypes)[key]

    def run(group: pa.Table) -> pa.Table:
        own = np.column_stack([group.column(c).to_numpy() for c in SIDES])
        own = own[np.lexsort(own.T[::-1])]

        def make() -> np.ndarray:
            points, faces = triangulated(own)
            rim = border(faces) if len(faces) else np.zeros((0, 2), int)
            ends = points[rim].reshape(-1, 4) if len(rim) else np.zeros((0, 4))
            order = np.argsort(rim[:, 1], kind="stable")
            first, last = (np.searchsorted(rim[order, 1], rim[:, 0], side) for side in ("left", "right"))
            alone = (last - first == 1) & (np.bincount(rim[:, 0], minlength=len(points))[rim[:, 0]] == 1)
            along = ends[:, 2:] - ends[:, :2]
            before = along[order[np.minimum(first, max(len(order) - 1, 0))]]
            size = np.linalg.norm(along, axis=1) * np.linalg.norm(before, axis=1)
            sine, cosine = before[:, 0] * along[:, 1] - before[:, 1] * along[:, 0], (before * along).sum(axis=1)
            turn = np.where(np.abs(sine) > 1e-12 * size, np.sign(sine), np.where(cosine > 0, 0.0, np.nan))
            return np.column_stack([ends, np.where(alone, turn, np.nan)])

        ends = once(("borders", own.tobytes()), own.nbytes, make, lambda e: e.nbytes)
        return pa.table({key: pa.array([group.column(key)[0].as_py()] * len(ends), group.schema.field(key).type), **{n: pa.array(ends[:, i].copy(), from_pandas=True) for i, n in enumerate(("x0", "y0", "x1", "y1", "turn"))}})

    return trapezoids.select(key, *SIDES).groupBy(key).applyInArrow(run, f"{key} {kind}, x0 double, y0 double, x1 double, y1 double, turn double")


def capsules(segments: DataFrame, distance: float, key: str, sides: int = 32, turns: int | None = None) -> DataFrame:
    """``key, rings``: all places within ``distance`` of segments, as a rectangle each and a polygon of ``sides`` corners at each start.

    With ``turns`` only starts where the border turns that way get one, and those of no known turn: outside of a region places are
    nearest to a corner only where it turns left (1), inside of it only where it turns right (-1).
    """
    if distance <= 0 or sides < 4:
        raise ValueError("a distance must be positive and a disc have four corners at least")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    long = segments.withColumn("_l", length).where("_l > 0")
    dx, dy = ((F.col(f"{k}1") - F.col(f"{k}0")) / F.col("_l") * distance for k in "xy")
    corner = lambda n, s: point(F.col(f"x{n}") - s * dy, F.col(f"y{n}") + s * dx)
    boxes = long.select(key, F.array(F.array(corner(0, -1), corner(1, -1), corner(1, 1), corner(0, 1))).alias("rings"))
    angle = [2 * np.pi * k / sides for k in range(sides)]
    disc = F.array(*(point(F.col("x0") + distance * float(np.cos(a)), F.col("y0") + distance * float(np.sin(a))) for a in angle))
    corners = segments if turns is None else segments.where(F.col("turn").isNull() | (F.col("turn") == turns))
    return boxes.unionByName(corners.select(key, "x0", "y0").distinct().select(key, F.array(disc).alias("rings")))


def grown(trapezoids: DataFrame, distance: float, key: str, tile: float = TILE) -> DataFrame:
    """Trapezoids of all places within ``distance`` of each region."""
    both = as_polygons(trapezoids, key).unionByName(capsules(borders(trapezoids, key), distance, key, turns=1))
    return union(both, key, tile)


def shrunk(trapezoids: DataFrame, distance: float, key: str, tile: float = TILE) -> DataFrame:
    """Trapezoids of all places of each region further than ``distance`` from its border; nothing is left of a narrow one."""
    own = as_polygons(trapezoids, key).withColumn("role", F.lit(0))
    near = capsules(borders(trapezoids, key), distance, key, turns=-1).withColumn("role", F.lit(1))
    return _overlaid(own.unionByName(near), key, "less", tile)


def closed(trapezoids: DataFrame, distance: float, key: str, tile: float = TILE) -> DataFrame:
    """Each region with its gaps below twice the ``distance`` filled: grown, then shrunk."""
    return shrunk(grown(trapezoids, distance, key, tile), distance, key, tile)


def narrow(trapezoids: DataFrame, width: float, key: str, tile: float = TILE) -> DataFrame:
    """``key`` of the regions that are nowhere as wide as ``width``."""
    left = shrunk(trapezoids, width / 2, key, tile).select(key).distinct()
    return trapezoids.select(key).distinct().join(left, key, "left_anti")

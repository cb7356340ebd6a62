"""Water bodies: the sea behind a coast line, merged polygons, levels, solids and the terrain beneath them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from .components import contract, renamed
from .mesh import terrain_solid
from .overlay import TRIANGLES, as_rings, boxed, slabs, triangulated
from .profile import body_levels, flatten_under
from .raster import component_stats, components
from .spatial import BOX, box_overlaps

STRIP_MM = 0.3


def _along(coast: DataFrame, step: float) -> DataFrame:
    """Points on segments at most ``step`` apart, with the unit vector to their right: ``grid_id, x, y, rx, ry, weight``."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    own = coast.withColumn("_l", F.hypot(dx, dy)).where("_l > 1e-8").withColumn("_n", F.ceil(F.col("_l") / step).cast("int"))
    own = own.withColumn("_t", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: (k + 0.5) / F.col("_n"))))
    return own.select("grid_id", (F.col("x0") + F.col("_t") * dx).alias("x"), (F.col("y0") + F.col("_t") * dy).alias("y"), (dy / F.col("_l")).alias("rx"), (-dx / F.col("_l")).alias("ry"), (F.col("_l") / F.col("_n")).alias("weight"))


def ocean(cells: DataFrame, coast: DataFrame, cell_w: float, cell_h: float, rows: int, columns: int, strip: float = STRIP_MM) -> DataFrame:
    """Adds ``ocean`` to cells ``grid_id, row, col``: regions that coast lines cut off with the sea on their right.

    Cells that a line crosses part the grid (row 0 at y = 0); of the regions left, connected 4 ways, those are sea that touch
    the border and have more line to whose right they lie (at half a ``strip``, or one cell) than to whose left.
    ``coast``: ``grid_id, x0, y0, x1, y1``. Regions are exact to the size of a cell.
    """
    marks = _along(coast, min(cell_w, cell_h) / 4)
    spot = lambda d: (F.floor((F.col("y") + d * F.col("ry")) / cell_h).cast("int").alias("row"), F.floor((F.col("x") + d * F.col("rx")) / cell_w).cast("int").alias("col"))
    crossed = marks.select("grid_id", *spot(0.0)).distinct().withColumn("_line", F.lit(True))
    parted = cells.join(crossed, ["grid_id", "row", "col"], "left").withColumn("_open", F.col("_line").isNull())
    labelled = staged(components(parted, "_open", diagonal=False), "regions")
    reach = max(strip / 2, float(np.hypot(cell_w, cell_h)) * 1.01)
    sides = [marks.select("grid_id", *spot(s * reach), (F.col("weight") * s).alias("vote")) for s in (1.0, -1.0)]
    votes = sides[0].unionByName(sides[1]).join(labelled, ["grid_id", "row", "col"]).groupBy("grid_id", "component").agg(F.sum("vote").alias("vote"))
    rim = component_stats(labelled, rows, columns).where("touches_border").select("grid_id", "component")
    sea = labelled.join(votes.where("vote > 1e-8").join(rim, ["grid_id", "component"]).select("grid_id", "component"), ["grid_id", "component"], "left_semi")
    return cells.join(sea.select("grid_id", "row", "col", F.lit(True).alias("ocean")), ["grid_id", "row", "col"], "left").withColumn("ocean", F.coalesce("ocean", F.lit(False)))


def clusters(polygons: DataFrame, cell: float, key: str = "water_id") -> DataFrame:
    """``key, cluster``: polygons whose boxes overlap, directly or by others, named by their smallest key.

    Overlaps are contracted, so a long row of ponds takes few rounds. Equal boxes stand as one, so copies add no pairs.
    """
    flat = boxed(polygons).select(key, *BOX)
    once = staged(flat.where("max_x > min_x AND max_y > min_y").groupBy(*BOX).agg(F.min(key).alias("cluster")), "boxes")
    names = contract(box_overlaps(once, cell, "cluster", least=0.0).select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = flat.join(renamed(once, names, "cluster"), list(BOX), "left")
    return named.select(key, F.coalesce("cluster", key).alias("cluster"))


def merged_bodies(polygons: DataFrame, plate: tuple[float, float, float, float], tolerance: float = 0.1, cell: float = 16.0, key: str = "water_id") -> DataFrame:
    """Flat triangles ``layer, fid, a, b, c, ax .. cz`` (z = 0) of united polygons, cut to the plate less a small inset.

    Polygons that touch are one body; bodies are numbered in their cluster from left to right. Shore lines are not simplified.
    A cluster's equal polygons are united once.
    ``plate``: ``x0, y0, x1, y1``.
    """
    inset = max(0.01, tolerance / 2)
    x0, y0, x1, y1 = plate[0] + inset, plate[1] + inset, plate[2] - inset, plate[3] - inset
    frame = [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]

    def run(group: pa.Table) -> pa.Table:
        own = [as_rings(r["rings"]) for r in sorted(group.select([key, "rings"]).to_pylist(), key=lambda r: r[key])]
        points, faces = triangulated(slabs([frame, *own], lambda s: bool(s[0] and s[1:].any())))
        part = _parts(faces)
        names = [f"{group.column('cluster')[0].as_py()}/{k}" for k in part]
        corners = np.concatenate([points[faces], np.zeros((len(faces), 3, 1))], axis=2).reshape(-1, 9) if len(faces) else np.zeros((0, 9))
        cols = {"layer": pa.array(names, pa.string()), "fid": pa.array(np.arange(len(faces)))} | {k: pa.array(faces[:, i].astype(np.int64)) for i, k in enumerate("abc")}
        return pa.table(cols | {f"{p}{k}": pa.array(np.ascontiguousarray(corners[:, 3 * i + j])) for i, p in enumerate("abc") for j, k in enumerate("xyz")})

    once = polygons.join(clusters(polygons, cell, key), key).groupBy("cluster", "rings").agg(F.min(key).alias(key))
    return once.select("cluster", key, "rings").groupBy("cluster").applyInArrow(run, f"layer string, {TRIANGLES}")


def _parts(faces: np.ndarray) -> np.ndarray:
    """Number of the edge-connected part of each face, in order of first faces."""
    directed = np.sort(faces[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1)
    of = np.unique(directed, axis=0, return_inverse=True)[1].reshape(-1, 3) if len(faces) else np.zeros((0, 3), int)
    name = np.arange(len(faces))
    while len(faces):
        low = np.full(of.max() + 1, len(faces))
        np.minimum.at(low, of.ravel(), np.repeat(name, 3))
        new = low[of].min(axis=1)
        if np.array_equal(new, name):
            break
        name = new
    return np.unique(name, return_inverse=True)[1]


def rim_points(flat: DataFrame) -> DataFrame:
    """``layer, x, y`` of the corners on the border of flat triangles."""
    edges = flat.select("layer", F.explode(F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q"), *(F.col(f"{p}{k}").alias(k) for k in "xy")) for p, q in ("ab", "bc", "ca")))).alias("e"))
    once = edges.groupBy("layer", F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi")).agg(F.count("*").alias("n"), F.first("e.p").alias("p"), F.first("e.x").alias("x"), F.first("e.y").alias("y"))
    return once.where("n = 1").select("layer", "p", "x", "y").distinct().select("layer", "x", "y")


def water_levels(flat: DataFrame, sample: Callable[[DataFrame], DataFrame], recess: float = 0.4, offset: float = 0.0, least: float = -0.8) -> DataFrame:
    """``layer, level_mm``: the lowest terrain on a body's rim, lowered, at least the floor."""
    return body_levels(sample(rim_points(flat)), recess, offset, least, key="layer", height="sample")


def lifted(flat: DataFrame, heights: DataFrame) -> DataFrame:
    """Triangles of solids over flat ones between ``bottom`` and ``top`` of their layer; corners above have twice the number, those below one more."""
    both = flat.join(heights.select("layer", "bottom", "top"), "layer")
    up, down = (lambda k: F.col(k) * 2), (lambda k: F.col(k) * 2 + 1)
    face = lambda n, ids, at, z: F.struct((F.col("fid") * 8 + n).alias("fid"), *(i.alias(k) for i, k in zip(ids, "abc", strict=True)), *(v.alias(f"{k}{c}") for p, h, k in zip(at, z, "abc", strict=True) for c, v in (("x", F.col(f"{p}x")), ("y", F.col(f"{p}y")), ("z", F.col(h)))))
    caps = both.select("layer", F.explode(F.array(face(0, [up(k) for k in "abc"], "abc", ["top"] * 3), face(1, [down(k) for k in "acb"], "acb", ["bottom"] * 3))).alias("f"))
    sides = both.select("layer", "fid", "bottom", "top", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(p).alias("p"), F.col(q).alias("q"), *(F.col(f"{s}{c}").alias(f"{t}{c}") for s, t in ((p, "p"), (q, "q")) for c in "xy")) for n, (p, q) in enumerate(("ab", "bc", "ca"))))).alias("e")).select("layer", "fid", "bottom", "top", "e.*")
    once = sides.groupBy("layer", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(F.count("*").alias("uses"), F.first(F.struct("fid", "n", "p", "q", "px", "py", "qx", "qy", "bottom", "top")).alias("w")).where("uses = 1").select("layer", "w.*")
    wall = lambda k, ids, at, z: F.struct((F.col("fid") * 8 + 2 + F.col("n") * 2 + k).alias("fid"), *(i.alias(c) for i, c in zip(ids, "abc", strict=True)), *(v.alias(f"{m}{c}") for p, h, m in zip(at, z, "abc", strict=True) for c, v in (("x", F.col(f"{p}x")), ("y", F.col(f"{p}y")), ("z", F.col(h)))))
    walls = once.select("layer", F.explode(F.array(wall(0, [down("p"), down("q"), up("q")], "pqq", ["bottom", "bottom", "top"]), wall(1, [down("p"), up("q"), up("p")], "pqp", ["bottom", "top", "top"]))).alias("f"))
    return caps.unionByName(walls).select("layer", "f.*")


def water_solids(flat: DataFrame, levels: DataFrame, thickness: float = 0.6) -> DataFrame:
    """Triangles of water bodies whose surface is their level."""
    if thickness <= 0:
        raise ValueError("water thickness must be positive")
    return lifted(flat, levels.select("layer", (F.col("level_mm") - thickness).alias("bottom"), F.col("level_mm").alias("top")))


def terrain_with_water(cells: DataFrame, bodies: DataFrame, rows: int, columns: int, base: float, thickness: float = 0.6, overlap: float = 0.4, layer: str | Column = "terrain") -> tuple[DataFrame, DataFrame]:
    """Terrain solid with a flat support below each water body (boxes with ``level_mm, body_order``), exact to a cell."""
    if not 0 <= overlap < thickness:
        raise ValueError("the support's overlap must be smaller than the water's thickness")
    return terrain_solid(flatten_under(cells, bodies, thickness, overlap), rows, columns, base, layer)




def triangle_boxes(flat: DataFrame) -> DataFrame:
    """Triangles with their boxes ``min_x .. max_y``."""
    return flat.select("*", *(f(*(F.col(f"{p}{k}") for p in "abc")).alias(f"{n}_{k}") for k in "xy" for n, f in (("min", F.least), ("max", F.greatest))))

"""Raster algebra on cell tables ``grid_id, row, col, ...``; every grid of a table is handled at once.

Neighbourhoods are hash joins of shifted cells, so a grid of any size is spread over tasks, and components are
labelled tile by tile and joined at the rims. Where each step depends on the one before (hole filling, no-data growth)
a grid is one group for a numpy kernel: one giant grid is one task, many grids run side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import CLASSES, exposed, plausible_elevation
from ..sources.stage import staged
from .components import contract, renamed, roots

# Cleanup presets (least island mm2, narrow span mm, greatest hole mm2, passes) and score thresholds.
CLEANUP = {"conservative": (0.8, 2.5, 0.25, 0), "balanced": (0.5, 2.0, 0.5, 1), "broad": (0.25, 1.5, 1.0, 1)}
THRESHOLDS = {"conservative": 80, "balanced": 55, "broad": 40}
TILE = 512  # rows and columns of a part of a grid that one task labels
EIGHT = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


@dataclass(frozen=True)
class GridSpec:
    rows: int
    columns: int
    mode: str
    cell_width: float
    cell_height: float

    @property
    def faces(self) -> int:
        """Triangles of a solid over the grid: top, bottom and two a border segment."""
        return 4 * (self.rows - 1) * (self.columns - 1) + 2 * (2 * (self.rows - 1) + 2 * (self.columns - 1))


def grid_for_print(width: float, height: float, override: int | tuple[int, int] | None = None, cell: float = 0.55, most: int = 180_000, side: int = 512) -> GridSpec:
    """Rows and columns of about ``cell`` millimetres within limits of samples and side length."""
    if width <= 0 or height <= 0:
        raise ValueError("print dimensions must be positive")
    if override is not None:
        pair = (override, override) if isinstance(override, int) else override
        if isinstance(override, bool) or len(pair) != 2 or any(isinstance(v, bool) or not isinstance(v, int) for v in pair):
            raise ValueError("grid override must be an integer or (rows, columns)")
        rows, columns = pair
        if min(rows, columns) < 2:
            raise ValueError("grid dimensions must be at least two")
        return GridSpec(rows, columns, "override", width / (columns - 1), height / (rows - 1))
    if cell <= 0 or most < 4 or side < 2:
        raise ValueError("grid limits are invalid")
    want_r, want_c = max(2, math.ceil(height / cell) + 1), max(2, math.ceil(width / cell) + 1)
    scale = min(1.0, (side - 1) / (want_r - 1), (side - 1) / (want_c - 1), math.sqrt(most / (want_r * want_c)))
    rows, columns = (max(2, math.floor((n - 1) * scale) + 1) for n in (want_r, want_c))
    while rows * columns > most:
        if rows / height >= columns / width:
            rows -= 1
        else:
            columns -= 1
    return GridSpec(rows, columns, "adaptive", width / (columns - 1), height / (rows - 1))


def terrain_analysis(cells: DataFrame, value: str, span_m: float, most_mm: float = 3.0, least_mm: float = 1.5, *group: str) -> DataFrame:
    """Robust range, flatness rating 0 to 5, target relief and vertical scale of each group of elevations."""
    if span_m <= 0 or least_mm < 0 or most_mm <= 0 or least_mm > most_mm:
        raise ValueError("terrain analysis dimensions must be positive and ordered")
    fine = cells.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    made = (fine.groupBy(*group) if group else fine).agg(F.min(value).alias("minimum_m"), F.max(value).alias("maximum_m"), F.percentile(value, [0.05, 0.95]).alias("p"))
    made = made.withColumn("p05", F.col("p")[0]).withColumn("p95", F.col("p")[1]).withColumn("robust_range_m", F.greatest(F.lit(0.0), F.col("p95") - F.col("p05")))
    flat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("robust_range_m") / span_m / 0.08))
    made = made.withColumn("flatness", flat).withColumn("target_relief_mm", least_mm + F.col("flatness") * (most_mm - least_mm))
    scale = F.when(F.col("robust_range_m") > 1e-9, F.col("target_relief_mm") / F.when(F.col("robust_range_m") > 1e-9, F.col("robust_range_m"))).otherwise(0.0)
    return made.select(*group, "minimum_m", "maximum_m", "p05", "p95", "robust_range_m", F.rint(F.col("flatness") * 5).cast("int").alias("rating"), "target_relief_mm", scale.alias("scale_mm_per_m"))


def normalised_relief(cells: DataFrame, value: str, span_m: float, gamma: float = 1.0, most_mm: float = 3.0, least_mm: float = 1.5) -> DataFrame:
    """Printed heights ``h_mm``: linear between the robust percentiles, exponential tails of 5 %, rescaled and raised to ``gamma``."""
    if gamma <= 0:
        raise ValueError("detail gamma must be positive")
    a = terrain_analysis(cells, value, span_m, most_mm, least_mm, "grid_id").select("grid_id", "p05", "p95", "robust_range_m", "target_relief_mm")
    both = cells.join(a, "grid_id")
    v, lo, hi = F.col(value), F.col("p05"), F.col("p95")
    span = F.when(hi - lo > 1e-9, hi - lo)
    core = F.when(v < lo, 0.05 * F.exp((v - lo) / span)).when(v > hi, 1.0 - 0.05 * F.exp(-(v - hi) / span)).otherwise(0.05 + 0.90 * (v - lo) / span)
    both = both.withColumn("_n", core)
    ends = both.groupBy("grid_id").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    both = both.join(ends, "grid_id")
    scaled = (F.col("_n") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    height = F.coalesce(F.pow(scaled, F.lit(gamma)), F.lit(0.0)) * F.col("target_relief_mm")
    return both.select(*cells.columns, height.alias("h_mm"))


def trim_border(cells: DataFrame, x: str, y: str, height: str, width: float, depth: float, margin: float) -> DataFrame:
    """The lowest height everywhere within ``margin`` of the plate's edge."""
    if margin <= 0:
        return cells
    low = cells.groupBy("grid_id").agg(F.min(height).alias("_low"))
    edge = (F.col(x) <= margin + 1e-9) | (F.col(x) >= width - margin - 1e-9) | (F.col(y) <= margin + 1e-9) | (F.col(y) >= depth - margin - 1e-9)
    return cells.join(low, "grid_id").withColumn(height, F.when(edge, F.col("_low")).otherwise(F.col(height))).drop("_low")


def axis(length: float | Column, count: int | Column, margin: float | Column = 0.0, descending: bool = False) -> Column:
    """Evenly spaced positions, with the inner trim lines put in where there is a margin. Numbers, or columns of a table of plates."""
    length, margin = (x if isinstance(x, Column) else F.lit(float(x)) for x in (length, margin))
    last = (count if isinstance(count, Column) else F.lit(count)) - 1
    at = F.transform(F.sequence(last * 0, last), lambda i: i.cast("double") * (length / last))
    return F.sort_array(F.when(margin > 0, F.array_union(at, F.array(margin, length - margin))).otherwise(at), not descending)


def bilinear(points: DataFrame, cells: DataFrame, value: str, rows: int, columns: int, out: str = "sample") -> DataFrame:
    """Sample at fractional ``f_row, f_col`` (clipped to the grid) from the four cells around.

    Each cell is given its right, lower and lower right neighbours' values by two windows over the grid, so a point
    meets one row by one equi-join. Every point is returned, repeated ones too; a sample that needs a missing cell is null.
    """
    along, down = Window.partitionBy("grid_id", "row").orderBy("col"), Window.partitionBy("grid_id", "col").orderBy("row")
    wide = cells.select("grid_id", "row", "col", F.col(value).cast("double").alias("_bl_a"))
    wide = wide.withColumn("_bl_b", F.when(F.lead("col").over(along) == F.col("col") + 1, F.lead("_bl_a").over(along)))
    below = F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead(F.struct("_bl_a", "_bl_b")).over(down))
    wide = wide.withColumn("_bl_low", below).select("grid_id", F.col("row").alias("_bl_row"), F.col("col").alias("_bl_col"), "_bl_a", "_bl_b", F.col("_bl_low._bl_a").alias("_bl_c"), F.col("_bl_low._bl_b").alias("_bl_d"))
    r = F.greatest(F.lit(0.0), F.least(F.col("f_row"), F.lit(float(rows - 1))))
    c = F.greatest(F.lit(0.0), F.least(F.col("f_col"), F.lit(float(columns - 1))))
    at = points.withColumn("_bl_row", F.floor(r).cast("int")).withColumn("_bl_col", F.floor(c).cast("int")).withColumn("_bl_tr", r - F.floor(r)).withColumn("_bl_tc", c - F.floor(c))
    mixed = lambda p, q, t: F.when(F.col(t) > 0, F.col(p) * (1 - F.col(t)) + F.col(q) * F.col(t)).otherwise(F.col(p))
    met = at.join(wide, ["grid_id", "_bl_row", "_bl_col"], "left").withColumn("_bl_top", mixed("_bl_a", "_bl_b", "_bl_tc")).withColumn("_bl_base", mixed("_bl_c", "_bl_d", "_bl_tc"))
    return met.select(*points.columns, mixed("_bl_top", "_bl_base", "_bl_tr").alias(out))


def resample_classes(targets: DataFrame, source: DataFrame, box: tuple[float, float, float, float], rows: int, columns: int) -> DataFrame:
    """Class of the source cell that holds each target centre ``x, y``; unknown outside the source."""
    x0, y0, x1, y1 = box
    col = F.floor((F.col("x") - x0) / (x1 - x0) * columns).cast("int")
    row = F.floor((F.col("y") - y0) / (y1 - y0) * rows).cast("int")
    at = targets.withColumn("_row", row).withColumn("_col", col)
    own = source.select("grid_id", F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("class").alias("_class"))
    return at.join(own, ["grid_id", "_row", "_col"], "left").withColumn("class", F.coalesce("_class", F.lit(0))).drop("_row", "_col", "_class")


def neighbours(cells: DataFrame, mask: str, out: str = "n8") -> DataFrame:
    """How many of a cell's eight neighbours are set; set cells send to their neighbours, counts join back."""
    sent = cells.where(F.col(mask)).select("grid_id", F.explode(F.array(*(F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in EIGHT))).alias("to"))
    counts = sent.groupBy("grid_id", F.col("to.row").alias("row"), F.col("to.col").alias("col")).agg(F.count("*").alias(out))
    return cells.join(counts, ["grid_id", "row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def majority(cells: DataFrame, mask: str, water: str) -> DataFrame:
    """One pass: keep set cells with a neighbour, set cells with six; water stays off."""
    out = neighbours(cells, mask, "_n")
    new = ((F.col(mask) & (F.col("_n") >= 1)) | (~F.col(mask) & (F.col("_n") >= 6))) & ~F.col(water)
    return out.withColumn(mask, new).drop("_n")


def runs(cells: DataFrame, mask: str) -> DataFrame:
    """Maximal runs of set columns in each row: ``first_col, last_col, n``."""
    along = Window.partitionBy("grid_id", "row").orderBy("col")
    own = cells.where(F.col(mask)).withColumn("_g", F.col("col") - F.row_number().over(along))
    return own.groupBy("grid_id", "row", "_g").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count("*").alias("n")).drop("_g")


def coastal_distance(cells: DataFrame, water: str, cell_x: float, cell_y: float, limit: float) -> DataFrame:
    """Cells within ``limit`` metres of water in an 8-way metric: adds ``coastal``.

    Without obstacles the shortest way over ``dr`` rows and ``dc`` columns is diagonal steps, then straight ones, and its
    length is the larger of two linear forms of ``dr`` and ``dc``. So the nearest water of a row, found by two windows along
    it, reaches a known number of rows up and down its column, and two windows along columns tell which cells are reached.
    """
    if cell_x <= 0 or cell_y <= 0 or limit < 0:
        raise ValueError("coastal distances and cell sizes must be non-negative")
    diagonal = math.hypot(cell_x, cell_y)
    along, across = Window.partitionBy("grid_id", "row").orderBy("col"), Window.partitionBy("grid_id", "col").orderBy("row")
    before, after = (Window.unboundedPreceding, Window.currentRow), (Window.currentRow, Window.unboundedFollowing)
    wet = F.when(F.col(water), F.col("col"))
    left, right = F.max(wet).over(along.rowsBetween(*before)), F.min(wet).over(along.rowsBetween(*after))
    near = F.least(F.col("col") - left, right - F.col("col"))
    reach = F.floor(F.least((limit - near * (diagonal - cell_y)) / cell_y, (limit - near * cell_x) / (diagonal - cell_x)) + 1e-9)
    own = cells.withColumn("_reach", F.when(reach >= 0, reach))
    low = F.max(F.col("row") + F.col("_reach")).over(across.rowsBetween(*before))
    high = F.min(F.col("row") - F.col("_reach")).over(across.rowsBetween(*after))
    return own.withColumn("coastal", F.coalesce(low >= F.col("row"), F.lit(False)) | F.coalesce(high <= F.col("row"), F.lit(False))).drop("_reach")


def fuse_classes(source: Column, water: Column, osm: Column) -> Column:
    """Water, then mapped exposed ground, then the raster's exposed ground and vegetation; other raster classes are unknown."""
    return F.when(water, CLASSES["water"]).when(osm, CLASSES["bare"]).when(exposed(source), source).when(source == CLASSES["vegetation"], source).otherwise(CLASSES["unknown"])


def evidence(cells: DataFrame, sensitivity: str = "balanced") -> DataFrame:
    """Score and class from ``wc, io`` classes and masks ``water, osm, cliff, vegetation, coastal, connected``."""
    if sensitivity not in THRESHOLDS:
        raise ValueError(f"unsupported ground-cover sensitivity: {sensitivity}")
    points = lambda c, n: F.when(c, n).otherwise(0)
    built = (F.col("wc") == CLASSES["built"]) | (F.col("io") == CLASSES["built"])
    score = points(exposed(F.col("wc")), 45) + points(exposed(F.col("io")), 45) + points(F.col("coastal"), 15) + points(F.col("connected"), 15) + points(F.col("cliff"), 15) - points(F.col("vegetation"), 50)
    bare = ((score >= THRESHOLDS[sensitivity]) | F.col("osm")) & ~(built & ~F.col("osm")) & ~F.col("water")
    kind = F.when(F.col("water"), CLASSES["water"]).when(bare, CLASSES["bare"]).when(built, CLASSES["built"]).when(F.col("vegetation"), CLASSES["vegetation"]).otherwise(CLASSES["unknown"])
    return cells.withColumn("score", score).withColumn("exposed", bare).withColumn("class", kind)


def mask_counts(cells: DataFrame, *masks: str) -> DataFrame:
    return cells.agg(*(F.count_if(F.col(m)).alias(m) for m in masks))


def cover_stats(cells: DataFrame, mask: str = "exposed") -> DataFrame:
    """Exposed cells and percentages of exposed, vegetated and wet cells in each grid."""
    pct = lambda c: 100.0 * F.count_if(c) / F.count("*")
    return cells.groupBy("grid_id").agg(F.count_if(F.col(mask)).alias("exposed_cells"), pct(F.col(mask)).alias("exposed_percent"), pct(F.col("class") == CLASSES["vegetation"]).alias("vegetation_percent"), pct(F.col("class") == CLASSES["water"]).alias("water_percent"))


def plateau(cells: DataFrame, height: str, water: str) -> DataFrame:
    """Most frequent height (to 9 digits) under water, the lower of equals."""
    counts = cells.where(F.col(water)).groupBy("grid_id", F.round(height, 9).alias("level")).agg(F.count("*").alias("n"))
    return counts.groupBy("grid_id").agg(F.max(F.struct(F.col("n"), (-F.col("level")).alias("down"))).alias("b")).select("grid_id", (-F.col("b.down")).alias("level"), F.col("b.n").alias("n"))


def component_stats(labelled: DataFrame, rows: int, columns: int, cell_w: float = 1.0, cell_h: float = 1.0) -> DataFrame:
    """Cells, area, span and border contact of each labelled component."""
    rim = (F.col("row") == 0) | (F.col("row") == rows - 1) | (F.col("col") == 0) | (F.col("col") == columns - 1)
    span = F.greatest((F.max("row") - F.min("row") + 1) * cell_h, (F.max("col") - F.min("col") + 1) * cell_w)
    return labelled.groupBy("grid_id", "component").agg(F.count("*").alias("cells"), (F.count("*") * (cell_w * cell_h)).alias("area"), span.alias("span"), F.bool_or(rim).alias("touches_border"))


def water_vertices(rows: int, columns: int, cells: DataFrame, mask: str) -> DataFrame:
    """Vertices all of whose triangles are wet. ``cells`` holds triangles ``row, col, half`` with a mask; half 0 is the one at the cell's upper left."""
    corner = F.when(F.col("half") == 0, F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 0), (1, 0), (0, 1))))).otherwise(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (1, 0), (1, 1)))))
    spread = cells.select("grid_id", F.explode(corner).alias("v"), mask)
    return spread.groupBy("grid_id", F.col("v.row").alias("row"), F.col("v.col").alias("col")).agg(F.bool_and(mask).alias("all_wet")).where("all_wet").drop("all_wet")


# -- kernels over one grid ------------------------------------------------------------------------


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Component number of each set cell (its smallest flat index), -1 elsewhere; union-find over neighbour pairs."""
    rows, columns = mask.shape
    index = np.arange(mask.size).reshape(mask.shape)
    pairs = []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
        if not diagonal and dr and dc:
            continue
        a = (slice(0, rows - dr), slice(max(0, -dc), columns - max(0, dc)))
        b = (slice(dr, rows), slice(max(0, dc), columns + min(0, dc)))
        both = mask[a] & mask[b]
        pairs.append(np.stack([index[a][both], index[b][both]]))
    root = roots(*np.concatenate(pairs, axis=1), mask.size)
    return np.where(mask, root.reshape(mask.shape), -1)


def dense(pdf: pd.DataFrame, column: str, fill) -> np.ndarray:
    rows, columns = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
    out = np.full((rows, columns), fill)
    out[pdf["row"], pdf["col"]] = pdf[column]
    return out


def components(cells: DataFrame, mask: str, diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """``grid_id, row, col, component`` of set cells, connected 8 ways, or 4 ways without ``diagonal``.

    A component is named by its smallest flat index. Grids above ``tile`` rows or columns are labelled tile by tile; the tiles' parts meet
    through the cells at their rims, and the links found there are contracted. The largest extent is looked up first.
    """
    kind = dict(cells.dtypes)["grid_id"]
    own = cells.select("grid_id", "row", "col", mask)
    most = own.agg(F.max(F.greatest("row", "col"))).first()[0]
    if most is None or most < tile:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            found = label(dense(pdf, mask, False).astype(bool), diagonal)
            at = np.argwhere(found >= 0)
            return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "row": at[:, 0].astype("int32"), "col": at[:, 1].astype("int32"), "component": found[found >= 0]})

        return own.groupBy("grid_id").applyInPandas(whole, f"grid_id {kind}, row int, col int, component long")

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["row"].min()), int(pdf["col"].min())
        found = label(dense(pdf.assign(row=pdf["row"] - top, col=pdf["col"] - left), mask, False).astype(bool), diagonal)
        at = np.argwhere(found >= 0)
        first = found[found >= 0]
        wide = found.shape[1]
        name = (first // wide + top) << 32 | (first % wide + left)
        return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "row": (at[:, 0] + top).astype("int32"), "col": (at[:, 1] + left).astype("int32"), "component": name})

    tiles = own.where(mask).groupBy("grid_id", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))
    # Names hold the row and column of a part's first cell, so they are in the order of flat indices.
    parts = staged(tiles.applyInPandas(part, f"grid_id {kind}, row int, col int, component long"), "parts")
    rim = parts.where((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1))
    ahead = [(0, 1), (1, 0), (1, 1), (1, -1)] if diagonal else [(0, 1), (1, 0)]
    spots = F.explode(F.array(*(F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ahead)))
    links = rim.select("grid_id", F.col("component").alias("u"), spots.alias("at")).select("grid_id", "at.row", "at.col", "u").join(rim.withColumnRenamed("component", "v"), ["grid_id", "row", "col"])
    names = contract(links.where("u <> v").select("grid_id", "u", "v").distinct(), ["grid_id"])
    wide = own.groupBy("grid_id").agg((F.max("col") + 1).cast("long").alias("_wide"))
    named = renamed(parts, names, "component", ["grid_id"]).join(wide, "grid_id")
    flat = F.shiftright("component", 32) * F.col("_wide") + F.col("component").bitwiseAND(0xFFFFFFFF)
    return named.select("grid_id", "row", "col", flat.alias("component"))


def anchored(labelled: DataFrame, anchors: DataFrame) -> DataFrame:
    """Cells of components that hold or touch (8 ways) an anchor cell."""
    near = anchors.select("grid_id", F.explode(F.array(*(F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in [(0, 0), *EIGHT]))).alias("a")).select("grid_id", "a.row", "a.col").distinct()
    hit = labelled.join(near, ["grid_id", "row", "col"], "left_semi").select("grid_id", "component").distinct()
    return labelled.join(hit, ["grid_id", "component"], "left_semi")


def coastal_water(labelled: DataFrame, rows: int, columns: int) -> DataFrame:
    """Cells of water components of at least 1 % of the grid (4 at least) that reach its border."""
    big = component_stats(labelled, rows, columns).where((F.col("cells") >= max(4, math.ceil(rows * columns * 0.01))) & F.col("touches_border"))
    return labelled.join(big.select("grid_id", "component"), ["grid_id", "component"], "left_semi")


def cleanup(mask: np.ndarray, water: np.ndarray, preset: tuple[float, float, float, int], cell_w: float, cell_h: float) -> np.ndarray:
    """Smooth, drop small round islands, fill small holes; each step sees the one before, water stays off."""
    least, narrow, hole, passes = preset
    rows, columns = mask.shape
    out = mask & ~water
    for _ in range(passes):
        padded = np.pad(out, 1)
        n = sum(padded[1 + r : 1 + r + rows, 1 + c : 1 + c + columns].astype(int) for r, c in EIGHT)
        out = ((out & (n >= 1)) | (~out & (n >= 6))) & ~water

    def groups(m: np.ndarray):
        own = label(m)
        at = np.argwhere(own >= 0)
        if not len(at):
            return own, np.zeros(0, int), pd.DataFrame()
        t = pd.DataFrame({"k": own[own >= 0], "r": at[:, 0], "c": at[:, 1]})
        return own, t["k"], t.groupby("k").agg(n=("r", "size"), r0=("r", "min"), r1=("r", "max"), c0=("c", "min"), c1=("c", "max"))

    own, _, g = groups(out)
    if len(g):
        span = np.maximum((g.r1 - g.r0 + 1) * cell_h, (g.c1 - g.c0 + 1) * cell_w)
        out = out & ~np.isin(own, g.index[(g.n * cell_w * cell_h < least) & (span < narrow)])
    own, _, g = groups(~out & ~water)
    if len(g):
        rim = (g.r0 == 0) | (g.r1 == rows - 1) | (g.c0 == 0) | (g.c1 == columns - 1)
        out = out | np.isin(own, g.index[~rim & (g.n * cell_w * cell_h <= hole)])
    return out & ~water


def clean_exposed(cells: DataFrame, sensitivity: str = "balanced", cell_w: float = 1.0, cell_h: float = 1.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``cleaned`` to cells with ``class`` and ``water``.

    ``shape`` is the full number of rows and columns of a grid, whose border no hole touches; without it a grid's border is at its own last cells.
    """
    if sensitivity not in CLEANUP:
        raise ValueError(f"unsupported ground-cover sensitivity: {sensitivity}")
    preset = CLEANUP[sensitivity]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = dense(pdf, "class", 0)
        water = dense(pdf, "water", False).astype(bool) | (kinds == CLASSES["water"])
        if shape is not None:
            # Cells that the table lacks are neither ground nor gap, like water.
            there = dense(pdf.assign(_there=True), "_there", False).astype(bool)
            more = [(0, max(0, full - own)) for full, own in zip(shape, kinds.shape, strict=True)]
            kinds, water = np.pad(kinds, more), np.pad(water | ~there, more, constant_values=True)
        out = cleanup((kinds >= 2) & (kinds <= 7), water, preset, cell_w, cell_h)
        return pdf.assign(cleaned=out[pdf["row"], pdf["col"]])

    own = cells.select("grid_id", "row", "col", "class", "water")
    return own.groupBy("grid_id").applyInPandas(run, own.schema.simpleString()[7:-1].replace(":", " ") + ", cleaned boolean")


def grow(values: np.ndarray, known: np.ndarray, missing: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Fill ``missing`` layer by layer with means of known neighbours; what stays open is NaN."""
    out, known, missing = np.where(known, values, 0.0), known.copy(), missing.copy()
    rows, columns = values.shape
    while missing.any():
        total, count = np.pad(np.where(known, out, 0.0), 1), np.pad(known, 1)
        s = sum(total[1 + r : 1 + r + rows, 1 + c : 1 + c + columns] for r, c in offsets)
        n = sum(count[1 + r : 1 + r + rows, 1 + c : 1 + c + columns].astype(int) for r, c in offsets)
        fill = missing & (n > 0)
        if not fill.any():
            break
        out[fill] = s[fill] / n[fill]
        known |= fill
        missing &= ~fill
    return np.where(missing, np.nan, np.where(known, out, values))


def repair_elevation(cells: DataFrame, value: str) -> DataFrame:
    """No-data and implausible values filled from their eight neighbours inwards, then with the median."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = dense(pdf, value, np.nan).astype(float)
        good = np.isfinite(v) & (np.abs(v) <= 12000.0)
        if not good.any():
            raise ValueError("elevation grid holds no plausible samples")
        out = grow(np.where(good, v, 0.0), good, ~good, EIGHT)
        out = np.where(np.isnan(out), np.median(v[good]), out)
        return pdf.assign(**{value: out[pdf["row"], pdf["col"]]})

    own = cells.select("grid_id", "row", "col", F.coalesce(plausible_elevation(F.col(value)), F.lit(float("nan"))).alias(value))
    return own.groupBy("grid_id").applyInPandas(run, own.schema.simpleString()[7:-1].replace(":", " "))


#: Least water cells and least share of the grid, least share of the water on one level, least share of the grid to restore, tolerance.
FLATTENED = (16, 200, 20, 2000, 5e-9)
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def flattened_land(cells: DataFrame, height: str = "h_mm", water: str = "water") -> DataFrame:
    """Adds ``flattened``: dry cells on the level that a grid's water was flattened to, where that is more than chance.

    A grid qualifies by the size of its water, of the most frequent level under it, and of the land on that level.
    """
    least, of_grid, of_water, of_land, tolerance = FLATTENED
    counts = cells.groupBy("grid_id").agg(F.count("*").alias("_n"), F.count_if(F.col(water)).alias("_wet"))
    most = plateau(cells, height, water).join(counts, "grid_id")
    at_least = lambda total, share: F.greatest(F.lit(least), F.floor(F.col(total) / share))
    sure = most.where((F.col("_wet") >= at_least("_n", of_grid)) & (F.col("n") >= at_least("_wet", of_water))).select("grid_id", "level", "_n")
    marked = cells.join(sure, "grid_id", "left").withColumn("flattened", F.coalesce((F.abs(F.col(height) - F.col("level")) <= tolerance) & ~F.col(water), F.lit(False)))
    enough = marked.where("flattened").groupBy("grid_id").agg(F.count("*").alias("_land"), F.first("_n").alias("_n")).where(F.col("_land") >= at_least("_n", of_land)).select("grid_id", F.lit(True).alias("_enough"))
    return marked.drop("level", "_n").join(enough, "grid_id", "left").withColumn("flattened", F.col("flattened") & F.coalesce("_enough", F.lit(False))).drop("_enough")


def restore_land(cells: DataFrame, height: str = "h_mm", water: str = "water") -> DataFrame:
    """Land that a water level was spread over, filled from its four neighbours inwards; what no other land touches stays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["flattened"].any():
            return pdf.drop(columns="flattened")
        values, wet, open_ = dense(pdf, height, 0.0).astype(float), dense(pdf, water, False).astype(bool), dense(pdf, "flattened", False).astype(bool)
        filled = grow(values, ~open_ & ~wet, open_, FOUR)
        out = np.where(np.isnan(filled) | ~open_, values, filled)
        return pdf.drop(columns="flattened").assign(**{height: out[pdf["row"], pdf["col"]]})

    own = cells.select("grid_id", "row", "col", height, water)
    return flattened_land(own, height, water).groupBy("grid_id").applyInPandas(run, own.schema)


def land_region(cells: DataFrame, width: float, depth: float, margin: float, *excluded: str) -> DataFrame:
    """Adds ``land``: cells ``x, y`` inside the margin that none of the masks excludes."""
    if min(width, depth) <= 2 * margin or margin < 0:
        raise ValueError("the margin is too large for the print dimensions")
    inside = F.col("x").between(margin, width - margin) & F.col("y").between(margin, depth - margin)
    for mask in excluded:
        inside = inside & ~F.coalesce(F.col(mask), F.lit(False))
    return cells.withColumn("land", inside)


def recess(surface: DataFrame, vertices: DataFrame, depth: float, height: str = "h_mm") -> DataFrame:
    """Surface lowered by ``depth`` at the given vertices."""
    if depth < 0:
        raise ValueError("recess depth cannot be negative")
    wet = vertices.select("grid_id", "row", "col").distinct().withColumn("_wet", F.lit(True))
    return surface.join(wet, ["grid_id", "row", "col"], "left").withColumn(height, F.col(height) - F.when(F.col("_wet"), depth).otherwise(0.0)).drop("_wet")


def mosaic(layers: DataFrame) -> DataFrame:
    """Per cell the nonzero class of the last item in ``item_order``; unknown if there is none."""
    return layers.groupBy("grid_id", "row", "col").agg(F.coalesce(F.max_by("class", F.when(F.col("class") != 0, F.col("item_order"))), F.lit(0)).alias("class"))

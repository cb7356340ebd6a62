"""Meshes with fewer faces: corners of a cube fall together, and faces that lose a corner go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import release, staged

XYZ = ("x", "y", "z")


def collapsed(vertices: DataFrame, faces: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces with the corners of each cube of side ``cell`` as one, at their mean and under their smallest number.

    ``cells``: ``layer, cell``; a layer without a row, or with a null, stays as it is. Faces with fewer than three corners left go, and of faces with the
    same three corners the one of the smallest ``fid`` stays. Vertices that no face uses go.
    """
    sized = vertices.join(cells.select("layer", F.col("cell").alias("_cell")), "layer", "left")
    place = [F.coalesce(F.floor(F.col(k) / F.col("_cell")), F.lit(0)).alias(f"_{k}") for k in XYZ]
    own = F.when(F.col("_cell").isNull(), F.col("vid")).otherwise(F.lit(-1)).alias("_own")
    cubes = sized.select("layer", "vid", *XYZ, own, *place)
    by = ["layer", "_own", *(f"_{k}" for k in XYZ)]
    made = cubes.groupBy(*by).agg(F.min("vid").alias("to"), *(F.avg(k).alias(f"m{k}") for k in XYZ))
    moved = cubes.select("vid", *by).join(made.select("to", *by), by).select("layer", "vid", "to")
    out = faces.select("layer", "fid", "a", "b", "c")
    for p in "abc":
        out = out.join(moved.select("layer", F.col("vid").alias(p), F.col("to").alias(f"_{p}")), ["layer", p]).drop(p).withColumnRenamed(f"_{p}", p)
    out = out.where("a <> b AND b <> c AND c <> a").withColumn("_three", F.array_sort(F.array("a", "b", "c")))
    out = out.groupBy("layer", "_three").agg(F.min(F.struct("fid", "a", "b", "c")).alias("f")).select("layer", "f.*")
    used = out.select("layer", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    kept = made.select("layer", F.col("to").alias("vid"), *(F.col(f"m{k}").alias(k) for k in XYZ)).join(used, ["layer", "vid"], "left_semi")
    return kept, out


def decimated(vertices: DataFrame, faces: DataFrame, budgets: DataFrame, growth: float = 1.5, rounds: int = 32) -> tuple[DataFrame, DataFrame]:
    """Meshes of at most ``budget`` faces a layer (``layer, budget``); layers within it, or without one, stay whole.

    The cube of a layer starts at the size that would leave about its budget of a square's faces, and grows until the faces left fit. All layers
    are tried together, a round a size. Raises if ``rounds`` do not suffice.
    """
    if growth <= 1:
        raise ValueError("cubes must grow")
    counts = faces.groupBy("layer").agg(F.count("*").alias("n")).join(budgets, "layer").where("n > budget")
    spans = vertices.groupBy("layer").agg(F.greatest(*(F.max(k) - F.min(k) for k in XYZ)).alias("span"))
    start = F.col("span") / F.sqrt(F.greatest(F.col("budget"), F.lit(1)))
    cells = staged(counts.join(spans, "layer").select("layer", "budget", F.greatest(start, F.lit(1e-9)).alias("cell")), "cubes")
    for _ in range(rounds):
        points, made = collapsed(vertices, faces, cells)
        made = staged(made, "collapsed")
        left = made.groupBy("layer").agg(F.count("*").alias("n"))
        over = cells.join(left, "layer", "left").withColumn("_over", F.coalesce(F.col("n") > F.col("budget"), F.lit(False)))
        if over.where("_over").isEmpty():
            return points, made
        old, cells = cells, staged(over.select("layer", "budget", F.when(F.col("_over"), F.col("cell") * growth).otherwise(F.col("cell")).alias("cell")), "cubes")
        release(old, made)
    raise RuntimeError(f"meshes did not fit their budgets in {rounds} rounds")

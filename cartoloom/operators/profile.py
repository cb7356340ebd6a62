"""Profiles along lines: slope limits, interpolation, smoothing, cross-sections and draping."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Sampler = Callable[[DataFrame], DataFrame]


def slope_limited(points: DataFrame, slope: float, key: str = "route_id", station: str = "station", height: str = "height", out: str = "limited") -> DataFrame:
    """Lowest profile above the heights whose slope stays within ``slope`` both ways, as two running maxima."""
    if slope <= 0:
        raise ValueError("maximum slope must be positive")
    along = Window.partitionBy(key).orderBy(station)
    s, h = F.col(station), F.col(height)
    ahead = F.max(h + slope * s).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - slope * s
    behind = F.max(h - slope * s).over(along.rangeBetween(Window.currentRow, Window.unboundedFollowing)) + slope * s
    return points.withColumn(out, F.greatest(ahead, behind))


def interpolate(asked: DataFrame, known: DataFrame, key: str = "route_id", station: str = "station", value: str = "height", out: str = "value") -> DataFrame:
    """Linear interpolation at asked stations, flat beyond the ends; of several known values at a station the largest counts."""
    top = known.groupBy(key, station).agg(F.max(value).alias("_v")).select(key, station, "_v", F.lit(0).alias("_ask"))
    both = top.unionByName(asked.select(key, station, F.lit(1).alias("_ask")).distinct(), allowMissingColumns=True)
    along = Window.partitionBy(key).orderBy(station, "_ask")
    back, front = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pair = F.when(F.col("_v").isNotNull(), F.struct(F.col(station).alias("s"), F.col("_v").alias("v")))
    both = both.withColumn("_a", F.last(pair, True).over(back)).withColumn("_b", F.first(pair, True).over(front)).where("_ask = 1")
    gap = F.col("_b.s") - F.col("_a.s")
    mid = F.col("_a.v") + (F.col(station) - F.col("_a.s")) * (F.col("_b.v") - F.col("_a.v")) / F.when(gap > 0, gap)
    made = both.select(key, station, F.coalesce(mid, F.col("_a.v"), F.col("_b.v")).alias(out))
    return asked.join(made, [key, station], "left")


def at_station(stations: DataFrame, pairs: DataFrame, key: str = "route_id", prefix: str = "p") -> DataFrame:
    """Coordinates at ``station`` along the line, held to its ends. Stations meet the segment that begins last before them by a union and a window."""
    ends = pairs.groupBy(key).agg(F.sum("length").alias("_len"))
    asked = stations.join(ends, key).withColumn("_s", F.greatest(F.lit(0.0), F.least(F.col("station"), F.col("_len"))))
    marks = pairs.select(key, F.col("station").alias("_s"), F.struct("station", "length", "x0", "y0", "x1", "y1").alias("_seg"), F.lit(0).alias("_ask"), F.col("seq").alias("_n"))
    both = marks.unionByName(asked.withColumn("_ask", F.lit(1)).withColumn("_n", F.lit(0).cast(dict(marks.dtypes)["_n"])), allowMissingColumns=True)
    along = Window.partitionBy(key).orderBy("_s", "_ask", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_seg", F.last("_seg", True).over(along)).where("_ask = 1")
    t = F.when(F.col("_seg.length") > 0, F.least(F.lit(1.0), (F.col("_s") - F.col("_seg.station")) / F.when(F.col("_seg.length") > 0, F.col("_seg.length")))).otherwise(0.0)
    at = lambda c: F.col(f"_seg.{c}0") + t * (F.col(f"_seg.{c}1") - F.col(f"_seg.{c}0"))
    return both.select(*stations.columns, at("x").alias(f"{prefix}x"), at("y").alias(f"{prefix}y"))


def cross_sections(stations: DataFrame, pairs: DataFrame, width: float, key: str = "route_id", samples: int = 5) -> DataFrame:
    """Sample points across the line at each station: ``offset_no, x, y`` for ``samples`` offsets over ``width``.

    The tangent comes from the line ``delta`` before and after, a 500th of its length within 0.05 and 1.
    """
    size = pairs.groupBy(key).agg(F.sum("length").alias("_l"))
    base = stations.select(key, F.col("station").alias("_at")).distinct().join(size, key)
    delta = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("_l") / 500))
    three = base.select(key, "_at", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), s.alias("s")) for i, s in enumerate((F.col("_at"), F.greatest(F.lit(0.0), F.least(F.col("_at"), F.col("_l")) - delta), F.least(F.col("_l"), F.greatest(F.col("_at"), F.lit(0.0)) + delta)))))).alias("m"))
    three = at_station(three.select(key, "_at", F.col("m.i").alias("_i"), F.col("m.s").alias("station")), pairs, key)
    pick = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c)))
    wide = three.groupBy(key, "_at").agg(*(pick(i, f"p{c}").alias(f"{c}{i}") for i in range(3) for c in "xy"))
    tx, ty = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    far = F.hypot(tx, ty)
    ux, uy = F.when(far <= 1e-9, 1.0).otherwise(tx / F.when(far > 1e-9, far)), F.when(far <= 1e-9, 0.0).otherwise(ty / F.when(far > 1e-9, far))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(-width / 2 + i * width / (samples - 1)).alias("o")) for i in range(samples)))
    return wide.withColumn("_o", F.explode(offsets)).select(key, F.col("_at").alias("station"), F.col("_o.i").alias("offset_no"), (F.col("x0") - uy * F.col("_o.o")).alias("x"), (F.col("y0") + ux * F.col("_o.o")).alias("y"))


def section_support(stations: DataFrame, pairs: DataFrame, width: float, sample: Sampler, key: str = "route_id", out: str = "support") -> DataFrame:
    """Highest terrain across the line at each station. ``sample`` adds ``sample`` to points ``x, y``."""
    return sample(cross_sections(stations, pairs, width, key)).groupBy(key, "station").agg(F.max("sample").alias(out))


def smoothed_support(stations: DataFrame, pairs: DataFrame, width: float, distance: float, sample: Sampler, key: str = "route_id") -> DataFrame:
    """Support at each station (``local``) and its 1-2-1 mean over positions ``distance`` before and after (``smooth``)."""
    size = pairs.groupBy(key).agg(F.sum("length").alias("_l"))
    own = stations.select(key, "station").distinct().join(size, key)
    moved = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.greatest(F.lit(0.0), F.least(F.col("_l"), F.col("station") + d)).alias("s")) for w, d in ((1, -distance), (2, 0.0), (1, distance))))
    spread = own.select(key, F.col("station").alias("_at"), F.explode(moved).alias("m")).select(key, "_at", F.col("m.w").alias("_w"), F.col("m.s").alias("station"))
    support = section_support(spread, pairs, width, sample, key)
    met = spread.join(support, [key, "station"])
    smooth = met.groupBy(key, "_at").agg((F.sum(F.col("_w") * F.col("support")) / 4).alias("smooth"), F.max(F.when(F.col("_w") == 2, F.col("support"))).alias("local"))
    return smooth.withColumnRenamed("_at", "station")


def drape_route(vertices: DataFrame, stations: DataFrame, pairs: DataFrame, sample: Sampler, width: float, visible: float, distance: float = 1.5, slope: float = 0.3, key: str = "route_id") -> DataFrame:
    """Route vertices on one height per station, thickness kept.

    ``vertices``: ``key, vid, z`` and ``stations``: ``key, vid, station`` of each vertex on the centre line.
    """
    if width <= 0 or visible <= 0 or distance < 0 or slope <= 0:
        raise ValueError("route width, height and slope must be positive, smoothing not negative")
    flat = vertices.join(stations, [key, "vid"])
    ends = flat.groupBy(key).agg(F.max("z").alias("_top"), F.min("z").alias("_low"))
    flat = flat.join(ends, key)
    tops = flat.where(F.abs(F.col("z") - F.col("_top")) <= 1e-7)
    support = smoothed_support(tops, pairs, width, distance, sample, key)
    need = tops.join(support, [key, "station"]).withColumn("height", F.greatest("smooth", "local") + visible)
    limited = slope_limited(need.select(key, "vid", "station", "height"), slope, key)
    line = interpolate(flat.select(key, "vid", "station"), limited.select(key, "station", F.col("limited").alias("height")), key)
    out = flat.join(line.select(key, "vid", "value"), [key, "vid"])
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z") - F.col("_low")) / F.when(F.col("_top") > F.col("_low"), F.col("_top") - F.col("_low"))))
    thick = F.col("_top") - F.col("_low")
    return out.select(key, "vid", "station", (F.col("value") - thick + F.coalesce(share, F.lit(1.0)) * thick).alias("z"))


def drape_vertices(vertices: DataFrame, sample: Sampler) -> DataFrame:
    """Vertices lifted by the terrain below them; ``vertices`` hold ``x, y, z``."""
    return sample(vertices).withColumn("z", F.col("z") + F.col("sample")).drop("sample")


def binomial(points: DataFrame, sample: Sampler, radius: float, key: str = "vid") -> DataFrame:
    """3 by 3 binomial mean of the terrain around each point: adds ``smooth``."""
    around = F.array(*(F.struct(F.lit(a * b).alias("w"), F.lit(dx * radius).alias("dx"), F.lit(dy * radius).alias("dy")) for dx, a in ((-1.0, 1.0), (0.0, 2.0), (1.0, 1.0)) for dy, b in ((-1.0, 1.0), (0.0, 2.0), (1.0, 1.0))))
    spread = points.select(key, F.explode(around).alias("o"), "x", "y").select(key, F.col("o.w").alias("_w"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return points.join(sample(spread).groupBy(key).agg((F.sum(F.col("_w") * F.col("sample")) / 16).alias("smooth")), key)


def smoothed_tops(points: DataFrame, sample: Sampler, radius: float, least_visible: float, key: str = "vid") -> DataFrame:
    """Top vertices on smoothed terrain, never less than ``least_visible`` above the terrain itself: ``z`` in, ``z`` out."""
    both = binomial(sample(points), sample, radius, key)
    return both.withColumn("z", F.col("z") + F.greatest("smooth", F.col("sample") + least_visible - F.col("z"))).drop("sample", "smooth")


def drape_roads(tops: DataFrame, corridors: DataFrame, pairs: DataFrame, sample: Sampler, visible: float, least_visible: float, distance: float, width: float, key: str = "road_id") -> DataFrame:
    """Road tops on graded corridors where they are in one, the highest corridor winning; else unchanged.

    ``corridors``: ``vid, key, station`` for each top vertex inside a corridor.
    """
    support = smoothed_support(corridors, pairs, width, distance, sample, key)
    want = corridors.join(support, [key, "station"]).withColumn("h", F.greatest(F.col("smooth") + visible, F.col("local") + least_visible))
    best = want.groupBy("vid").agg(F.max("h").alias("_h"))
    return tops.join(best, "vid", "left").withColumn("z", F.coalesce("_h", "z")).drop("_h")


def marker_mesh(support: DataFrame, diameter: float = 3.2, visible: float = 1.0, embed: float = 0.2, key: str = "marker_id") -> DataFrame:
    """Bottom and top of each marker from terrain at its centre and around its rim (``sample``)."""
    if min(diameter, visible) <= 0 or embed < 0:
        raise ValueError("marker dimensions must be positive")
    return support.groupBy(key).agg((F.min("sample") - embed).alias("bottom_mm"), (F.max("sample") + visible).alias("top_mm"))


def marker_samples(centres: DataFrame, diameter: float = 3.2, sections: int = 32, plate: tuple[float, float, float, float] | None = None, key: str = "marker_id") -> DataFrame:
    """Centre and rim points of each marker; with ``plate``, only markers whose disc is inside it."""
    if sections < 12:
        raise ValueError("a marker needs at least 12 sections")
    r = diameter / 2
    if plate:
        x0, y0, x1, y1 = plate
        centres = centres.where((F.col("x") - r >= x0) & (F.col("x") + r <= x1) & (F.col("y") - r >= y0) & (F.col("y") + r <= y1))
    rim = F.array(F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")), *(F.struct(F.lit(r * math.cos(2 * math.pi * i / sections)).alias("dx"), F.lit(r * math.sin(2 * math.pi * i / sections)).alias("dy")) for i in range(sections)))
    return centres.select(key, F.posexplode(rim).alias("n", "o"), "x", "y").select(key, "n", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))


def body_levels(rim: DataFrame, recess: float = 0.4, offset: float = 0.0, least: float = -0.8, key: str = "body_id", height: str = "h_mm") -> DataFrame:
    """Water level of each body: the lowest height of its rim, lowered, at least the floor."""
    if recess < 0:
        raise ValueError("water recess cannot be negative")
    return rim.groupBy(key).agg(F.greatest(F.lit(float(least)), F.min(height) + offset - recess).alias("level_mm"))


def flatten_under(cells: DataFrame, bodies: DataFrame, thickness: float = 0.6, overlap: float = 0.4, height: str = "h_mm", cell: float = 16.0) -> DataFrame:
    """Surface heights with the support level of the last body that holds a cell's ``x, y``."""
    from .spatial import last_at

    hit = last_at(cells, bodies, "level_mm", "body_order", cell, closed=True)
    return cells.join(hit, ["x", "y"], "left").withColumn(height, F.coalesce(F.col("_last.level_mm") - thickness + overlap, F.col(height))).select(*cells.columns)


def station_lengths(pairs: DataFrame, key: str = "route_id") -> DataFrame:
    return pairs.groupBy(key).agg(F.sum("length").alias("length"), F.count("*").alias("n_segments"))

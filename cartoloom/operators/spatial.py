"""Planar geometry on arrays of points: areas, clipping, grid-binned joins, distances along lines.

Rings are ``ARRAY<STRUCT<x,y>>``, open or closed; the first ring of a polygon is its outline. Joins of
points with shapes go through grid cells, so they are hash joins; no plan compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive if counter-clockwise."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2.0


def polygon_area(rings: Column) -> Column:
    """Outline less holes."""
    areas = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))), F.get(areas, F.lit(0)), lambda a, v: a - v)


def _turned(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def centroid(rings: Column) -> Column:
    """Centre of area of a polygon, holes counted out; null without area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    total = lambda ring, f: F.aggregate(F.zip_with(ring, _turned(ring), f), F.lit(0.0), lambda a, v: a + v)
    # Each ring adds its moments with the sign that makes the outline positive and holes negative.
    sign = lambda ring, k: F.signum(signed_area(ring)) * F.when(k == 0, 1.0).otherwise(-1.0)
    moment = lambda c: F.aggregate(F.transform(rings, lambda r, k: sign(r, k) * total(r, lambda p, q: (p[c] + q[c]) * cross(p, q))), F.lit(0.0), lambda a, v: a + v)
    area = F.aggregate(F.transform(rings, lambda r, k: sign(r, k) * total(r, cross)), F.lit(0.0), lambda a, v: a + v)
    safe = F.when(area != 0, 3.0 * area)
    return F.struct((moment("x") / safe).alias("x"), (moment("y") / safe).alias("y"))


def point_inside(rings: Column) -> Column:
    """A point within the polygon: the middle of the widest stretch on the line half way up its box."""
    ys = F.transform(F.get(rings, F.lit(0)), lambda p: p["y"])
    y = (F.array_min(ys) + F.array_max(ys)) / 2
    crossing = lambda p, q: F.when((p["y"] > y) != (q["y"] > y), (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"])
    xs = F.array_sort(F.array_compact(F.flatten(F.transform(rings, lambda r: F.zip_with(r, _turned(r), crossing)))))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1), lambda k: F.struct((F.get(xs, 2 * k + 1) - F.get(xs, 2 * k)).alias("w"), ((F.get(xs, 2 * k) + F.get(xs, 2 * k + 1)) / 2).alias("m")))
    return F.struct(F.when(F.size(xs) > 1, F.array_max(pairs)["m"]).alias("x"), y.alias("y"))


def usable(features: DataFrame, kinds: tuple[str, ...], kind: str = "geom_type", rings: str = "rings") -> DataFrame:
    """Features of the given types with a geometry: polygons of some area, lines of two points, points."""
    own = F.col(rings)
    fine = F.when(F.col(kind).contains("Polygon"), polygon_area(own) > 0).when(F.col(kind).contains("Line"), F.size(F.get(own, F.lit(0))) > 1).otherwise(F.size(F.get(own, F.lit(0))) > 0)
    return features.where(F.col(kind).isin(*kinds) & own.isNotNull() & (F.size(own) > 0) & F.coalesce(fine, F.lit(False)))


def repaired_rings(rings: Column) -> Column:
    """Rings without repeated and closing points; holes without area go, and so does a polygon whose outline has none."""
    once = F.transform(rings, lambda r: F.filter(F.zip_with(r, F.concat(F.slice(r, -1, 1), r), lambda p, q: F.when(p.isNotNull() & ((p["x"] != q["x"]) | (p["y"] != q["y"])), p)), lambda p: p.isNotNull()))
    good = lambda r: (F.size(F.array_distinct(r)) > 2) & (signed_area(r) != 0)
    return F.when(good(F.get(once, F.lit(0))), F.filter(once, good))


POINTS = "array<struct<x:double,y:double>>"


def _cut(ring: Column, plane: Column) -> Column:
    """One half-plane of a clip. Every edge gives its crossing and its end if that is kept."""
    along = lambda p: F.when(plane["vertical"], p["x"]).otherwise(p["y"])
    inside = lambda p: F.when(plane["above"], along(p) >= plane["at"]).otherwise(along(p) <= plane["at"])
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def crossing(p: Column, q: Column) -> Column:
        t = (plane["at"] - along(p)) / F.when(along(q) != along(p), along(q) - along(p))
        x, y = p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"])
        return point(F.when(plane["vertical"], plane["at"]).otherwise(x), F.when(plane["vertical"], y).otherwise(plane["at"]))

    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    none = F.array().cast(POINTS)
    edge = F.zip_with(before, ring, lambda p, q: F.concat(F.when(inside(p) != inside(q), F.array(crossing(p, q))).otherwise(none), F.when(inside(q), F.array(point(q["x"], q["y"]))).otherwise(none)))
    return F.when(F.size(ring) > 0, F.flatten(edge)).otherwise(none).cast(POINTS)


def clip_ring(table: DataFrame, ring: str, min_x: float, min_y: float, max_x: float, max_y: float, out: str = "clipped") -> DataFrame:
    """Ring cut to a rectangle (Sutherland-Hodgman), one fold over its four sides. Areas are exact; a concave ring may keep edges along the border."""
    planes = F.array(*(F.struct(F.lit(v).alias("vertical"), F.lit(float(at)).alias("at"), F.lit(up).alias("above")) for v, at, up in ((True, min_x, True), (True, max_x, False), (False, min_y, True), (False, max_y, False))))
    own = F.col(ring).cast(POINTS)
    xs, ys = F.transform(own, lambda p: p["x"]), F.transform(own, lambda p: p["y"])
    boxed = table.withColumn("_b", F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")))
    held = (F.col("_b.x0") >= min_x) & (F.col("_b.x1") <= max_x) & (F.col("_b.y0") >= min_y) & (F.col("_b.y1") <= max_y)
    apart = (F.col("_b.x1") < min_x) | (F.col("_b.x0") > max_x) | (F.col("_b.y1") < min_y) | (F.col("_b.y0") > max_y)
    # Only shapes that cross the border pay for the fold.
    return boxed.withColumn(out, F.when(held, own).when(apart, F.array().cast(POINTS)).otherwise(F.aggregate(planes, own, _cut))).drop("_b")


def clip_fraction_filter(table: DataFrame, ring: str, box: tuple[float, float, float, float], threshold: float = 0.5) -> DataFrame:
    """Shapes with at least ``1 - threshold`` of their area in the box; adds ``clipped, area, inside_fraction``."""
    cut = clip_ring(table, ring, *box)
    cut = cut.withColumn("area", F.abs(signed_area(F.col(ring)))).where("area > 0")
    cut = cut.withColumn("inside_fraction", F.abs(signed_area(F.col("clipped"))) / F.col("area"))
    return cut.where((F.size("clipped") > 0) & (F.col("inside_fraction") >= 1.0 - threshold))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test by a ray to the right."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    hit = F.zip_with(ring, turned, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"]))
    return F.aggregate(hit, F.lit(0), lambda a, h: a + F.coalesce(h, F.lit(False)).cast("int")) % 2 == 1


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    on = F.zip_with(ring, turned, lambda p, q: ((q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])))
    return F.exists(on, lambda h: h)


def strictly_inside(x: Column, y: Column, rings: Column) -> Column:
    """Inside the outline, outside all holes, on no border."""
    count = F.aggregate(F.transform(rings, lambda r: inside_ring(x, y, r).cast("int")), F.lit(0), lambda a, v: a + v)
    return (count % 2 == 1) & ~F.exists(rings, lambda r: on_ring(x, y, r))


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def binned(shapes: DataFrame, box: tuple[str, str, str, str], cell: float) -> DataFrame:
    """Shapes repeated for every grid cell that their box touches."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return shapes.withColumn("_cx", F.explode(_cells(x0, x1, cell))).withColumn("_cy", F.explode(_cells(y0, y1, cell)))


BOX = ("min_x", "min_y", "max_x", "max_y")


def _held(places: DataFrame, boxes: DataFrame, cell: float, closed: bool) -> DataFrame:
    """Pairs of rows of ``places`` and ``boxes`` where the box holds the place; the other columns of both stay."""
    left = places.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    both = left.join(binned(boxes, BOX, cell), ["_cx", "_cy"])
    if closed:
        held = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    else:
        held = (F.col("x") > F.col("min_x")) & (F.col("x") < F.col("max_x")) & (F.col("y") > F.col("min_y")) & (F.col("y") < F.col("max_y"))
    return both.where(held).drop("_cx", "_cy")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float, closed: bool = False) -> DataFrame:
    """Pairs of points ``x, y`` and boxes ``min_x .. max_y`` that hold them, borders excluded unless ``closed``.

    Equal places and equal boxes are compared once; their rows are joined to the pairs found.
    """
    found = _held(points.select("x", "y").distinct(), boxes.select(*BOX).distinct(), cell, closed)
    both = points.join(found, ["x", "y"]).join(boxes, list(BOX))
    return both.select(*points.columns, *boxes.columns)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of points and polygons (``rings``) that strictly hold them. Equal places and equal polygons are compared once."""
    xs = lambda f, c: f(F.transform(F.get("rings", F.lit(0)), lambda p: p[c]))
    shapes = polygons.select("rings").distinct()
    boxed = shapes.select("*", *(xs(f, c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.array_min), ("max", F.array_max))))
    both = _held(points.select("x", "y").distinct(), boxed, cell, True)
    found = both.where(strictly_inside(F.col("x"), F.col("y"), F.col("rings"))).select("x", "y", "rings")
    others = [c for c in polygons.columns if c != "rings"]
    return points.join(found, ["x", "y"]).join(polygons, ["rings"]).select(*points.columns, *others)


def rasterise(cells: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Cells whose centre ``x, y`` lies strictly inside any polygon."""
    hit = points_in_polygons(cells.select("x", "y").distinct(), polygons.select("rings").distinct(), cell).select("x", "y").distinct()
    return cells.join(hit, ["x", "y"], "left_semi")


def last_at(points: DataFrame, bodies: DataFrame, value: str, order: str, cell: float, closed: bool = False) -> DataFrame:
    """``x, y`` of the places that a body holds and, as ``_last``, value and order of the last such body. Of bodies with equal boxes only the last is compared."""
    last = bodies.groupBy(*BOX).agg(F.max_by(F.struct(value, order), order).alias("_last"))
    return _held(points.select("x", "y").distinct(), last, cell, closed).groupBy("x", "y").agg(F.max_by("_last", F.col("_last")[order]).alias("_last"))


def last_wins(points: DataFrame, bodies: DataFrame, key: str, value: str, order: str, cell: float) -> DataFrame:
    """Per point, the value of the last body that holds it."""
    both = points.join(last_at(points, bodies, value, order, cell), ["x", "y"])
    return both.groupBy(key).agg(F.max_by(F.col("_last")[value], F.col("_last")[order]).alias(value))


def box_overlaps(boxes: DataFrame, cell: float, key: str = "box_id", least: float = 1e-8, block: int = 1024) -> DataFrame:
    """Pairs ``a < b`` of boxes that share more than ``least`` area, each found in the lowest cell both touch.

    Equal boxes are compared once. The numbers of their rows travel with them to the cells, in lists of about ``block``, and each two
    lists meet once and are written out there, so shuffles and memory grow with the boxes, not with the pairs.
    """
    # Lists of a box's rows: as many as its rows fill, dealt by a hash of the row.
    counts = boxes.groupBy(*BOX).agg(F.ceil(F.count("*") / block).alias("_n"))
    lists = boxes.join(counts, list(BOX)).groupBy(*BOX, F.expr(f"pmod(xxhash64({key}), _n)").alias("_part")).agg(F.collect_list(key).alias("_keys"))
    named = lambda n: lists.select(*(F.col(c).alias(f"{n}_{c}") for c in BOX), F.col("_part").alias(f"{n}_part"), F.col("_keys").alias(f"{n}_keys"))
    # In as many tasks as are set: adaptive execution would join them by the size of the lists, and the pairs are many times larger.
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda n: binned(named(n), tuple(f"{n}_{c}" for c in BOX), cell).repartition(tasks, "_cx", "_cy")
    both = side("a").join(side("b"), ["_cx", "_cy"])
    first = (F.col("_cx") == F.floor(F.greatest("a_min_x", "b_min_x") / cell)) & (F.col("_cy") == F.floor(F.greatest("a_min_y", "b_min_y") / cell))
    w = F.least("a_max_x", "b_max_x") - F.greatest("a_min_x", "b_min_x")
    h = F.least("a_max_y", "b_max_y") - F.greatest("a_min_y", "b_min_y")
    own = lambda n: F.struct(*(F.col(f"{n}_{c}") for c in (*BOX, "part")))
    met = both.where(first & (w > 0) & (h > 0) & (w * h > least) & (own("a") <= own("b"))).select((w * h).alias("area"), (own("a") == own("b")).alias("_same"), "a_keys", "b_keys")
    pairs = met.select("area", "_same", "b_keys", F.explode("a_keys").alias("_a")).select("area", "_same", "_a", F.explode("b_keys").alias("_b"))
    # A list that meets itself gives each pair both ways round.
    return pairs.where("_a < _b OR (_b < _a AND NOT _same)").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "area")


def segments(points: DataFrame, key: str = "route_id", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """Consecutive pairs of a line's points with the length along the line before each."""
    along = Window.partitionBy(key).orderBy("seq")
    pairs = points.select(key, "seq", F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(along).alias("x1"), F.lead(y).over(along).alias("y1")).where("x1 is not null")
    pairs = pairs.withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    before = F.coalesce(F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return pairs.withColumn("station", before)


def clip_segments(pairs: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Segments cut to a rectangle (Liang-Barsky): ``t0, t1`` are the kept part's ends; segments outside go."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    lows, highs, open_ = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for p, q in ((-dx, F.col("x0") - min_x), (dx, F.lit(max_x) - F.col("x0")), (-dy, F.col("y0") - min_y), (dy, F.lit(max_y) - F.col("y0"))):
        t = q / F.when(p != 0, p)
        lows.append(F.when(p < 0, t).otherwise(0.0))
        highs.append(F.when(p > 0, t).otherwise(1.0))
        open_ = open_ & ((p != 0) | (q >= 0))
    cut = pairs.withColumn("t0", F.greatest(*lows)).withColumn("t1", F.least(*highs)).where(open_ & (F.col("t0") <= F.col("t1")))
    at = lambda t, c, d: F.col(c) + F.col(t) * d
    return cut.select(*pairs.columns, "t0", "t1", *(at(t, c, d).alias(f"{n}{i}") for i, t in enumerate(("t0", "t1")) for n, c, d in (("cx", "x0", dx), ("cy", "y0", dy))))


def project_to_lines(points: DataFrame, pairs: DataFrame, key: str = "route_id", point_key: str = "point_id") -> DataFrame:
    """Nearest station of each point on its own line, the earliest segment winning ties.

    Points meet the segments of their own line only; with long lines, bin both with :func:`binned` first. The least distance comes
    first, as a plain number that needs no sort, and then the segments that have it, so no pair of a point and a segment is kept.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.when(size > 0, size)))).otherwise(0.0)
    gap = F.hypot(F.col("x") - F.col("x0") - t * dx, F.col("y") - F.col("y0") - t * dy)
    points, pairs = points.select(key, point_key, "x", "y"), pairs.select(key, "seq", "station", "length", "x0", "y0", "x1", "y1")
    least = points.join(pairs, key).groupBy(key, point_key).agg(F.min(gap).alias("distance"))
    nearest = points.join(least, [key, point_key]).join(pairs, key).where(gap.eqNullSafe(F.col("distance")))
    first = F.min(F.struct("seq", (F.col("station") + t * F.col("length")).alias("station")))
    return nearest.groupBy(key, point_key).agg(F.min("distance").alias("distance"), first.alias("b")).select(key, point_key, "distance", "b.station")


def _line_bins(pairs: DataFrame, half: float, cell: float) -> DataFrame:
    """Segments repeated for the grid cells, column by column, that places within ``half`` of them can lie in."""
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    reach = half * (1 + 1e-9) + 1e-9
    low, high = F.least(x0, x1), F.greatest(x0, x1)
    wide = pairs.withColumn("_cx", F.explode(_cells(low - reach, high + reach, cell)))
    rise = (y1 - y0) / F.when(x1 != x0, x1 - x0)
    # The stretch of the segment from which this column can be reached, and its heights.
    ends = [y0 + rise * (x - x0) for x in (F.greatest(low, F.least(high, F.col("_cx") * cell - reach)), F.least(high, F.greatest(low, (F.col("_cx") + 1) * cell + reach)))]
    bottom, top = (F.coalesce(f(*ends), f(y0, y1)) for f in (F.least, F.greatest))
    bottom, top = F.when(x1 != x0, bottom).otherwise(F.least(y0, y1)), F.when(x1 != x0, top).otherwise(F.greatest(y0, y1))
    return wide.withColumn("_cy", F.explode(_cells(bottom - reach, top + reach, cell)))


#: So many distinct places, and so many cells in lists, are sent to all tasks (2 MB, and 16 MB for cells with one number each); more meet the lines by shuffles.
FEW_PLACES, FEW_CELLS = 131_072, 2_097_152


def _line_hits(cells: DataFrame, pairs: DataFrame, width: float, key: str, flat: bool, cell: float | None, few: bool = False) -> DataFrame:
    """``x, y`` and ``key`` of segments within half a width of the distinct places of ``cells``; a place may come up more than once.

    ``few`` tells that there are at most ``FEW_PLACES`` places: the lines then stay where they are, dealt by ``key``.
    """
    size = cell or max(width, 1.0)
    half = width / 2
    end = lambda f: F.col("seq") == f("seq").over(Window.partitionBy(key)) if flat else F.lit(None).cast("boolean")
    lines = _line_bins(pairs.select(key, "x0", "y0", "x1", "y1", end(F.min).alias("_first"), end(F.max).alias("_last")), half, size)
    places = cells.select("x", "y").distinct().withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    both = lines.join(F.broadcast(places), ["_cx", "_cy"]) if few else places.join(lines, ["_cx", "_cy"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy
    raw = ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.when(square > 0, square)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))
    near = F.hypot(F.col("x") - F.col("x0") - t * dx, F.col("y") - F.col("y0") - t * dy) <= half
    beyond = ((raw < 0) & F.col("_first")) | ((raw > 1) & F.col("_last"))
    kept = both.where(near & ~F.coalesce(beyond, F.lit(False))) if flat else both.where(near)
    return kept.select("x", "y", key)


def route_membership(cells: DataFrame, pairs: DataFrame, width: float, key: str = "route_id", flat: bool = True, cell: float | None = None) -> DataFrame:
    """Cells ``x, y`` within half a width of a line; ``flat`` ends do not reach beyond the line's first and last point.

    Segments and places meet through grid bins of at least the width. Equal places are compared once; their cells are written out from
    lists where a place has met a line. Places and lists of proven size go to the lines, so neither what is found nor the pairs of
    segments and bins are shuffled. A job counts places and cells when this is called.
    """
    own = cells.distinct()
    n_cells, n_places = own.groupBy("x", "y").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hits = _line_hits(cells, pairs, width, key, flat, cell, n_places <= FEW_PLACES).distinct()
    others = [c for c in cells.columns if c not in ("x", "y")]
    if not others:
        return hits.where("x IS NOT NULL AND y IS NOT NULL").select(*cells.columns, key)
    part = F.pmod(F.xxhash64(*others), F.ceil(F.count("*").over(Window.partitionBy("x", "y")) / 1024))
    lists = own.withColumn("_part", part).groupBy("x", "y", "_part").agg(F.collect_list(F.struct(*others)).alias("_cells")).drop("_part")
    met = hits.join(F.broadcast(lists) if n_cells <= FEW_CELLS else lists, ["x", "y"])
    return met.withColumn("_cell", F.explode("_cells")).select(*("_cell." + c if c in others else c for c in cells.columns), key)


def line_cells(cells: DataFrame, pairs: DataFrame, width: float, key: str = "route_id", flat: bool = True, cell: float | None = None) -> DataFrame:
    """Cells that :func:`route_membership` finds on any line, without the lines."""
    hits = _line_hits(cells, pairs, width, key, flat, cell).select("x", "y").distinct()
    return cells.distinct().join(hits, ["x", "y"], "left_semi").select(*cells.columns)


def near_stations(points: DataFrame, pairs: DataFrame, reach: float, key: str = "route_id", point_key: str = "vid") -> DataFrame:
    """Nearest station of each point on its own line, for points within ``reach`` of it; of equal distances the earliest segment.

    Points and segments meet through grid bins, so a long line costs no more than its neighbourhoods. Points further away have no row.
    """
    boxed = pairs.select(key, "seq", "x0", "y0", "x1", "y1", "length", "station", *((f(a, b) + s * reach).alias(n) for n, f, a, b, s in (("min_x", F.least, "x0", "x1", -1), ("max_x", F.greatest, "x0", "x1", 1), ("min_y", F.least, "y0", "y1", -1), ("max_y", F.greatest, "y0", "y1", 1))))
    asked = points.select(F.col(key).alias("_own"), point_key, "x", "y")
    both = _held(asked, boxed, max(4 * reach, 1.0), True).where(F.col("_own") == F.col(key))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = dx * dx + dy * dy
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.when(size > 0, size))), F.lit(0.0))
    gap = F.hypot(F.col("x") - F.col("x0") - t * dx, F.col("y") - F.col("y0") - t * dy)
    best = F.min(F.struct(gap.alias("distance"), F.col("seq").alias("seq"), (F.col("station") + t * F.col("length")).alias("station")))
    return both.groupBy(key, point_key).agg(best.alias("b")).where(F.col("b.distance") <= reach).select(key, point_key, "b.station")


def roads_without_route(cells: DataFrame, roads: DataFrame, route: DataFrame, road_width: float, route_width: float, cell: float | None = None) -> DataFrame:
    """Cells of roads (round ends) that no route (flat ends) covers; ``roads`` and ``route`` are segments."""
    road = line_cells(cells, roads, road_width, flat=False, cell=cell)
    covered = _line_hits(cells, route, route_width, "route_id", True, cell).select("x", "y").distinct()
    return road.join(covered, ["x", "y"], "left_anti").select(*cells.columns)


def near_points(cells: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """Cells ``x, y`` within a distance of any point ``px, py``; cells and points meet through grid bins of that size."""
    if distance <= 0:
        raise ValueError("the buffer must be positive")
    discs = points.select("px", "py").distinct().selectExpr("px", "py", f"px - {distance} AS min_x", f"px + {distance} AS max_x", f"py - {distance} AS min_y", f"py + {distance} AS max_y")
    both = _held(cells.select("x", "y").distinct(), discs, max(distance, 1.0), True)
    hits = both.where(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= distance).select("x", "y").distinct()
    return cells.distinct().join(hits, ["x", "y"], "left_semi").select(*cells.columns)


def evidence_cells(cells: DataFrame, points: DataFrame, lines: DataFrame, distance: float, cell: float | None = None) -> DataFrame:
    """Cells within ``distance`` of point features or of line features (segments); polygons are no evidence."""
    return near_points(cells, points, distance).unionByName(line_cells(cells, lines, 2 * distance, flat=False, cell=cell)).distinct()

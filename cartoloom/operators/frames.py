"""Print frames of routes: fitting, transforms both ways, query bounds, suggestions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import project, rotate, unproject

# Route height by profile, slope limit by slicer layer height.
ROUTE_HEIGHTS = {"urban": 2.0, "landscape": 1.2}
LAYER_SLOPES = ((0.08, 0.16), (0.12, 0.24), (0.16, 0.30), (0.20, 0.35), (0.24, 0.40), (0.28, 0.45))


@dataclass(frozen=True)
class Plate:
    """Print size in millimetres, margin, and rotation of the map under it."""

    width: float
    height: float
    margin: float = 0.0
    rotation: float = 0.0
    padding: float = 0.0

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0:
            raise ValueError("print dimensions must be positive")
        if self.padding < 0:
            raise ValueError("route padding cannot be negative")
        if min(self.inner) <= 0:
            raise ValueError("margin is too large for the print dimensions")
        if min(self.inner) - 2 * self.padding <= 0:
            raise ValueError("route padding is too large for the print dimensions")

    @property
    def inner(self) -> tuple[float, float]:
        return self.width - 2 * self.margin, self.height - 2 * self.margin

    def for_border(self, flat_border: bool) -> "Plate":
        """Without a flat border the margin is nothing."""
        return self if flat_border or self.margin == 0 else replace(self, margin=0.0)


def extents(points: DataFrame, key: str = "route_id") -> DataFrame:
    """Bounds of each route in degrees."""
    return points.groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n_points"))


def centred(points: DataFrame, key: str = "route_id") -> DataFrame:
    """Points with their route's centre and metres around it."""
    middle = extents(points, key).select(F.col(key), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("center_lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("center_lon"))
    both = points.join(middle, key)
    x, y = project(F.col("lat"), F.col("lon"), F.col("center_lat"), F.col("center_lon"))
    return both.withColumn("x_m", x).withColumn("y_m", y)


def fit_frames(points: DataFrame, plate: Plate, key: str = "route_id") -> DataFrame:
    """One frame a route: centre of its extremes, and the smallest coverage that holds it in the plate's aspect."""
    around = centred(points, key)
    rx, ry = rotate(F.col("x_m"), F.col("y_m"), F.lit(-plate.rotation))
    spans = around.withColumn("rx", rx).withColumn("ry", ry).groupBy(key, "center_lat", "center_lon").agg((F.max("rx") - F.min("rx")).alias("span_x"), (F.max("ry") - F.min("ry")).alias("span_y"))
    width, height = plate.inner
    scale = F.greatest(F.col("span_x") / (width - 2 * plate.padding), F.col("span_y") / (height - 2 * plate.padding), F.lit(1e-6))
    return spans.select(key, "center_lat", "center_lon", (scale * width).alias("coverage_width_m"), (scale * height).alias("coverage_height_m"))


def to_print(x_m: Column, y_m: Column, width_m: Column, height_m: Column, plate: Plate) -> tuple[Column, Column]:
    """Metres around a frame's centre to millimetres from the plate's lower left corner."""
    rx, ry = rotate(x_m, y_m, F.lit(-plate.rotation))
    width, height = plate.inner
    return plate.width / 2.0 + rx * (F.lit(width) / width_m), plate.height / 2.0 + ry * (F.lit(height) / height_m)


def from_print(x_mm: Column, y_mm: Column, frame: dict[str, Column], plate: Plate) -> tuple[Column, Column]:
    """Latitude and longitude of plate millimetres. ``frame`` holds center_lat, center_lon, coverage_width_m, coverage_height_m."""
    width, height = plate.inner
    ax = (x_mm - plate.width / 2.0) * (frame["coverage_width_m"] / width)
    ay = (y_mm - plate.height / 2.0) * (frame["coverage_height_m"] / height)
    x, y = rotate(ax, ay, F.lit(plate.rotation))
    return unproject(x, y, frame["center_lat"], frame["center_lon"])


def frame_points(points: DataFrame, plate: Plate, key: str = "route_id") -> DataFrame:
    """Every point of every route in millimetres on its own fitted frame.

    Two grouped minima and maxima and two joins on the route; a route of any length is handled by
    partial aggregation.
    """
    frames = fit_frames(points, plate, key)
    both = points.join(frames, key)
    x, y = project(F.col("lat"), F.col("lon"), F.col("center_lat"), F.col("center_lon"))
    x_mm, y_mm = to_print(x, y, F.col("coverage_width_m"), F.col("coverage_height_m"), plate)
    return both.select(*points.columns, x_mm.alias("x_mm"), y_mm.alias("y_mm"))


def box_transform(points: DataFrame, width: float, height: float, margin: float = 0.0, key: str = "route_id", centre: bool = True) -> DataFrame:
    """Uniform scale and offsets that fit ``x_m, y_m`` into a box: to its lower corner, or centred inside a margin.

    A span of zero asks for scale 1; if both are zero the scale is 1 and the offset is the margin.
    """
    inner_w, inner_h = width - 2 * margin, height - 2 * margin
    if inner_w <= 0 or inner_h <= 0:
        raise ValueError("margin is too large for the map dimensions")
    box = points.groupBy(key).agg(F.min("x_m").alias("min_x"), F.max("x_m").alias("max_x"), F.min("y_m").alias("min_y"), F.max("y_m").alias("max_y"))
    span_x, span_y = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    point = (span_x == 0) & (span_y == 0)
    side = lambda span, room: F.when(span > 0, F.lit(room) / span).otherwise(1.0)
    scale = F.when(point, 1.0).otherwise(F.least(side(span_x, inner_w), side(span_y, inner_h)))
    box = box.withColumn("scale", scale)
    lift = lambda span, room: F.when(point | F.lit(not centre), F.lit(margin)).otherwise(F.lit(margin) + (F.lit(room) - span * F.col("scale")) / 2)
    return box.select(key, "scale", "min_x", "min_y", lift(span_x, inner_w).alias("offset_x"), lift(span_y, inner_h).alias("offset_y"))


def apply_box(points: DataFrame, transform: DataFrame, key: str = "route_id") -> DataFrame:
    both = points.join(transform, key)
    return both.select(*points.columns, ((F.col("x_m") - F.col("min_x")) * F.col("scale") + F.col("offset_x")).alias("x_mm"), ((F.col("y_m") - F.col("min_y")) * F.col("scale") + F.col("offset_y")).alias("y_mm"))


def query_bounds(frames: DataFrame, plate: Plate, key: str = "route_id") -> DataFrame:
    """Geographic box of the printable corners, and half the coverage diagonal as a radius."""
    m = plate.margin
    corners = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x in (m, plate.width - m) for y in (m, plate.height - m)))
    rows = frames.select("*", F.explode(corners).alias("corner"))
    lat, lon = from_print(F.col("corner.x"), F.col("corner.y"), {c: F.col(c) for c in ("center_lat", "center_lon", "coverage_width_m", "coverage_height_m")}, plate)
    return rows.select(key, lat.alias("lat"), lon.alias("lon"), (F.hypot("coverage_width_m", "coverage_height_m") / 2).alias("r")).groupBy(key).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.first("r").alias("radius_m"))


def suggest_frames(points: DataFrame, key: str = "route_id") -> DataFrame:
    """A frame with 12 % air, at least 10 m a side before that, landscape if it is wider than high."""
    spans = centred(points, key).groupBy(key, "center_lat", "center_lon").agg((F.max("x_m") - F.min("x_m")).alias("w"), (F.max("y_m") - F.min("y_m")).alias("h"))
    spans = spans.withColumn("w", F.greatest("w", F.lit(10.0)) * 1.12).withColumn("h", F.greatest("h", F.lit(10.0)) * 1.12)
    wide = F.col("w") >= F.col("h")
    spans = spans.withColumn("print_width_mm", F.when(wide, 240.0).otherwise(190.0)).withColumn("print_height_mm", F.when(wide, 190.0).otherwise(240.0))
    aspect = F.col("print_width_mm") / F.col("print_height_mm")
    narrow = F.col("w") / F.col("h") < aspect
    return spans.select(key, "center_lat", "center_lon", F.when(narrow, F.col("h") * aspect).otherwise(F.col("w")).alias("coverage_width_m"), F.when(narrow, F.col("h")).otherwise(F.col("w") / aspect).alias("coverage_height_m"), "print_width_mm", "print_height_mm")


def orientation(points: DataFrame, key: str = "route_id") -> DataFrame:
    """Landscape only if a route's metres are wider than high."""
    return centred(points, key).groupBy(key).agg(F.when(F.max("x_m") - F.min("x_m") > F.max("y_m") - F.min("y_m"), "landscape").otherwise("portrait").alias("orientation"))


def route_lines(points: DataFrame, key: str = "route_id") -> DataFrame:
    """Bounds and a GeoJSON line of each route, its points in order. A route is one row: its length bounds the cell."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    made = points.groupBy(key).agg(ordered.alias("xy"), F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    line = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("xy").alias("coordinates")).alias("geometry"))
    return made.select(key, "south", "west", "north", "east", F.to_json(line).alias("geojson"))


def preview_warnings(printed: DataFrame, plate: Plate, key: str = "route_id") -> DataFrame:
    """Whether a route misses the printable box or will be clipped; a segment that crosses a corner counts as inside."""
    from .spatial import clip_segments, segments

    m = plate.margin
    pieces = clip_segments(segments(printed, key), m, m, plate.width - m, plate.height - m)
    kept = pieces.groupBy(key).agg(F.count("t0").alias("inside"))
    out = F.max(((F.col("x_mm") < m) | (F.col("x_mm") > plate.width - m) | (F.col("y_mm") < m) | (F.col("y_mm") > plate.height - m)).cast("int"))
    left = printed.groupBy(key).agg(out.alias("outside")).join(kept, key, "left")
    text = F.when(F.coalesce("inside", F.lit(0)) == 0, "The route does not intersect the selected frame.").when(F.col("outside") == 1, "Part of the route is outside the selected frame and will be clipped.")
    return left.select(key, text.alias("warning"))


def markers(printed: DataFrame, mode: str = "both", near_mm: float = 1.0, key: str = "route_id") -> DataFrame:
    """Start and finish of each route; a finish next to the start is left to the start's marker."""
    if mode not in ("none", "start", "finish", "both"):
        raise ValueError(f"unsupported route marker mode: {mode!r}")
    if near_mm < 0:
        raise ValueError("near-loop tolerance must be non-negative")
    ends = printed.groupBy(key).agg(*(f(F.struct("x_mm", "y_mm"), "seq").alias(n) for n, f in (("start", F.min_by), ("finish", F.max_by))))
    gap = F.hypot(F.col("finish.x_mm") - F.col("start.x_mm"), F.col("finish.y_mm") - F.col("start.y_mm"))
    pick = []
    if mode in ("start", "both"):
        pick.append(F.struct(F.lit("start").alias("marker"), F.col("start").alias("at"), F.lit(True).alias("on")))
    if mode in ("finish", "both"):
        pick.append(F.struct(F.lit("finish").alias("marker"), F.col("finish").alias("at"), (F.lit(mode == "finish") | (gap > near_mm)).alias("on")))
    if not pick:
        return ends.select(key, F.lit("").alias("marker"), F.col("start.x_mm"), F.col("start.y_mm")).limit(0)
    return ends.select(key, F.explode(F.array(*pick)).alias("m")).where("m.on").select(key, "m.marker", "m.at.x_mm", "m.at.y_mm")


def route_height(profile: str, override: float | None = None) -> float:
    if profile not in ROUTE_HEIGHTS:
        raise ValueError(f"unsupported style profile: {profile}")
    height = ROUTE_HEIGHTS[profile] if override is None else float(override)
    if height <= 0:
        raise ValueError("route height must be positive")
    return height


def route_slope(layer_height: Column) -> Column:
    """Slope of the nearest tested layer height; the lower one of two at equal distance."""
    table = F.array(*(F.struct(F.abs(F.lit(h) - layer_height).alias("gap"), F.lit(i).alias("i"), F.lit(s).alias("slope")) for i, (h, s) in enumerate(LAYER_SLOPES)))
    return F.array_min(table)["slope"]


def embedded(visible: Column, base: Column, embed: Column) -> Column:
    """Extrusion height, bottom and effective depth of a raised feature."""
    depth = F.least(base, embed)
    return F.struct((visible + depth).alias("height"), (-depth).alias("bottom"), depth.alias("embed"))


def rings_on_plate(table: DataFrame, rings: str, plate: Plate, out: str = "rings_mm") -> DataFrame:
    """Polygons in degrees (x longitude, y latitude) as millimetres, ring by ring; needs the frame's four columns."""

    def moved(p: Column) -> Column:
        x, y = project(p["y"], p["x"], F.col("center_lat"), F.col("center_lon"))
        x_mm, y_mm = to_print(x, y, F.col("coverage_width_m"), F.col("coverage_height_m"), plate)
        return F.struct(x_mm.alias("x"), y_mm.alias("y"))

    return table.withColumn(out, F.transform(F.col(rings), lambda r: F.transform(r, moved)))


def clipped_lines(printed: DataFrame, plate: Plate, key: str = "route_id") -> DataFrame:
    """Segments of lines on the plate, cut to its printable box."""
    from .spatial import clip_segments, segments

    m = plate.margin
    return clip_segments(segments(printed, key), m, m, plate.width - m, plate.height - m)

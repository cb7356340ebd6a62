"""Readers of tracks, map features and rasters. All of them read with Spark, so any store Spark reaches will do."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import exposed, plausible_elevation, recode
from ..operators.spatial import inside_ring, point_inside

_GPX = "trk array<struct<trkseg: array<struct<trkpt: array<struct<_lat: double, _lon: double, ele: double>>>>>>"


def read_gpx(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """``route_id, seq, lat, lon, ele`` of every track point in document order, over all tracks and segments.

    A file is a route, named by its path. Without any point and with ``required`` it is an error.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("route_id"), "value")
    out = gpx_points(files, "route_id", "value")
    if required and out.isEmpty():
        raise ValueError(f"no track points in {path}")
    return out


def gpx_points(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``route_id, seq, lat, lon, ele`` of the track points of GPX documents held as texts, one pass over them.

    Documents with and without a namespace are read, whatever prefix their root and elements have: it is taken off the element names
    before parsing. Points without a position, and documents that are null or no well-formed GPX, give no rows.
    """
    text = F.regexp_replace(text_col, "^\\uFEFF", "")
    prefix = F.regexp_extract(text, r"<([A-Za-z_][A-Za-z0-9_.-]*:)gpx[\s>]", 1)
    plain = F.replace(F.replace(text, F.concat(F.lit("<"), prefix), F.lit("<")), F.concat(F.lit("</"), prefix), F.lit("</"))
    is_gpx = plain.rlike(r"<gpx[\s/>]")
    read = F.from_xml(F.when(is_gpx, F.when(prefix == "", text).otherwise(plain)), _GPX)
    each = lambda items, f: F.flatten(F.transform(F.coalesce(items, F.array()), f))
    points = each(F.col("_gpx.trk"), lambda t: each(t["trkseg"], lambda s: F.coalesce(s["trkpt"], F.array())))
    rows = documents.select(F.col(id_col).alias("route_id"), read.alias("_gpx")).select("route_id", F.posexplode(points).alias("seq", "p"))
    return rows.select("route_id", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele")).where("lat is not null and lon is not null")


_FEATURES = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def _as_parts(kind: F.Column, text: F.Column) -> F.Column:
    """Parts of any geometry as arrays of rings of ``x, y``; a point or line is one ring."""

    def levels(depth: int) -> F.Column:
        return F.from_json(text, "array<" * depth + "array<double>" + ">" * depth)

    xy = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    line = lambda a: F.transform(a, xy)
    rings = lambda a: F.transform(a, line)
    return (
        F.when(kind == "Point", F.array(F.array(F.array(xy(levels(0))))))
        .when(kind == "MultiPoint", F.transform(levels(1), lambda p: F.array(F.array(xy(p)))))
        .when(kind == "LineString", F.array(F.array(line(levels(1)))))
        .when(kind == "MultiLineString", F.transform(levels(2), lambda a: F.array(line(a))))
        .when(kind == "Polygon", F.array(rings(levels(2))))
        .when(kind == "MultiPolygon", F.transform(levels(3), rings))
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``feature_id, part_id, geom_type, tags, rings``: one row for each part of each feature.

    Coordinates stay text until their type is known, so one file may mix points, lines and polygons.
    Property values that are no text are read as their JSON; missing ones are dropped.
    """
    raw = spark.read.option("multiLine", True).schema(_FEATURES).json(path)
    f = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("n", "f")).where("f.geometry.type is not null")
    own = f.select(F.coalesce("f.id", F.concat("file", F.lit("#"), F.col("n").cast("string"))).alias("feature_id"), F.col("f.geometry.type").alias("geom_type"), F.map_filter(F.coalesce("f.properties", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()).alias("tags"), _as_parts(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("parts"))
    return own.select("feature_id", F.posexplode("parts").alias("part_id", "rings"), "geom_type", "tags").where(F.size(F.flatten("rings")) > 0)


_ELEMENT = "struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>"


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a stored query answer: ``feature_id, osm_type, osm_id, tags, part_id, rings``.

    A way of three or more points is a ring; a relation gives a part for each outer member, with those inner
    members as holes that lie in it (by a point inside each). Outers that touch stay apart; ``overlay.union`` makes them
    one. Nodes have no shape.
    """
    raw = spark.read.option("multiLine", True).schema(f"elements array<{_ELEMENT}>").json(path)
    e = raw.select(F.explode("elements").alias("e")).select("e.*")
    ring = lambda g: F.transform(g, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    fit = lambda m, role: F.transform(F.filter(F.coalesce(m, F.array()), lambda x: (x["role"] == role) & (F.size(x["geometry"]) >= 3)), lambda x: ring(x["geometry"]))
    way = F.when(F.size("geometry") >= 3, F.array(F.array(ring(F.col("geometry")))))
    marked = lambda r: F.struct(r.alias("ring"), point_inside(F.array(r)).alias("at"))
    inners = F.transform(fit(F.col("members"), "inner"), marked)
    held = lambda o: F.transform(F.filter(inners, lambda h: inside_ring(h["at"]["x"], h["at"]["y"], o)), lambda h: h["ring"])
    relation = F.transform(fit(F.col("members"), "outer"), lambda o: F.concat(F.array(o), held(o)))
    parts = F.when(F.col("type") == "way", way).when(F.col("type") == "relation", relation)
    own = e.select(F.concat("type", F.lit("/"), F.col("id").cast("string")).alias("feature_id"), F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), parts.alias("parts"))
    return own.select("feature_id", "osm_type", "osm_id", "tags", F.posexplode("parts").alias("part_id", "rings"))


def first_available(attempts: Sequence[tuple[str, Callable[[], DataFrame]]], warnings: list[str] | None = None) -> DataFrame | None:
    """The first source that can be read and is not empty; each failure adds a warning. None if all fail."""
    for name, attempt in attempts:
        try:
            found = attempt()
            if not found.isEmpty():
                return found
            problem = "no rows"
        except Exception as error:  # noqa: BLE001  a source may fail in any way; the next one is tried
            problem = str(error).splitlines()[0]
        if warnings is not None:
            warnings.append(f"{name}: {problem}")
    return None


def read_elevation(spark: SparkSession, path: str) -> DataFrame:
    """Stored elevation cells ``grid_id, row, col, elev``; implausible values become null. Row 0 is north."""
    return spark.read.parquet(path).withColumn("elev", plausible_elevation(F.col("elev").cast("double")))


def read_classes(spark: SparkSession, path: str, codes: dict[int, int]) -> DataFrame:
    """Stored land-cover codes ``grid_id, row, col, code`` as normalised classes. Row 0 is south."""
    raw = spark.read.parquet(path)
    out = raw.withColumn("class", recode(F.col("code"), codes)).drop("code")
    return out.withColumn("exposed", exposed(F.col("class")))


def exact_grid(cells: DataFrame, rows: int | None = None, columns: int | None = None, requests: DataFrame | None = None) -> DataFrame:
    """The cells, if every grid has exactly the shape asked for: one for all, or ``grid_id, rows, columns`` in ``requests``."""
    sizes = cells.groupBy("grid_id").agg(F.count("*").alias("n"), F.max("row").alias("r"), F.max("col").alias("c"))
    asked = sizes.withColumn("rows", F.lit(rows)).withColumn("columns", F.lit(columns)) if requests is None else sizes.join(requests.select("grid_id", "rows", "columns"), "grid_id", "full")
    # A grid that was not asked for, and one that is missing, have no number on one side.
    bad = asked.where(~F.coalesce((F.col("n") == F.col("rows") * F.col("columns")) & (F.col("r") == F.col("rows") - 1) & (F.col("c") == F.col("columns") - 1), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("land-cover grid does not match the request")
    return cells


def edition(items: DataFrame, year: str = "2023", order: str = "id") -> DataFrame:
    """Manifest items of one edition, in order of id or of another column."""
    kept = items.where(F.col("id").contains(year))
    return kept.withColumn("item_order", F.row_number().over(Window.partitionBy("grid_id").orderBy(order)))

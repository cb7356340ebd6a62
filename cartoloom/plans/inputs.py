"""Operator inputs derived from the shared tables by integer arithmetic, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUILDINGS = ("house", "apartments", "office", "Retail", "warehouse", "church", "garage", "stadium", "school", "yes", "shed", "hotel;commercial", "detached", "parking-garage")
ROADS = ("motorway", "primary_link", "residential", "service", "footway", "cycleway", "trunk", "unknown_way")
ROWS, COLUMNS = 100, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS route_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq", "event_id AS point_id", "29e0 + (event_id * 7919 % 100000) / 1e5 AS lat", "-95e0 + (event_id * 104729 % 100000) / 1e5 AS lon")


TRACKS = """tracks AS (SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id AS point_id,
  29e0 + (event_id * 7919 % 100000) / 1e5 AS lat, -95e0 + (event_id * 104729 % 100000) / 1e5 AS lon FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks in millimetres of their own, from integers."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS route_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq", "event_id AS point_id", "cast(event_id * 37 % 190 AS double) AS x_mm", "cast(event_id * 53 % 240 AS double) AS y_mm", "cast(event_id * 11 % 400 AS double) / 8 AS height")


LINES = """lines AS (SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id AS point_id,
  CAST(event_id * 37 % 190 AS DOUBLE) AS x_mm, CAST(event_id * 53 % 240 AS DOUBLE) AS y_mm, CAST(event_id * 11 % 400 AS DOUBLE) / 8 AS height FROM events)"""
SEGMENTS = LINES + """,
pairs AS (SELECT route_id, seq, x_mm AS x0, y_mm AS y0, lead(x_mm) OVER w AS x1, lead(y_mm) OVER w AS y1 FROM lines WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
segs AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS length FROM pairs WHERE x1 IS NOT NULL)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of 100 rows and 64 columns from the vectors: elevation, two class rasters and masks."""
    e = table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id / 100 AS int) AS grid_id", "cast(vec_id % 100 AS int) AS row", "posexplode(embedding) AS (col, e)")
    e = e.selectExpr("grid_id", "row", "col", "round(cast(e AS double) * 1000, 3) AS elev", "cast(floor(abs(cast(e AS double)) * 100) % 10 AS int) AS wc", "cast(floor(abs(cast(e AS double)) * 1000) % 10 AS int) AS io")
    return e.selectExpr("*", "wc = 8 OR io = 8 AS water", "(row * 7 + col) % 11 = 0 AS osm", "(row + col * 3) % 13 = 0 AS cliff", "wc = 1 AND io = 1 AS vegetation")


CELLS = """raw AS (SELECT CAST(vec_id // 100 AS INT) AS grid_id, CAST(vec_id % 100 AS INT) AS row, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INT) AS col, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings),
cells AS (SELECT *, wc = 8 OR io = 8 AS water, (row * 7 + col) % 11 = 0 AS osm, (row + col * 3) % 13 = 0 AS cliff, wc = 1 AND io = 1 AS vegetation
  FROM (SELECT grid_id, row, col, round(e * 1000, 3) AS elev, CAST(floor(abs(e) * 100) AS BIGINT) % 10 AS wc, CAST(floor(abs(e) * 1000) AS BIGINT) % 10 AS io FROM raw))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS box_id", "cast(o_orderkey * 37 % 1000 AS double) AS min_x", "cast(o_orderkey * 91 % 800 AS double) AS min_y", "cast(o_orderkey * 37 % 1000 + 1 + o_custkey % 9 AS double) AS max_x", "cast(o_orderkey * 91 % 800 + 1 + o_orderkey % 7 AS double) AS max_y", "cast(o_orderkey % 100 AS double) / 4 AS level_mm")


BOXES = """boxes AS (SELECT o_orderkey AS box_id, CAST(o_orderkey * 37 % 1000 AS DOUBLE) AS min_x, CAST(o_orderkey * 91 % 800 AS DOUBLE) AS min_y,
  CAST(o_orderkey * 37 % 1000 + 1 + o_custkey % 9 AS DOUBLE) AS max_x, CAST(o_orderkey * 91 % 800 + 1 + o_orderkey % 7 AS DOUBLE) AS max_y, CAST(o_orderkey % 100 AS DOUBLE) / 4 AS level_mm FROM orders)"""


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS point_id", "c_custkey * 53 % 1000 + 0.5e0 AS x", "c_custkey * 29 % 800 + 0.5e0 AS y")


SPOTS = "spots AS (SELECT c_custkey AS point_id, c_custkey * 53 % 1000 + 0.5e0 AS x, c_custkey * 29 % 800 + 0.5e0 AS y FROM customer)"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"))
    return boxes(spark, sf_dir).withColumn("ring", ring)


# Further tags of buildings: key, and what it holds by remainders of the part's number.
MORE_TAGS = (
    ("amenity", "CASE p_partkey % 9 WHEN 0 THEN 'place_of_worship' WHEN 1 THEN 'Parking' WHEN 2 THEN 'library' WHEN 3 THEN 'cafe' END"),
    ("shop", "CASE p_partkey % 11 WHEN 0 THEN 'supermarket' WHEN 1 THEN 'no' WHEN 2 THEN 'vacant;no' END"),
    ("office", "CASE p_partkey % 13 WHEN 0 THEN 'company' WHEN 1 THEN 'no' END"),
    ("landuse", "CASE WHEN p_partkey % 17 = 0 THEN 'industrial' END"),
    ("leisure", "CASE WHEN p_partkey % 19 = 0 THEN 'sports centre' END"),
    ("landmark", "CASE WHEN p_partkey % 23 = 0 THEN 'yes' END"),
    ("tourism", "CASE WHEN p_partkey % 29 = 0 THEN 'attraction' END"),
    ("wikidata", "CASE WHEN p_partkey % 2 = 0 THEN 'Q1' END"),
    ("map:class", "CASE p_partkey % 31 WHEN 0 THEN 'zoo;Retail' WHEN 1 THEN 'nonsense' END"),
    ("heatmap:class", "CASE WHEN p_partkey % 3 = 0 THEN 'stadium' END"),
    ("building:part", "CASE WHEN p_partkey % 8 = 3 THEN 'yes' END"),
    ("min_height", "CASE WHEN p_partkey % 6 = 0 THEN '3 m' END"),
    ("building:min_level", "CASE WHEN p_partkey % 10 = 7 THEN '2' END"),
    ("roof:height", "CASE WHEN p_partkey % 12 = 5 THEN '2.5' END"),
    ("roof:orientation", "CASE WHEN p_partkey % 4 = 2 THEN ' Across' END"),
)


def building_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "element_at(array(" + ", ".join(f"'{b}'" for b in BUILDINGS) + f"), cast(p_partkey % {len(BUILDINGS)} + 1 AS int))"
    named = [("building", kinds), ("height", "CASE p_partkey % 5 WHEN 0 THEN concat(p_partkey * 7 % 90 + 1, ' m') WHEN 1 THEN concat(p_partkey * 3 % 200, 'ft') WHEN 2 THEN 'tall' END"), ("building:levels", "CASE WHEN p_partkey % 3 <> 0 THEN cast(p_partkey * 5 % 23 AS string) END"), ("roof:levels", "CASE WHEN p_partkey % 7 = 0 THEN '2' END"), ("roof:shape", "CASE p_partkey % 4 WHEN 0 THEN 'gabled' WHEN 1 THEN 'onion' END"), *MORE_TAGS]
    pairs = ", ".join(f"'{k}', {v}" for k, v in named)
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS feature_id", f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL) AS tags", "cast(p_partkey * 13 % 400 AS double) AS footprint_area_m2")


_list = ", ".join(f"'{b}'" for b in BUILDINGS)
TAGS = f"""parts AS (SELECT p_partkey AS feature_id, p_partkey AS p, list_extract([{_list}], (p_partkey % {len(BUILDINGS)} + 1)::INT) AS b,
  CASE p_partkey % 5 WHEN 0 THEN (p_partkey * 7 % 90 + 1)::DOUBLE WHEN 1 THEN CASE WHEN p_partkey * 3 % 200 > 0 THEN (p_partkey * 3 % 200)::DOUBLE * 0.3048e0 END END AS h,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey * 5 % 23 > 0 THEN (p_partkey * 5 % 23)::DOUBLE END AS l,
  CASE WHEN p_partkey % 7 = 0 THEN 2e0 ELSE 0e0 END AS r, CASE WHEN p_partkey % 4 = 0 THEN 'gabled' ELSE 'flat' END AS s, CAST(p_partkey * 13 % 400 AS DOUBLE) AS area,
  p_partkey % 8 = 3 AS part, CASE WHEN p_partkey % 6 = 0 THEN 3e0 END AS low, CASE WHEN p_partkey % 10 = 7 THEN 2e0 ELSE 0e0 END AS low_levels, CASE WHEN p_partkey % 12 = 5 THEN 2.5e0 END AS rh,
  CASE WHEN p_partkey % 4 = 2 THEN 'across' ELSE 'along' END AS lean FROM part),
ranked AS (SELECT *, least(CASE WHEN p % 23 = 0 THEN 0 END, CASE WHEN b = 'stadium' OR p % 19 = 0 THEN 1 END, CASE WHEN b = 'church' OR p % 9 = 0 THEN 2 END, CASE WHEN b IN ('garage', 'parking-garage') OR p % 9 = 1 THEN 3 END,
  CASE WHEN b = 'school' OR p % 9 = 2 THEN 4 END, CASE WHEN b = 'Retail' OR p % 11 = 0 THEN 5 END, CASE WHEN b = 'warehouse' OR p % 17 = 0 THEN 6 END, CASE WHEN b IN ('office', 'hotel;commercial') OR p % 13 = 0 THEN 7 END,
  CASE WHEN b IN ('house', 'apartments', 'detached') THEN 8 END, 9) AS k FROM parts),
classed AS (SELECT *, CASE WHEN p % 31 = 0 THEN 'retail' WHEN p % 31 = 1 THEN 'unknown' WHEN p % 29 = 0 AND p % 2 = 0 THEN 'landmark'
  ELSE list_extract(['landmark', 'stadium_arena', 'religious', 'parking', 'civic_institutional', 'retail', 'industrial_warehouse', 'commercial_office', 'residential', 'unknown'], k + 1) END AS kind FROM ranked),
preset(kind, fl, lh, top) AS (VALUES ('residential', 2e0, 3e0, 14e0), ('commercial_office', 6e0, 3.6e0, 31.8e0), ('industrial_warehouse', 1e0, 6e0, 12e0), ('retail', 1e0, 4.5e0, 12e0), ('parking', 4e0, 3e0, 16e0),
  ('civic_institutional', 3e0, 3.8e0, 22e0), ('stadium_arena', 3e0, 6e0, 26e0), ('religious', 2e0, 4.5e0, 26e0), ('landmark', 8e0, 4e0, 31.8e0), ('unknown', 2e0, 3e0, 18e0)),
sized AS (SELECT c.*, fl, lh, top, coalesce(rh, r * lh) AS roof, l * lh + coalesce(rh, r * lh) AS by_levels, coalesce(low, low_levels * lh) AS minh, h IS NOT NULL AND h <= 400 AND (part OR l IS NULL OR h >= l * 1.5e0) AS fine, lower(split_part(b, ';', 1)) AS btype FROM classed c JOIN preset p USING (kind)),
dims0 AS (SELECT *, CASE WHEN fine THEN 'height' WHEN by_levels <= 400 THEN 'levels' WHEN kind <> 'unknown' THEN 'class' ELSE 'fallback' END AS source,
  CASE WHEN fine THEN h WHEN by_levels <= 400 THEN by_levels WHEN kind <> 'unknown' THEN least(fl * lh + roof, 400e0)
       ELSE coalesce(CASE WHEN h > 0 AND h <= 400 THEN h END, CASE WHEN l > 0 AND l <= 400 / 3e0 THEN l * 3e0 END, CASE WHEN r > 0 THEN 6e0 + r * 3e0 END,
         CASE WHEN btype IN ('apartments', 'office', 'hotel', 'church') THEN 12e0 WHEN btype = 'warehouse' THEN 8e0 WHEN btype = 'retail' THEN 6e0 WHEN btype IN ('garage', 'shed') THEN 3e0 END, 6e0) END AS total0 FROM sized),
dims1 AS (SELECT *, least(greatest(total0, minh + 0.01e0), 400e0) AS total FROM dims0),
dims2 AS (SELECT *, CASE WHEN s = 'flat' THEN 0e0 WHEN least(roof, total - minh) <= 0 THEN least(lh, total - minh) ELSE least(roof, total - minh) END AS roof_m FROM dims1),
dims AS (SELECT *, greatest(minh, total - roof_m) AS eave FROM dims2)"""


def road_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "element_at(array(" + ", ".join(f"'{r}'" for r in ROADS) + f"), cast(l_orderkey % {len(ROADS)} + 1 AS int))"
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS feature_id", f"map_filter(map('highway', {kinds}, 'service', CASE l_partkey % 3 WHEN 0 THEN 'Parking_aisle;x' WHEN 1 THEN 'driveway' END, 'access', CASE WHEN l_suppkey % 4 = 0 THEN ' Private ' END), (k, v) -> v IS NOT NULL) AS tags")

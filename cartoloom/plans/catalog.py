"""Registered queries of the route-map operators and their SQL equivalents. Transcendental results are rounded to 6 digits in both."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import buildings, frames, mesh, profile, raster, spatial, tags
from . import inputs as i
from .inputs import BOXES, CELLS, LINES, SEGMENTS, SPOTS, TAGS, TRACKS
from .registry import ORACLES, QUERIES, query, r6

PLATE = frames.Plate(190.0, 240.0, 5.0, 27.0)


CENTRED = TRACKS + """,
mid AS (SELECT route_id, (min(lat) + max(lat)) / 2 AS clat, (min(lon) + max(lon)) / 2 AS clon FROM tracks GROUP BY route_id),
around AS (SELECT t.*, clat, clon, 6378137e0 * cos(radians(lat)) * sin(radians(lon) - radians(clon)) AS x_m,
  6378137e0 * (cos(radians(clat)) * sin(radians(lat)) - sin(radians(clat)) * cos(radians(lat)) * cos(radians(lon) - radians(clon))) AS y_m FROM tracks t JOIN mid USING (route_id))"""
FRAMED = CENTRED + """,
turned AS (SELECT *, x_m * cos(radians(-27e0)) - y_m * sin(radians(-27e0)) AS rx, x_m * sin(radians(-27e0)) + y_m * cos(radians(-27e0)) AS ry FROM around),
fitted AS (SELECT route_id, clat, clon, greatest((max(rx) - min(rx)) / 180e0, (max(ry) - min(ry)) / 230e0, 1e-6) AS k FROM turned GROUP BY ALL)"""


@query(f"WITH {FRAMED} SELECT route_id, seq, round(95e0 + rx * (180e0 / (k * 180e0)), 5) AS x_mm, round(120e0 + ry * (230e0 / (k * 230e0)), 5) AS y_mm FROM turned JOIN fitted USING (route_id)")
def frame_points(spark, d):
    return frames.frame_points(i.tracks(spark, d), PLATE).select("route_id", "seq", F.round("x_mm", 5).alias("x_mm"), F.round("y_mm", 5).alias("y_mm"))


@query(f"WITH {FRAMED} SELECT route_id, round(clat, 6) AS center_lat, round(clon, 6) AS center_lon, round(k * 180e0, 3) AS coverage_width_m, round(k * 230e0, 3) AS coverage_height_m FROM fitted")
def frame_fit(spark, d):
    return frames.fit_frames(i.tracks(spark, d), PLATE).select("route_id", *r6("center_lat", "center_lon"), *(F.round(c, 3).alias(c) for c in ("coverage_width_m", "coverage_height_m")))


@query(f"WITH {TRACKS} SELECT route_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM tracks")
def project_unproject(spark, d):
    c = frames.centred(i.tracks(spark, d))
    lat, lon = geo.unproject(F.col("x_m"), F.col("y_m"), F.col("center_lat"), F.col("center_lon"))
    return c.select("route_id", "seq", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"WITH {TRACKS} SELECT route_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM tracks")
def print_to_lonlat(spark, d):
    t = i.tracks(spark, d)
    both = frames.frame_points(t, PLATE).join(frames.fit_frames(t, PLATE), "route_id")
    lat, lon = frames.from_print(F.col("x_mm"), F.col("y_mm"), {c: F.col(c) for c in ("center_lat", "center_lon", "coverage_width_m", "coverage_height_m")}, PLATE)
    return both.select("route_id", "seq", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


BOXED = CENTRED + """,
box AS (SELECT route_id, min(x_m) AS x0, max(x_m) - min(x_m) AS sx, min(y_m) AS y0, max(y_m) - min(y_m) AS sy FROM around GROUP BY route_id),
fit AS (SELECT *, CASE WHEN sx = 0 AND sy = 0 THEN 1e0 ELSE least(CASE WHEN sx > 0 THEN 180e0 / sx ELSE 1e0 END, CASE WHEN sy > 0 THEN 230e0 / sy ELSE 1e0 END) END AS s FROM box)"""


@query(f"WITH {BOXED} SELECT route_id, seq, round((x_m - x0) * s + CASE WHEN sx = 0 AND sy = 0 THEN 5e0 ELSE 5e0 + (180e0 - sx * s) / 2 END, 5) AS x_mm, round((y_m - y0) * s + CASE WHEN sx = 0 AND sy = 0 THEN 5e0 ELSE 5e0 + (230e0 - sy * s) / 2 END, 5) AS y_mm FROM around JOIN fit USING (route_id)")
def box_centred(spark, d):
    c = frames.centred(i.tracks(spark, d))
    return frames.apply_box(c, frames.box_transform(c, 190.0, 240.0, 5.0)).select("route_id", "seq", F.round("x_mm", 5).alias("x_mm"), F.round("y_mm", 5).alias("y_mm"))


@query(f"WITH {BOXED} SELECT route_id, seq, round((x_m - x0) * s, 5) AS x_mm, round((y_m - y0) * s, 5) AS y_mm FROM around JOIN fit USING (route_id)")
def box_cornered(spark, d):
    c = frames.centred(i.tracks(spark, d))
    return frames.apply_box(c, frames.box_transform(c, 180.0, 230.0, centre=False)).select("route_id", "seq", F.round("x_mm", 5).alias("x_mm"), F.round("y_mm", 5).alias("y_mm"))


@query(f"WITH {FRAMED} SELECT route_id, round(sqrt(k * 180e0 * k * 180e0 + k * 230e0 * k * 230e0) / 2, 3) AS radius_m FROM fitted")
def query_radius(spark, d):
    return frames.query_bounds(frames.fit_frames(i.tracks(spark, d), PLATE), PLATE).select("route_id", F.round("radius_m", 3).alias("radius_m"))


@query(f"""WITH {FRAMED}, corners AS (SELECT route_id, clat, clon, k, unnest([-90e0, -90e0, 90e0, 90e0]) AS ax, unnest([-115e0, 115e0, -115e0, 115e0]) AS ay FROM fitted),
moved AS (SELECT *, (ax * k * cos(radians(27e0)) - ay * k * sin(radians(27e0))) / 6378137e0 AS u, (ax * k * sin(radians(27e0)) + ay * k * cos(radians(27e0))) / 6378137e0 AS v FROM corners),
polar AS (SELECT *, sqrt(u * u + v * v) AS rho, asin(sqrt(u * u + v * v)) AS c FROM moved),
degrees_ AS (SELECT route_id, k, degrees(asin(cos(c) * sin(radians(clat)) + v * sin(c) * cos(radians(clat)) / rho)) AS lat, clon + degrees(atan2(u * sin(c), rho * cos(radians(clat)) * cos(c) - v * sin(radians(clat)) * sin(c))) AS lon FROM polar)
SELECT route_id, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(sqrt(any_value(k) * 180e0 * any_value(k) * 180e0 + any_value(k) * 230e0 * any_value(k) * 230e0) / 2, 3) AS radius_m FROM degrees_ GROUP BY route_id""")
def query_bounds(spark, d):
    found = frames.query_bounds(frames.fit_frames(i.tracks(spark, d), PLATE), PLATE)
    return found.select("route_id", *r6("south", "north", "west", "east"), F.round("radius_m", 3).alias("radius_m"))


@query(f"""WITH {CENTRED}, s AS (SELECT route_id, clat, clon, greatest(max(x_m) - min(x_m), 10e0) * 1.12e0 AS w, greatest(max(y_m) - min(y_m), 10e0) * 1.12e0 AS h FROM around GROUP BY ALL),
p AS (SELECT *, CASE WHEN w >= h THEN 240e0 ELSE 190e0 END AS pw, CASE WHEN w >= h THEN 190e0 ELSE 240e0 END AS ph FROM s)
SELECT route_id, round(clat, 6) AS center_lat, round(clon, 6) AS center_lon, round(CASE WHEN w / h < pw / ph THEN h * (pw / ph) ELSE w END, 3) AS coverage_width_m, round(CASE WHEN w / h < pw / ph THEN h ELSE w / (pw / ph) END, 3) AS coverage_height_m, pw AS print_width_mm, ph AS print_height_mm FROM p""")
def suggest_frames(spark, d):
    s = frames.suggest_frames(i.tracks(spark, d))
    return s.select("route_id", *r6("center_lat", "center_lon"), *(F.round(c, 3).alias(c) for c in ("coverage_width_m", "coverage_height_m")), "print_width_mm", "print_height_mm")


@query(f"WITH {CENTRED} SELECT route_id, CASE WHEN max(x_m) - min(x_m) > max(y_m) - min(y_m) THEN 'landscape' ELSE 'portrait' END AS orientation FROM around GROUP BY route_id")
def orientation(spark, d):
    return frames.orientation(i.tracks(spark, d))


@query(f"WITH {TRACKS} SELECT route_id, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east, count(*) AS n_points FROM tracks GROUP BY route_id")
def route_bounds(spark, d):
    return frames.extents(i.tracks(spark, d)).selectExpr("route_id", "min_lat AS south", "min_lon AS west", "max_lat AS north", "max_lon AS east", "n_points")


@query(f"""WITH {TRACKS} SELECT route_id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || string_agg('[' || lon::VARCHAR || ',' || lat::VARCHAR || ']', ',' ORDER BY seq) || ']}}}}' AS geojson FROM tracks GROUP BY route_id""")
def route_geojson(spark, d):
    return frames.route_lines(i.tracks(spark, d)).select("route_id", "geojson")


@query(f"""WITH {LINES}, ends AS (SELECT route_id, arg_min(x_mm, seq) AS sx, arg_min(y_mm, seq) AS sy, arg_max(x_mm, seq) AS fx, arg_max(y_mm, seq) AS fy FROM lines GROUP BY route_id)
SELECT route_id, 'start' AS marker, sx AS x_mm, sy AS y_mm FROM ends UNION ALL SELECT route_id, 'finish', fx, fy FROM ends WHERE sqrt((fx-sx)*(fx-sx)+(fy-sy)*(fy-sy)) > 20""")
def route_markers(spark, d):
    return frames.markers(i.lines(spark, d), "both", 20.0)


@query(f"""WITH {SEGMENTS}, o AS (SELECT route_id, max(CASE WHEN x_mm < 5 OR x_mm > 185 OR y_mm < 5 OR y_mm > 235 THEN 1 ELSE 0 END) AS outside FROM lines GROUP BY route_id),
q AS (SELECT *, x1-x0 AS dx, y1-y0 AS dy FROM segs),
c AS (SELECT route_id, greatest(0e0, CASE WHEN dx > 0 THEN (5-x0)/dx WHEN dx < 0 THEN (185-x0)/dx ELSE 0e0 END, CASE WHEN dy > 0 THEN (5-y0)/dy WHEN dy < 0 THEN (235-y0)/dy ELSE 0e0 END) AS t0,
 least(1e0, CASE WHEN dx > 0 THEN (185-x0)/dx WHEN dx < 0 THEN (5-x0)/dx ELSE 1e0 END, CASE WHEN dy > 0 THEN (235-y0)/dy WHEN dy < 0 THEN (5-y0)/dy ELSE 1e0 END) AS t1,
 (dx <> 0 OR (x0 >= 5 AND x0 <= 185)) AND (dy <> 0 OR (y0 >= 5 AND y0 <= 235)) AS ok FROM q),
k AS (SELECT route_id, count(*) AS inside FROM c WHERE ok AND t0 <= t1 GROUP BY route_id)
SELECT o.route_id, CASE WHEN coalesce(inside, 0) = 0 THEN 'The route does not intersect the selected frame.' WHEN outside = 1 THEN 'Part of the route is outside the selected frame and will be clipped.' END AS warning FROM o LEFT JOIN k USING (route_id)""")
def preview_warnings(spark, d):
    return frames.preview_warnings(i.lines(spark, d), frames.Plate(190.0, 240.0, 5.0))


@query("""WITH b AS (SELECT o_orderkey AS k, (o_orderkey * 7 % 340 - 170)::DOUBLE AS west, (o_custkey * 11 % 160 - 80)::DOUBLE AS south, (o_orderkey * 7 % 340 - 170 + 1 + o_orderkey % 9)::DOUBLE AS east, (o_custkey * 11 % 160 - 80 + 1 + o_custkey % 5)::DOUBLE AS north FROM orders),
r AS (SELECT *, (floor(south/3)*3)::INT AS a0, CASE WHEN north = 0 THEN 0 ELSE (ceil(north/3)*3-3)::INT END AS a1, (floor(west/3)*3)::INT AS b0, CASE WHEN east = 0 THEN 0 ELSE (ceil(east/3)*3-3)::INT END AS b1 FROM b),
x AS (SELECT k, unnest(generate_series(a0, a1, 3)) AS lat, b0, b1 FROM r), y AS (SELECT k, lat, unnest(generate_series(b0, b1, 3)) AS lon FROM x)
SELECT k, lat::INT AS lat, lon::INT AS lon, 'ESA_WorldCover_10m_2021_v200_' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(abs(lat)::VARCHAR, 2, '0') || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(abs(lon)::VARCHAR, 3, '0') || '_Map.tif' AS name FROM y""")
def tile_cover(spark, d):
    b = i.table(spark, d, "orders").selectExpr("o_orderkey AS k", "double(o_orderkey * 7 % 340 - 170) AS west", "double(o_custkey * 11 % 160 - 80) AS south", "double(o_orderkey * 7 % 340 - 170 + 1 + o_orderkey % 9) AS east", "double(o_custkey * 11 % 160 - 80 + 1 + o_custkey % 5) AS north")
    t = b.select("k", F.explode(geo.tiles(*(F.col(c) for c in ("west", "south", "east", "north")))).alias("t")).select("k", "t.lat", "t.lon")
    return t.withColumn("name", geo.tile_name(F.col("lat"), F.col("lon")))


@query(f"WITH {TRACKS} SELECT point_id, round((lon + 180) / 360 * 1048576, 3) AS px, round((1 - asinh(tan(radians(lat))) / pi()) / 2 * 1048576, 3) AS py FROM tracks")
def mercator_pixels(spark, d):
    px, py = geo.mercator_pixel(F.col("lat"), F.col("lon"), 12)
    return i.tracks(spark, d).select("point_id", F.round(px, 3).alias("px"), F.round(py, 3).alias("py"))


@query("SELECT p_partkey, (p_partkey * 3 % 256) * 256e0 + (p_partkey * 5 % 256) + (p_partkey * 7 % 256) / 256e0 - 32768e0 AS metres FROM part")
def terrarium_decode(spark, d):
    m = geo.terrarium(F.expr("double(p_partkey * 3 % 256)"), F.expr("double(p_partkey * 5 % 256)"), F.expr("double(p_partkey * 7 % 256)"))
    return i.table(spark, d, "part").select("p_partkey", m.alias("metres"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 110 IN (10,20,30,40,90,95,100) THEN 1 WHEN p_partkey % 110 = 50 THEN 9 WHEN p_partkey % 110 IN (60,70) THEN 2 WHEN p_partkey % 110 = 80 THEN 8 ELSE 0 END AS wc,
CASE p_partkey % 12 WHEN 1 THEN 8 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 11 THEN 1 WHEN 7 THEN 9 WHEN 8 THEN 2 WHEN 9 THEN 2 ELSE 0 END AS io FROM part""")
def recode_rasters(spark, d):
    return i.table(spark, d, "part").select("p_partkey", geo.recode(F.expr("p_partkey % 110"), geo.WORLDCOVER_CODES).alias("wc"), geo.recode(F.expr("p_partkey % 12"), geo.IMPACT_CODES).alias("io"))


@query("""WITH c AS (SELECT c_custkey, lpad(lower(to_hex(c_custkey * 65793 % 16777216)), 6, '0') AS h FROM customer)
SELECT c_custkey, '#' || upper(h) AS colour, ('0x' || substr(h, 1, 2))::INT AS r, ('0x' || substr(h, 3, 2))::INT AS g, ('0x' || substr(h, 5, 2))::INT AS b FROM c""")
def palette_colours(spark, d):
    raw = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.expr("c_custkey * 65793 % 16777216"))), 6, "0"), F.lit("7f"))
    return i.table(spark, d, "customer").select("c_custkey", geo.hex_colour(raw).alias("colour"), geo.rgba(raw).alias("v")).selectExpr("c_custkey", "colour", "v[0] AS r", "v[1] AS g", "v[2] AS b")


@query("""SELECT p_partkey, (SELECT s FROM (VALUES (0, 0.08e0, 0.16e0), (1, 0.12e0, 0.24e0), (2, 0.16e0, 0.30e0), (3, 0.20e0, 0.35e0), (4, 0.24e0, 0.40e0), (5, 0.28e0, 0.45e0)) t(i, h, s) ORDER BY abs(h - (p_partkey % 35 + 1) / 1e2), i LIMIT 1) AS slope FROM part""")
def route_slopes(spark, d):
    return i.table(spark, d, "part").select("p_partkey", frames.route_slope(F.expr("(p_partkey % 35 + 1) / 1e2")).alias("slope"))


@query(f"WITH {TAGS} SELECT feature_id, round(h, 9) AS height_m, l AS levels FROM dims")
def parse_metres(spark, d):
    t = F.col("tags")
    return i.building_tags(spark, d).select("feature_id", F.round(tags.number_m(tags.first_value(t, "height")), 9).alias("height_m"), tags.number_m(tags.first_value(t, "building:levels")).alias("levels"))


@query(f"WITH {TAGS}, w AS (SELECT feature_id, unnest(string_split(b, ';')) AS t FROM parts) SELECT DISTINCT feature_id, replace(replace(lower(trim(t)), '-', '_'), ' ', '_') AS token FROM w")
def tag_tokens(spark, d):
    return i.building_tags(spark, d).select("feature_id", F.explode(tags.tokens(F.col("tags"), "building")).alias("token"))


@query(f"WITH {TAGS} SELECT feature_id, kind AS building_class FROM classed")
def building_classes(spark, d):
    return i.building_tags(spark, d).select("feature_id", tags.classify(F.col("tags")).alias("building_class"))


@query(f"WITH {TAGS} SELECT kind AS building_class, count(*) AS n, round(fl * lh, 6) AS fallback_height_m FROM sized GROUP BY kind, fl, lh")
def class_presets(spark, d):
    c = i.building_tags(spark, d).select(tags.classify(F.col("tags")).alias("building_class"))
    return c.groupBy("building_class").count().join(F.broadcast(buildings.presets(spark)), "building_class").select("building_class", F.col("count").alias("n"), *r6("fallback_height_m"))


@query(f"WITH {TAGS} SELECT feature_id, source AS height_source, round(total, 6) AS total_height_m, round(roof_m, 6) AS roof_height_m, round(eave, 6) AS eave_height_m, round(minh, 6) AS min_height_m, btype AS building_type, part AS is_part, lean AS roof_orientation FROM dims")
def building_dimensions(spark, d):
    return buildings.dimensions(i.building_tags(spark, d)).select("feature_id", "height_source", *r6("total_height_m", "roof_height_m", "eave_height_m", "min_height_m"), "building_type", "is_part", "roof_orientation")


TIERS = TAGS + """,
sig AS (SELECT *, CASE WHEN source = 'levels' THEN l WHEN source = 'class' THEN fl ELSE total / 3e0 END AS st FROM dims),
ref AS (SELECT greatest(9e0, coalesce(quantile_cont(st, 0.9), 9e0)) AS hi, greatest(9e0, quantile_cont(st, 0.9), max(st)) AS pk FROM sig WHERE source IN ('height', 'levels')),
low AS (SELECT *, CASE WHEN btype IN ('garage', 'shed') THEN 1.2e0 WHEN kind = 'residential' AND btype IN ('house', 'detached') AND area <= 180 THEN 1.6e0 WHEN kind = 'unknown' AND area <= 40 THEN 1.2e0 WHEN kind = 'unknown' AND area <= 120 THEN 1.6e0 ELSE 2e0 END AS lo FROM sig, ref),
tier AS (SELECT *, least(30e0, CASE WHEN btype IN ('garage', 'shed') THEN lo WHEN source = 'levels' AND l <= 1 THEN lo WHEN source = 'levels' AND l <= 2 THEN 2.8e0 WHEN source = 'levels' AND l <= 8 THEN 3 + (l - 3) / 5 * 6
  WHEN (st <= 2 OR (source NOT IN ('height', 'levels') AND kind NOT IN ('commercial_office', 'civic_institutional', 'landmark', 'parking', 'religious', 'stadium_arena'))) AND source IN ('height', 'levels') AND st > 1 THEN lo + least(1e0, st - 1) * (2.8e0 - lo)
  WHEN st <= 2 OR (source NOT IN ('height', 'levels') AND kind NOT IN ('commercial_office', 'civic_institutional', 'landmark', 'parking', 'religious', 'stadium_arena')) THEN lo
  WHEN st < 3 THEN 2.8e0 + (st - 2) * 0.2e0 WHEN st <= 8 THEN 3 + (st - 3) / 5 * 6 WHEN st <= 9 THEN 9e0
  WHEN hi > 9 AND st <= hi THEN 9 + pow((st - 9) / (hi - 9), 0.85e0) * (30e0 * 0.58e0 - 9) WHEN pk <= hi + 1e-9 THEN 30e0 * 0.58e0
  ELSE 30e0 * 0.58e0 + pow(least(1e0, greatest(0e0, (st - hi) / (pk - hi))), 1.25e0) * (30e0 - 30e0 * 0.58e0) END) AS mm FROM low),
full_ AS (SELECT *, CASE WHEN source IN ('height', 'levels') THEN mm ELSE least(mm, top) END AS total_mm FROM tier),
feet AS (SELECT *, least(0.6e0, total_mm) AS body, least(CASE WHEN minh > 0 THEN total_mm * least(1e0, minh / greatest(total, 1e-9)) ELSE 0e0 END, greatest(0e0, total_mm - least(0.6e0, total_mm))) AS bottom_mm FROM full_),
rendered AS (SELECT *, least(total_mm, greatest(bottom_mm + body, total_mm * greatest(0e0, least(1e0, eave / greatest(total, 1e-9))))) AS eave_mm FROM feet)"""


@query(f"WITH {TIERS} SELECT feature_id, round(total_mm, 6) AS total_mm, round(bottom_mm, 6) AS bottom_mm, round(eave_mm, 6) AS eave_mm, round(CASE WHEN bottom_mm <= 1e-9 THEN 0.2e0 ELSE least(0.2e0, bottom_mm) END, 6) AS embed_mm FROM rendered")
def tiered_heights(spark, d):
    out = buildings.rendered_heights(buildings.dimensions(i.building_tags(spark, d)))
    return out.select("feature_id", *r6("total_mm", "bottom_mm", "eave_mm"), F.round(buildings.embed_depth(F.col("bottom_mm")), 6).alias("embed_mm"))


@query(f"""WITH {TIERS} SELECT count(*) AS n, count(*) FILTER (source = 'class') AS n_class, count(*) FILTER (source = 'fallback') AS n_fallback, count(*) FILTER (source = 'height') AS n_height, count(*) FILTER (source = 'levels') AS n_levels,
round(quantile_cont(total, 0.5), 6) AS real_p50, round(quantile_cont(total, 0.9), 6) AS real_p90, round(quantile_cont(total, 0.99), 6) AS real_p99, round(max(total), 6) AS real_max,
round(quantile_cont(total_mm, 0.5), 6) AS mm_p50, round(quantile_cont(total_mm, 0.9), 6) AS mm_p90, round(quantile_cont(total_mm, 0.99), 6) AS mm_p99, round(max(total_mm), 6) AS mm_max,
round(avg(CASE WHEN total_mm >= 15 THEN 1e0 ELSE 0e0 END), 6) AS at_least_50, round(avg(CASE WHEN total_mm >= 22.5 THEN 1e0 ELSE 0e0 END), 6) AS at_least_75, round(avg(CASE WHEN total_mm >= 27 THEN 1e0 ELSE 0e0 END), 6) AS at_least_90 FROM rendered""")
def height_distribution(spark, d):
    out = buildings.height_distribution(buildings.rendered_heights(buildings.dimensions(i.building_tags(spark, d))))
    return out.select(*(c if c.startswith("n") else F.round(c, 6).alias(c) for c in out.columns))


@query("""WITH h AS (SELECT p_partkey, (p_partkey * 7 % 300 + 1)::DOUBLE AS h FROM part), s AS (SELECT max(h) AS m, quantile_cont(h, 0.95) AS k FROM h), t AS (SELECT *, least(k * 0.2e0, 20e0) AS w FROM h, s)
SELECT p_partkey, round(greatest(0.6e0, least(25e0, CASE WHEN m * 0.2e0 <= 25 THEN h * 0.2e0 WHEN h <= k THEN h * (w / k) ELSE w + (h - k) / (m - k) * (25 - w) END)), 6) AS visible_mm FROM t""")
def adaptive_heights(spark, d):
    h = i.table(spark, d, "part").selectExpr("p_partkey", "double(p_partkey * 7 % 300 + 1) AS h")
    return buildings.adaptive_heights(h, "h", 0.2, 25.0, 0.6).select("p_partkey", *r6("visible_mm"))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS feature_id, list_extract(['motorway','primary_link','residential','service','footway','cycleway','trunk','unknown_way'], (l_orderkey % 8 + 1)::INT) AS road_class, l_partkey % 3 = 0 AS aisle, l_suppkey % 4 = 0 AS private FROM lineitem)
SELECT feature_id, road_class, CASE road_class WHEN 'motorway' THEN 2.4e0 WHEN 'primary_link' THEN 1.8e0 WHEN 'residential' THEN 1.1e0 WHEN 'service' THEN 0.8e0 WHEN 'cycleway' THEN 0.7e0 WHEN 'trunk' THEN 2e0 END AS width_mm FROM r
WHERE road_class NOT IN ('footway', 'unknown_way') AND NOT (road_class = 'service' AND aisle) AND NOT private""")
def printable_roads(spark, d):
    return tags.printable_roads(i.road_tags(spark, d), "urban", blocked_access=("private",)).select("feature_id", "road_class", "width_mm")


@query("""WITH r AS (SELECT (l_orderkey % 8)::VARCHAR AS road_class, l_linenumber * 10 + 1 AS a, (l_linenumber % 3) * 10 + l_suppkey % 2 AS b, (l_partkey % 3) * 10 + 1 AS c FROM lineitem)
SELECT DISTINCT road_class, CASE WHEN (a, b, c) <= (c, b, a) THEN a ELSE c END AS a, b, CASE WHEN (a, b, c) <= (c, b, a) THEN c ELSE a END AS c FROM r""")
def distinct_corridors(spark, d):
    point = lambda v: F.struct((F.floor(v / 10)).cast("int").alias("x"), (v % 10).cast("int").alias("y"))
    t = i.table(spark, d, "lineitem").selectExpr("string(l_orderkey % 8) AS road_class", "l_linenumber * 10 + 1 AS a", "(l_linenumber % 3) * 10 + l_suppkey % 2 AS b", "(l_partkey % 3) * 10 + 1 AS c")
    kept = tags.distinct_corridors(t.select("road_class", F.array(*(point(F.col(k)) for k in "abc")).alias("line")))
    low, high = F.least(F.col("line"), F.reverse("line")), F.greatest(F.col("line"), F.reverse("line"))
    code = lambda p: (p["x"] * 10 + p["y"]).cast("long")
    return kept.select("road_class", code(low[0]).alias("a"), code(low[1]).alias("b"), code(high[0]).alias("c"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1.6e0 WHEN 1 THEN 1.2e0 ELSE 0.8e0 END AS width_mm FROM orders WHERE o_orderkey % 6 < 5")
def waterways(spark, d):
    f = i.table(spark, d, "orders").selectExpr("o_orderkey", "map('waterway', element_at(array('river', 'canal', 'stream', 'drain', 'ditch', 'dock'), int(o_orderkey % 6 + 1))) AS tags")
    return tags.layer_features(f, "water").select("o_orderkey", tags.waterway_width(tags.first_value(F.col("tags"), "waterway")).alias("width_mm"))


@query("""WITH f AS (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id AS feature_id, CASE WHEN doc_id % 10 = 3 AND doc_id % 14 = 0 THEN NULL WHEN doc_id % 10 = 3 THEN 'mark3' WHEN doc_id % 14 = 0 THEN 'mark' || (doc_id % 5)::VARCHAR END AS landmark FROM f""")
def landmark_matches(spark, d):
    reg = spark.createDataFrame([(f"mark{k}", [f"Q1{k}"], [("way", k)]) for k in range(10)], "key string, wikidata array<string>, osm array<struct<type: string, id: long>>")
    f = i.table(spark, d, "documents").selectExpr("doc_id AS feature_id", "CASE WHEN doc_id % 10 = 3 THEN map('wikidata', 'Q13; Q999;bad') ELSE map() END AS tags", "CASE WHEN doc_id % 14 = 0 THEN 'way' END AS osm_type", "doc_id % 5 AS osm_id")
    return buildings.match_landmarks(f.withColumn("tags", F.col("tags").cast("map<string,string>")), reg).select("feature_id", "landmark")


@query(f"WITH {BOXES}, {SPOTS} SELECT point_id, box_id FROM spots JOIN boxes ON x > min_x AND x < max_x AND y > min_y AND y < max_y")
def points_in_boxes(spark, d):
    return spatial.points_in_boxes(i.spots(spark, d), i.boxes(spark, d), 16.0).select("point_id", "box_id")


@query(f"WITH {BOXES}, {SPOTS} SELECT point_id, box_id FROM spots JOIN boxes ON x > min_x AND x < max_x AND y > min_y AND y < max_y")
def points_in_polygons(spark, d):
    p = i.rings(spark, d).select("box_id", F.array("ring").alias("rings"))
    return spatial.points_in_polygons(i.spots(spark, d), p, 16.0).select("point_id", "box_id")


@query(f"WITH {BOXES}, {SPOTS} SELECT point_id, arg_max(level_mm, box_id) AS level_mm FROM spots JOIN boxes ON x > min_x AND x < max_x AND y > min_y AND y < max_y GROUP BY point_id")
def last_body_wins(spark, d):
    return spatial.last_wins(i.spots(spark, d), i.boxes(spark, d), "point_id", "level_mm", "box_id", 16.0)


@query(f"WITH {BOXES} SELECT p.box_id AS a, q.box_id AS b, (least(p.max_x, q.max_x) - greatest(p.min_x, q.min_x)) * (least(p.max_y, q.max_y) - greatest(p.min_y, q.min_y)) AS area FROM boxes p JOIN boxes q ON p.box_id < q.box_id AND p.min_x < q.max_x AND q.min_x < p.max_x AND p.min_y < q.max_y AND q.min_y < p.max_y")
def box_overlaps(spark, d):
    return spatial.box_overlaps(i.boxes(spark, d), 16.0)


@query(f"""WITH {BOXES}, c AS (SELECT box_id, (max_x - min_x) * (max_y - min_y) AS area, greatest(0, least(max_x, 503e0) - greatest(min_x, 100e0)) * greatest(0, least(max_y, 407e0) - greatest(min_y, 50e0)) AS inside FROM boxes)
SELECT box_id, area, round(inside / area, 6) AS inside_fraction FROM c WHERE inside > 0 AND inside / area >= 0.5""")
def clip_fraction(spark, d):
    return spatial.clip_fraction_filter(i.rings(spark, d), "ring", (100.0, 50.0, 503.0, 407.0)).select("box_id", "area", *r6("inside_fraction"))


@query(f"WITH {SEGMENTS} SELECT route_id, seq, round(coalesce(sum(length) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS station, round(length, 6) AS length FROM segs")
def line_stations(spark, d):
    return spatial.segments(i.lines(spark, d)).select("route_id", "seq", *r6("station", "length"))


@query(f"""WITH {SEGMENTS}, q AS (SELECT *, x1-x0 AS dx, y1-y0 AS dy FROM segs),
c AS (SELECT *, greatest(0e0, CASE WHEN dx > 0 THEN (40-x0)/dx WHEN dx < 0 THEN (150-x0)/dx ELSE 0e0 END, CASE WHEN dy > 0 THEN (60-y0)/dy WHEN dy < 0 THEN (200-y0)/dy ELSE 0e0 END) AS t0,
 least(1e0, CASE WHEN dx > 0 THEN (150-x0)/dx WHEN dx < 0 THEN (40-x0)/dx ELSE 1e0 END, CASE WHEN dy > 0 THEN (200-y0)/dy WHEN dy < 0 THEN (60-y0)/dy ELSE 1e0 END) AS t1,
 (dx <> 0 OR (x0 >= 40 AND x0 <= 150)) AND (dy <> 0 OR (y0 >= 60 AND y0 <= 200)) AS ok FROM q)
SELECT route_id, seq, round(x0 + t0 * dx, 6) AS cx0, round(y0 + t0 * dy, 6) AS cy0, round(x0 + t1 * dx, 6) AS cx1, round(y0 + t1 * dy, 6) AS cy1 FROM c WHERE ok AND t0 <= t1""")
def clip_lines(spark, d):
    return spatial.clip_segments(spatial.segments(i.lines(spark, d)), 40.0, 60.0, 150.0, 200.0).select("route_id", "seq", *r6("cx0", "cy0", "cx1", "cy1"))


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS station FROM segs),
p AS (SELECT route_id, point_id, y_mm / 2 AS x, x_mm AS y FROM lines),
j AS (SELECT p.route_id, point_id, seq, station, length, x, y, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, CASE WHEN length > 0 THEN greatest(0e0, least(1e0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) ELSE 0e0 END AS t FROM p JOIN s USING (route_id))
SELECT route_id, point_id, round(min(sqrt((x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2)), 6) AS distance FROM j GROUP BY route_id, point_id""")
def project_to_line(spark, d):
    ln = i.lines(spark, d)
    return spatial.project_to_lines(ln.selectExpr("route_id", "point_id", "y_mm / 2 AS x", "x_mm AS y"), spatial.segments(ln)).select("route_id", "point_id", *r6("distance"))


@query(f"WITH {LINES} SELECT route_id, point_id, round(greatest(max(height + 0.3e0 * x_mm) OVER (PARTITION BY route_id ORDER BY x_mm RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 0.3e0 * x_mm, max(height - 0.3e0 * x_mm) OVER (PARTITION BY route_id ORDER BY x_mm RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 0.3e0 * x_mm), 6) AS limited FROM lines")
def slope_limit(spark, d):
    return profile.slope_limited(i.lines(spark, d), 0.3, station="x_mm").select("route_id", "point_id", *r6("limited"))


@query(f"""WITH {LINES}, k AS (SELECT route_id, x_mm AS s, max(height) AS v FROM lines GROUP BY ALL),
a AS (SELECT DISTINCT route_id, y_mm AS s FROM lines),
b AS (SELECT a.route_id, a.s, max(CASE WHEN k.s <= a.s THEN k.s END) AS lo, min(CASE WHEN k.s >= a.s THEN k.s END) AS hi FROM a JOIN k USING (route_id) GROUP BY ALL)
SELECT b.route_id, b.s AS station, round(CASE WHEN p.v IS NULL THEN q.v WHEN q.v IS NULL OR hi = lo THEN p.v ELSE p.v + (b.s - lo) * (q.v - p.v) / (hi - lo) END, 6) AS value FROM b LEFT JOIN k p ON p.route_id = b.route_id AND p.s = lo LEFT JOIN k q ON q.route_id = b.route_id AND q.s = hi""")
def interpolate_profile(spark, d):
    ln = i.lines(spark, d)
    asked = ln.selectExpr("route_id", "y_mm AS station").distinct()
    return profile.interpolate(asked, ln.selectExpr("route_id", "x_mm AS station", "height")).select("route_id", "station", *r6("value"))


ANALYSIS = CELLS + """,
an AS (SELECT grid_id, min(elev) AS lo, max(elev) AS hi, quantile_cont(elev, 0.05) AS p05, quantile_cont(elev, 0.95) AS p95 FROM cells GROUP BY grid_id),
fl AS (SELECT *, greatest(0e0, least(1e0, 1 - (p95 - p05) / 10000e0 / 0.08e0)) AS f FROM an)"""


@query(f"WITH {ANALYSIS} SELECT grid_id, lo AS minimum_m, hi AS maximum_m, round(p95 - p05, 6) AS robust_range_m, CAST(round_even(f * 5, 0) AS INT) AS rating, round(1.5e0 + f * 1.5e0, 6) AS target_relief_mm, round((1.5e0 + f * 1.5e0) / (p95 - p05), 9) AS scale_mm_per_m FROM fl")
def terrain_analysis(spark, d):
    a = raster.terrain_analysis(i.cells(spark, d), "elev", 10000.0, 3.0, 1.5, "grid_id")
    return a.select("grid_id", "minimum_m", "maximum_m", *r6("robust_range_m"), "rating", *r6("target_relief_mm"), F.round("scale_mm_per_m", 9).alias("scale_mm_per_m"))


RELIEF = ANALYSIS + """,
n0 AS (SELECT c.grid_id, row, col, 1.5e0 + f * 1.5e0 AS target, CASE WHEN elev < p05 THEN 0.05e0 * exp((elev - p05) / (p95 - p05)) WHEN elev > p95 THEN 1 - 0.05e0 * exp(-(elev - p95) / (p95 - p05)) ELSE 0.05e0 + 0.9e0 * (elev - p05) / (p95 - p05) END AS n FROM cells c JOIN fl USING (grid_id)),
relief AS (SELECT grid_id, row, col, pow((n - min(n) OVER g) / (max(n) OVER g - min(n) OVER g), 0.75e0) * target AS h_mm FROM n0 WINDOW g AS (PARTITION BY grid_id))"""


@query(f"WITH {RELIEF} SELECT grid_id, row, col, round(h_mm, 6) AS h_mm FROM relief")
def relief_heights(spark, d):
    return raster.normalised_relief(i.cells(spark, d), "elev", 10000.0, 0.75).select("grid_id", "row", "col", *r6("h_mm"))


@query(f"WITH {CELLS} SELECT grid_id, row, col, CASE WHEN col <= 3 OR col >= 60 OR row <= 3 OR row >= 96 THEN min(elev) OVER (PARTITION BY grid_id) ELSE elev END AS elev FROM cells")
def trim_border(spark, d):
    return raster.trim_border(i.cells(spark, d), "col", "row", "elev", 63.0, 99.0, 3.0).select("grid_id", "row", "col", "elev")


@query(f"""WITH {CELLS}, p AS (SELECT grid_id, row, col, least(row + 0.25e0, 99e0) AS fr, least(col + 0.5e0, 63e0) AS fc FROM cells),
q AS (SELECT *, floor(fr)::INT AS r0, floor(fc)::INT AS c0, fr - floor(fr) AS tr, fc - floor(fc) AS tc FROM p)
SELECT q.grid_id, q.row, q.col, round((a.elev * (1 - tc) + b.elev * tc) * (1 - tr) + (c.elev * (1 - tc) + e.elev * tc) * tr, 6) AS sample FROM q JOIN cells a ON a.grid_id = q.grid_id AND a.row = r0 AND a.col = c0 JOIN cells b ON b.grid_id = q.grid_id AND b.row = r0 AND b.col = least(c0 + 1, 63)
JOIN cells c ON c.grid_id = q.grid_id AND c.row = least(r0 + 1, 99) AND c.col = c0 JOIN cells e ON e.grid_id = q.grid_id AND e.row = least(r0 + 1, 99) AND e.col = least(c0 + 1, 63)""")
def bilinear_samples(spark, d):
    c = i.cells(spark, d)
    p = c.selectExpr("grid_id", "row AS r", "col AS c", "row + 0.25e0 AS f_row", "col + 0.5e0 AS f_col")
    return raster.bilinear(p, c, "elev", 100, 64).select("grid_id", F.col("r").alias("row"), F.col("c").alias("col"), *r6("sample"))


@query(f"""WITH {CELLS}, t AS (SELECT DISTINCT grid_id, row AS k FROM cells), x AS (SELECT grid_id, k, k * 0.7e0 - 2 AS x, k * 1.1e0 - 3 AS y FROM t)
SELECT x.grid_id, k, coalesce(wc, 0)::INT AS class FROM x LEFT JOIN cells c ON c.grid_id = x.grid_id AND c.col = floor(x)::INT AND c.row = floor(y)::INT""")
def resample_classes(spark, d):
    c = i.cells(spark, d)
    t = c.select("grid_id", F.col("row").alias("k")).distinct().selectExpr("grid_id", "k", "k * 0.7e0 - 2 AS x", "k * 1.1e0 - 3 AS y")
    return raster.resample_classes(t, c.withColumnRenamed("wc", "class"), (0.0, 0.0, 64.0, 100.0), 100, 64).select("grid_id", "k", "class")


@query(f"WITH {CELLS} SELECT grid_id, row, col, CAST(CASE WHEN io = 8 THEN 8 WHEN osm THEN 2 WHEN wc BETWEEN 2 AND 7 THEN wc WHEN wc = 1 THEN 1 ELSE 0 END AS INT) AS class FROM cells")
def fuse_classes(spark, d):
    return i.cells(spark, d).select("grid_id", "row", "col", raster.fuse_classes(F.col("wc"), F.expr("io = 8"), F.col("osm")).alias("class"))


NEAR = "(SELECT count(*) FROM cells n WHERE n.grid_id = c.grid_id AND abs(n.row - c.row) <= 1 AND abs(n.col - c.col) <= 1 AND NOT (n.row = c.row AND n.col = c.col) AND n.wc BETWEEN 2 AND 7)"
WITH_N = CELLS + f""",
counted AS (SELECT c.*, {NEAR} AS n8 FROM cells c)"""


@query(f"WITH {WITH_N} SELECT grid_id, row, col, n8 FROM counted")
def neighbour_counts(spark, d):
    return raster.neighbours(i.cells(spark, d).withColumn("on", geo.exposed(F.col("wc"))), "on").select("grid_id", "row", "col", "n8")


@query(f"WITH {WITH_N} SELECT grid_id, row, col, ((wc BETWEEN 2 AND 7 AND n8 >= 1) OR (NOT wc BETWEEN 2 AND 7 AND n8 >= 6)) AND NOT water AS on_ FROM counted")
def majority_pass(spark, d):
    return raster.majority(i.cells(spark, d).withColumn("on_", geo.exposed(F.col("wc"))), "on_", "water").select("grid_id", "row", "col", "on_")


@query(f"WITH {CELLS}, s AS (SELECT grid_id, row, col, col - row_number() OVER (PARTITION BY grid_id, row ORDER BY col) AS g FROM cells WHERE wc BETWEEN 2 AND 7) SELECT grid_id, row, min(col) AS first_col, max(col) AS last_col, count(*) AS n FROM s GROUP BY grid_id, row, g")
def column_runs(spark, d):
    return raster.runs(i.cells(spark, d).withColumn("on", geo.exposed(F.col("wc"))), "on")


COAST = CELLS + """,
wet AS (SELECT grid_id, row, col FROM cells WHERE wc = 8 AND io = 8),
near AS (SELECT DISTINCT c.grid_id, c.row, c.col FROM cells c JOIN wet w ON w.grid_id = c.grid_id AND abs(c.row - w.row) <= 1 AND abs(c.col - w.col) <= 3
  AND least(abs(c.row - w.row), abs(c.col - w.col)) * sqrt(100e0 * 100 + 250e0 * 250) + (abs(c.row - w.row) - least(abs(c.row - w.row), abs(c.col - w.col))) * 250 + (abs(c.col - w.col) - least(abs(c.row - w.row), abs(c.col - w.col))) * 100 <= 310),
coast AS (SELECT c.*, n.row IS NOT NULL AS coastal FROM cells c LEFT JOIN near n ON n.grid_id = c.grid_id AND n.row = c.row AND n.col = c.col)"""


@query(f"WITH {COAST} SELECT grid_id, row, col, coastal FROM coast")
def coastal_distance(spark, d):
    return raster.coastal_distance(i.cells(spark, d).withColumn("wet", F.expr("wc = 8 AND io = 8")), "wet", 100.0, 250.0, 310.0).select("grid_id", "row", "col", "coastal")


SCORED = COAST + """,
pts AS (SELECT *, CASE WHEN wc BETWEEN 2 AND 7 THEN 45 ELSE 0 END + CASE WHEN io BETWEEN 2 AND 7 THEN 45 ELSE 0 END + CASE WHEN coastal THEN 15 ELSE 0 END + CASE WHEN osm THEN 15 ELSE 0 END + CASE WHEN cliff THEN 15 ELSE 0 END - CASE WHEN vegetation THEN 50 ELSE 0 END AS score, wc = 9 OR io = 9 AS built FROM coast),
kinds AS (SELECT *, (score >= 55 OR osm) AND NOT (built AND NOT osm) AND NOT water AS exposed FROM pts)"""


def _scored(spark, d):
    c = i.cells(spark, d).withColumn("wet", F.expr("wc = 8 AND io = 8")).withColumn("connected", F.col("osm"))
    return raster.evidence(raster.coastal_distance(c, "wet", 100.0, 250.0, 310.0))


@query(f"WITH {SCORED} SELECT grid_id, row, col, CAST(score AS INT) AS score, exposed, CAST(CASE WHEN water THEN 8 WHEN exposed THEN 2 WHEN built THEN 9 WHEN vegetation THEN 1 ELSE 0 END AS INT) AS class FROM kinds")
def evidence_scores(spark, d):
    return _scored(spark, d).select("grid_id", "row", "col", "score", "exposed", "class")


@query(f"WITH {SCORED} SELECT grid_id, count(*) FILTER (exposed) AS exposed_cells, round(100e0 * count(*) FILTER (exposed) / count(*), 6) AS exposed_percent, round(100e0 * count(*) FILTER (vegetation AND NOT water AND NOT exposed AND NOT built) / count(*), 6) AS vegetation_percent, round(100e0 * count(*) FILTER (water) / count(*), 6) AS water_percent FROM kinds GROUP BY grid_id")
def ground_cover(spark, d):
    return raster.cover_stats(_scored(spark, d)).select("grid_id", "exposed_cells", *r6("exposed_percent", "vegetation_percent", "water_percent"))


@query(f"WITH {SCORED} SELECT count(*) FILTER (water) AS water, count(*) FILTER (osm) AS osm, count(*) FILTER (cliff) AS cliff, count(*) FILTER (vegetation) AS vegetation, count(*) FILTER (coastal) AS coastal, count(*) FILTER (exposed) AS exposed FROM kinds")
def contribution_counts(spark, d):
    return raster.mask_counts(_scored(spark, d), "water", "osm", "cliff", "vegetation", "coastal", "exposed")


@query(f"WITH {CELLS}, p AS (SELECT grid_id, floor(elev / 10) AS level, count(*) AS n FROM cells WHERE water GROUP BY ALL) SELECT grid_id, level, n FROM p QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY n DESC, level) = 1")
def water_plateau(spark, d):
    return raster.plateau(i.cells(spark, d).withColumn("h", F.expr("double(floor(elev / 10))")), "h", "water").select("grid_id", "level", "n")


def labelled(name: str, cells: str, rounds: int = 8) -> str:
    """SQL that labels the cells ``grid_id, row, col`` of a table with the smallest number of their 8-connected component, as ``name``.

    In each round a cell takes the smallest label around it, hands it to its label's cell, and jumps to its label's label.
    """
    number = "grid_id * 6400 + row * 64 + col"
    out = [
        f"{name}_own AS MATERIALIZED (SELECT {number} AS k, grid_id, row, col FROM {cells})",
        f"{name}_adj AS MATERIALIZED (SELECT a.k, b.k AS n FROM (SELECT k, {number} + dr * 64 + dc AS n FROM {name}_own, (SELECT unnest([-1,-1,-1,0,0,0,1,1,1]) AS dr, unnest([-1,0,1,-1,0,1,-1,0,1]) AS dc) WHERE row + dr BETWEEN 0 AND 99 AND col + dc BETWEEN 0 AND 63) a JOIN {name}_own b ON b.k = a.n)",
        f"{name}_0 AS MATERIALIZED (SELECT k, k AS f FROM {name}_own)",
    ]
    for i in range(rounds):
        out.append(f"{name}_m{i} AS MATERIALIZED (SELECT a.k, min(y.f) AS m, min(CASE WHEN a.k = a.n THEN y.f END) AS f FROM {name}_adj a JOIN {name}_{i} y ON y.k = a.n GROUP BY a.k)")
        out.append(f"{name}_h{i} AS MATERIALIZED (SELECT k, least(m, min(m) OVER (PARTITION BY f)) AS f FROM {name}_m{i})")
        out.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT h.k, j.f FROM {name}_h{i} h JOIN {name}_h{i} j ON j.k = h.f)")
    out.append(f"{name} AS MATERIALIZED (SELECT o.grid_id, o.row, o.col, (f % 6400)::BIGINT AS component FROM {name}_{rounds} JOIN {name}_own o USING (k))")
    return ",\n".join(out)


EXPOSED_CELLS = CELLS + """,
bare AS MATERIALIZED (SELECT grid_id, row, col FROM cells WHERE wc BETWEEN 2 AND 7)"""


@query(f"WITH {EXPOSED_CELLS}, {labelled('lab', 'bare')} SELECT grid_id, component, count(*) AS cells, count(*)::DOUBLE AS area, greatest(max(row) - min(row) + 1, max(col) - min(col) + 1)::DOUBLE AS span, bool_or(row IN (0, 99) OR col IN (0, 63)) AS touches_border FROM lab GROUP BY grid_id, component")
def mask_components(spark, d):
    c = raster.components(i.cells(spark, d).withColumn("on", geo.exposed(F.col("wc"))), "on")
    return raster.component_stats(c, 100, 64)


@query(f"""WITH {CELLS}, sea AS MATERIALIZED (SELECT grid_id, row, col FROM cells WHERE wc >= 5 OR io = 8), {labelled('lab', 'sea')},
big AS (SELECT grid_id, component FROM lab GROUP BY ALL HAVING count(*) >= 64 AND bool_or(row IN (0, 99) OR col IN (0, 63))) SELECT lab.* FROM lab JOIN big USING (grid_id, component)""")
def coastal_components(spark, d):
    c = i.cells(spark, d).withColumn("sea", F.expr("wc >= 5 OR io = 8"))
    return raster.coastal_water(raster.components(c, "sea"), 100, 64).select("grid_id", "row", "col", "component")


@query(f"""WITH {EXPOSED_CELLS}, {labelled('lab', 'bare')}, marks AS (SELECT grid_id, row, col FROM cells WHERE (row * 17 + col * 5) % 97 = 0),
hit AS (SELECT DISTINCT l.grid_id, l.component FROM lab l JOIN marks m ON m.grid_id = l.grid_id AND abs(m.row - l.row) <= 1 AND abs(m.col - l.col) <= 1) SELECT lab.* FROM lab JOIN hit USING (grid_id, component)""")
def anchored_components(spark, d):
    c = i.cells(spark, d)
    return raster.anchored(raster.components(c.withColumn("on", geo.exposed(F.col("wc"))), "on"), c.where("(row * 17 + col * 5) % 97 = 0")).select("grid_id", "row", "col", "component")


@query(f"""WITH {CELLS}, c0 AS MATERIALIZED (SELECT grid_id, row, col, wc, wc BETWEEN 2 AND 7 AND NOT (water OR wc = 8) AS on_, water OR wc = 8 AS wet, water FROM cells),
c1 AS MATERIALIZED (SELECT c.grid_id, c.row, c.col, c.wc, c.water, c.wet, ((c.on_ AND coalesce(n, 0) >= 1) OR (NOT c.on_ AND coalesce(n, 0) >= 6)) AND NOT c.wet AS on_ FROM c0 c LEFT JOIN
  (SELECT grid_id, row + dr AS row, col + dc AS col, count(*) AS n FROM c0, (SELECT unnest([-1,-1,-1,0,0,1,1,1]) AS dr, unnest([-1,0,1,-1,1,-1,0,1]) AS dc) WHERE on_ GROUP BY ALL) k USING (grid_id, row, col)),
isles AS MATERIALIZED (SELECT grid_id, row, col FROM c1 WHERE on_), {labelled('isle', 'isles')},
small AS (SELECT grid_id, component FROM isle GROUP BY ALL HAVING count(*) * 0.16e0 < 0.5e0 AND greatest(max(row) - min(row) + 1, max(col) - min(col) + 1) * 0.4e0 < 2e0),
c2 AS MATERIALIZED (SELECT c.* EXCLUDE (on_), c.on_ AND s.component IS NULL AS on_ FROM c1 c LEFT JOIN isle i USING (grid_id, row, col) LEFT JOIN small s ON s.grid_id = i.grid_id AND s.component = i.component),
gaps AS MATERIALIZED (SELECT grid_id, row, col FROM c2 WHERE NOT on_ AND NOT wet), {labelled('gap', 'gaps')},
holes AS (SELECT grid_id, component FROM gap GROUP BY ALL HAVING NOT bool_or(row IN (0, 99) OR col IN (0, 63)) AND count(*) * 0.16e0 <= 0.5e0)
SELECT c.grid_id, c.row, c.col, wc AS class, water, (c.on_ OR h.component IS NOT NULL) AND NOT wet AS cleaned FROM c2 c LEFT JOIN gap g USING (grid_id, row, col) LEFT JOIN holes h ON h.grid_id = g.grid_id AND h.component = g.component""")
def cleaned_mask(spark, d):
    return raster.clean_exposed(i.cells(spark, d).withColumnRenamed("wc", "class"), cell_w=0.4, cell_h=0.4, shape=(100, 64))


@query(f"""WITH {CELLS}, k AS (SELECT grid_id, row, col, elev, (row * col) % 5 = 1 AS gone FROM cells), o AS (SELECT unnest([-1,-1,-1,0,0,1,1,1]) AS dr, unnest([-1,0,1,-1,1,-1,0,1]) AS dc),
f AS (SELECT g.grid_id, g.row, g.col, avg(n.elev) AS elev FROM (SELECT k.*, row + dr AS nr, col + dc AS nc FROM k, o WHERE gone) g JOIN k n ON n.grid_id = g.grid_id AND n.row = nr AND n.col = nc AND NOT n.gone GROUP BY ALL)
SELECT grid_id, row, col, round(elev, 6) AS elev FROM k WHERE NOT gone UNION ALL SELECT grid_id, row, col, round(elev, 6) FROM f""")
def repaired_elevation(spark, d):
    return raster.repair_elevation(i.cells(spark, d).withColumn("elev", F.expr("CASE WHEN (row * col) % 5 = 1 THEN -99999 ELSE elev END")), "elev").select("grid_id", "row", "col", *r6("elev"))


@query(f"WITH {CELLS} SELECT grid_id, row, col, CAST(CASE WHEN io <> 0 THEN io ELSE wc END AS INT) AS class FROM cells")
def raster_mosaic(spark, d):
    c = i.cells(spark, d)
    layers = c.selectExpr("grid_id", "row", "col", "wc AS class", "1 AS item_order").unionByName(c.selectExpr("grid_id", "row", "col", "io AS class", "2 AS item_order"))
    return raster.mosaic(layers)


def _solid(spark, d):
    """A solid for every grid."""
    own = i.cells(spark, d)
    last = own.groupBy("grid_id").agg(F.max("row").alias("last"))
    c = own.join(last, "grid_id").selectExpr("grid_id", "row", "col", "double(col) AS x", "double(last - row) AS y", "elev / 1000 + 2 AS h_mm")
    return mesh.terrain_solid(c, 100, 64, 1.6, F.concat(F.lit("terrain/"), F.col("grid_id")))


SOLIDS = CELLS + """,
solids AS (SELECT 'terrain/' || grid_id AS layer, grid_id, count(*) AS n, max(row) AS r, max(col) AS c, sum(elev / 1000 + 2) AS z FROM cells GROUP BY grid_id)"""


@query(f"WITH {SOLIDS} SELECT layer, 2 * n AS vertices, (4 * r * c + 2 * (2 * r + 2 * c))::BIGINT AS faces, 0::BIGINT AS open_edges, 0::BIGINT AS overused_edges, 0::BIGINT AS winding_defects, round(z - n * 1.6e0, 3) AS z_sum FROM solids")
def terrain_solid(spark, d):
    v, f = _solid(spark, d)
    z = v.groupBy("layer").agg(F.round(F.sum("z"), 3).alias("z_sum"))
    return mesh.mesh_stats(v, f).join(mesh.edge_defects(f), "layer").join(z, "layer").select("layer", "vertices", "faces", "open_edges", "overused_edges", "winding_defects", "z_sum")


@query(f"WITH {SOLIDS} SELECT layer, (r * c)::DOUBLE AS area_mm2 FROM solids")
def upward_area(spark, d):
    return mesh.projected_area(mesh.corners(*_solid(spark, d))).select("layer", F.round("area_mm2", 6).alias("area_mm2"))


@query(f"""WITH {SOLIDS} SELECT 'non_manifold' AS code, layer, layer || ' is non-manifold (3 open and 0 over-connected edges)' AS message FROM solids WHERE grid_id % 5 = 1
UNION ALL SELECT 'inconsistent_winding', layer, layer || ' has inconsistent face winding' FROM solids WHERE grid_id % 5 = 2
UNION ALL SELECT 'non_positive_volume', layer, layer || ' does not define a positive outward-facing volume' FROM solids WHERE grid_id % 5 = 3
UNION ALL SELECT 'invalid_coordinates', layer, layer || ' contains invalid coordinates' FROM solids WHERE grid_id % 5 = 4""")
def printability_audit(spark, d):
    """Each solid is damaged in a way of its own: a face gone, a face turned, all faces turned, a corner that is no number."""
    v, f = _solid(spark, d)
    way = F.split("layer", "/")[1].cast("int") % 5
    turned = (way == 3) | ((way == 2) & (F.col("fid") == 0))
    f = f.where(~((way == 1) & (F.col("fid") == 0))).select("layer", "fid", "a", F.when(turned, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turned, F.col("b")).otherwise(F.col("c")).alias("c"))
    v = v.withColumn("z", F.when((way == 4) & (F.col("vid") == 7), F.lit(float("nan"))).otherwise(F.col("z")))
    return mesh.audit(v, f)


@query("SELECT s_nationkey, count(*) AS faces, CASE WHEN sum(count(*)) OVER () <= 50 THEN count(*) ELSE greatest(4, CAST(round_even(50e0 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT)) END AS budget FROM supplier GROUP BY s_nationkey")
def preview_budget(spark, d):
    s = i.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("faces"))
    return mesh.face_budget(s, 50)


@query("SELECT p_partkey, p_brand AS name, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) > 1 THEN p_brand || '_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::VARCHAR ELSE p_brand END AS unique_name FROM part")
def unique_names(spark, d):
    return mesh.unique_names(i.table(spark, d, "part").selectExpr("p_partkey", "p_brand AS name"), "name", "p_partkey")


@query("SELECT p_partkey, CASE WHEN regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') = '' THEN 'item' ELSE regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') END AS name, sha256(p_name) AS key FROM part")
def safe_names(spark, d):
    return i.table(spark, d, "part").select("p_partkey", geo.safe_name(F.col("p_name")).alias("name"), F.sha2("p_name", 256).alias("key"))


@query("SELECT p_partkey, round(least(p_size / 1e1, 0.2e0) + 2.0e0, 6) AS height, round(-least(p_size / 1e1, 0.2e0), 6) AS bottom FROM part")
def embedded_features(spark, d):
    e = frames.embedded(F.lit(2.0), F.expr("p_size / 1e1"), F.lit(0.2))
    return i.table(spark, d, "part").select("p_partkey", F.round(e["height"], 6).alias("height"), F.round(e["bottom"], 6).alias("bottom"))


@query(f"""WITH {SEGMENTS}, {SPOTS}, s AS (SELECT *, x1-x0 AS dx, y1-y0 AS dy, seq = min(seq) OVER (PARTITION BY route_id) AS f, seq = max(seq) OVER (PARTITION BY route_id) AS l FROM segs),
p AS (SELECT point_id, x / 5 AS x, y / 4 AS y FROM spots),
j AS (SELECT point_id, route_id, x, y, x0, y0, dx, dy, f, l, CASE WHEN dx*dx+dy*dy > 0 THEN ((x-x0)*dx + (y-y0)*dy) / (dx*dx+dy*dy) END AS raw FROM p, s WHERE x BETWEEN least(x0, x1) - 0.6e0 AND greatest(x0, x1) + 0.6e0 AND y BETWEEN least(y0, y1) - 0.6e0 AND greatest(y0, y1) + 0.6e0),
t AS (SELECT *, coalesce(greatest(0e0, least(1e0, raw)), 0e0) AS t FROM j)
SELECT DISTINCT point_id, route_id FROM t WHERE sqrt((x-x0-t*dx)*(x-x0-t*dx) + (y-y0-t*dy)*(y-y0-t*dy)) <= 0.6e0 AND NOT (coalesce(raw < 0 AND f, false) OR coalesce(raw > 1 AND l, false))""")
def route_membership(spark, d):
    at = i.spots(spark, d).selectExpr("point_id", "x / 5 AS x", "y / 4 AS y")
    # A task gets about 25,000 points: adaptive execution would go by the size of the lines, and what is found is many times larger.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), i.table(spark, d, "events").count() // 25_000)
    ln = i.lines(spark, d).repartition(tasks, "route_id")
    return spatial.route_membership(at, spatial.segments(ln), 1.2, cell=16.0).select("point_id", "route_id")


@query("SELECT o_custkey AS body_id, greatest(-0.8e0, min(o_orderkey % 50 / 1e1) - 0.4e0) AS level_mm FROM orders GROUP BY o_custkey")
def body_levels(spark, d):
    return profile.body_levels(i.table(spark, d, "orders").selectExpr("o_custkey AS body_id", "o_orderkey % 50 / 1e1 AS h_mm"))


def _faces(spark, d):
    t = i.table(spark, d, "orders")
    return t.selectExpr("string(o_orderkey % 4) AS layer", "o_orderkey AS fid", "o_custkey % 97 AS a", "o_orderkey % 89 + 100 AS b", "o_orderkey * 7 % 83 + 200 AS c", "int(o_orderkey % 256) AS r", "int(o_custkey % 256) AS g", "int(o_orderkey * 3 % 256) AS b_")


FACES = """faces AS (SELECT (o_orderkey % 4)::VARCHAR AS layer, o_orderkey AS fid, o_custkey % 97 AS a, o_orderkey % 89 + 100 AS b, o_orderkey * 7 % 83 + 200 AS c, o_orderkey % 256 AS r, o_custkey % 256 AS g, o_orderkey * 3 % 256 AS b_ FROM orders)"""


@query(f"WITH {FACES}, v AS (SELECT layer, unnest([a, b, c]) AS vid, r, g, b_ FROM faces) SELECT layer, vid, round_even(avg(r), 0)::INT AS r, round_even(avg(g), 0)::INT AS g, round_even(avg(b_), 0)::INT AS b FROM v GROUP BY layer, vid")
def vertex_colours(spark, d):
    f = _faces(spark, d)
    return mesh.vertex_colours(f.select("layer", "fid", "a", "b", "c"), f.select("layer", "fid", "r", "g", F.col("b_").alias("b")))


@query(f"""WITH {FACES}, e AS (SELECT layer, unnest([a, b, c]) AS p, unnest([b, c, a]) AS q FROM faces), n AS (SELECT layer, least(p, q) AS lo, greatest(p, q) AS hi, count(*) AS n, count(*) FILTER (p < q) AS up FROM e GROUP BY ALL)
SELECT layer, count(*) AS edges, count(*) FILTER (n = 1) AS open_edges, count(*) FILTER (n > 2) AS overused_edges, count(*) FILTER (n = 2 AND up <> 1) AS winding_defects FROM n GROUP BY layer""")
def edge_defects(spark, d):
    return mesh.edge_defects(_faces(spark, d).select("layer", "fid", "a", "b", "c"))


@query(f"WITH RECURSIVE {FACES}, e AS (SELECT layer, a AS p, b AS q FROM faces UNION SELECT layer, b, c FROM faces), u AS (SELECT layer, p, q FROM e UNION SELECT layer, q, p FROM e), r AS (SELECT layer, p AS root, p AS v FROM u UNION SELECT r.layer, r.root, u.q FROM r JOIN u ON u.layer = r.layer AND u.p = r.v), m AS (SELECT layer, v, min(root) AS component FROM r GROUP BY ALL) SELECT f.layer, fid, component FROM faces f JOIN m ON m.layer = f.layer AND m.v = f.a")
def mesh_shells(spark, d):
    return mesh.shells(_faces(spark, d).select("layer", "fid", "a", "b", "c"))


@query(f"WITH {SOLIDS}, box AS (SELECT max(c) AS w, max(r) AS h FROM solids) SELECT layer, (190e0 - w) / 2 AS x0, (190e0 - w) / 2 + c AS x1, (240e0 - h) / 2 AS y0, (240e0 - h) / 2 + r AS y1 FROM solids, box")
def centred_mesh(spark, d):
    v, _ = _solid(spark, d)
    return mesh.centred(v, 190.0, 240.0).groupBy("layer").agg(*(F.round(f(c), 6).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))))


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS fid, (l_partkey % 10)::DOUBLE AS ax, (l_suppkey % 10)::DOUBLE AS ay, (l_partkey % 7)::DOUBLE AS az, (l_partkey % 10 + 5)::DOUBLE AS bx, (l_suppkey % 9)::DOUBLE AS "by", 1e0 AS bz, (l_partkey % 8)::DOUBLE AS cx, (l_suppkey % 10 + 6)::DOUBLE AS cy, 2e0 AS cz, (l_orderkey % 15)::DOUBLE AS x, (l_linenumber * 2)::DOUBLE AS y FROM lineitem),
w AS (SELECT *, (("by" - cy) * (x - cx) + (cx - bx) * (y - cy)) / (("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS w0, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / (("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS w1 FROM t WHERE abs(("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy)) > 1e-12)
SELECT fid, round(w0 * az + w1 * bz + (1 - w0 - w1) * cz, 6) AS height FROM w WHERE least(w0, w1, 1 - w0 - w1) >= -1e-7""")
def triangle_heights(spark, d):
    t = i.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS fid", "double(l_partkey % 10) AS ax", "double(l_suppkey % 10) AS ay", "double(l_partkey % 7) AS az", "double(l_partkey % 10 + 5) AS bx", "double(l_suppkey % 9) AS by", "1e0 AS bz", "double(l_partkey % 8) AS cx", "double(l_suppkey % 10 + 6) AS cy", "2e0 AS cz", "double(l_orderkey % 15) AS x", "double(l_linenumber * 2) AS y")
    return mesh.triangle_height(t).where("height is not null").select("fid", *r6("height"))


@query(f"""WITH {CELLS}, t AS (SELECT grid_id, row, col, unnest([0, 1]) AS half, unnest([wc BETWEEN 1 AND 6, io BETWEEN 1 AND 6]) AS wet FROM cells WHERE row < 99 AND col < 63),
v AS (SELECT grid_id, row + unnest(CASE WHEN half = 0 THEN [0, 1, 0] ELSE [0, 1, 1] END) AS row, col + unnest(CASE WHEN half = 0 THEN [0, 0, 1] ELSE [1, 0, 1] END) AS col, wet FROM t),
w AS (SELECT grid_id, row, col FROM v GROUP BY ALL HAVING bool_and(wet))
SELECT c.grid_id, c.row, c.col, c.elev - CASE WHEN w.row IS NULL THEN 0 ELSE 0.5e0 END AS elev FROM cells c LEFT JOIN w ON w.grid_id = c.grid_id AND w.row = c.row AND w.col = c.col""")
def recessed_terrain(spark, d):
    c = i.cells(spark, d)
    t = c.where("row < 99 AND col < 63").selectExpr("grid_id", "row", "col", "posexplode(array(wc BETWEEN 1 AND 6, io BETWEEN 1 AND 6)) AS (half, wet)")
    return raster.recess(c.select("grid_id", "row", "col", "elev"), raster.water_vertices(100, 64, t, "wet"), 0.5, "elev")


@query(f"""WITH {CELLS}, a AS (SELECT round(count(*) FILTER (wc = 1) * 0.02e0, 6) AS v, round(count(*) FILTER (wc BETWEEN 2 AND 7) * 0.02e0, 6) AS e, round(count(*) FILTER (wc = 8) * 0.02e0, 6) AS w FROM cells)
SELECT 24000e0 AS print_area_mm2, v AS vegetation_area_mm2, e AS exposed_area_mm2, w AS water_area_mm2, round(v / 24000e0, 9) AS vegetation_fraction, round(e / 24000e0, 9) AS exposed_fraction, round(w / 24000e0, 9) AS water_fraction FROM a""")
def cover_signature(spark, d):
    kind = F.expr("CASE WHEN wc = 1 THEN 'vegetation' WHEN wc BETWEEN 2 AND 7 THEN 'exposed' WHEN wc = 8 THEN 'water' ELSE 'other' END")
    areas = i.cells(spark, d).groupBy(kind.alias("layer")).agg((F.count("*") * 0.02).alias("area_mm2"))
    out = mesh.cover_signature(areas, 160.0, 150.0)
    return out.select(*(F.round(c, 9 if c.endswith("fraction") else 6).alias(c) for c in out.columns))


def _ground(spark, d):
    """Sampler of the mean of all grids, stretched over the plate."""
    c = i.cells(spark, d).groupBy("row", "col").agg(F.avg("elev").alias("elev")).withColumn("grid_id", F.lit(0))
    return lambda p: raster.bilinear(p.withColumn("grid_id", F.lit(0)).withColumn("f_row", F.col("y") * (99 / 240)).withColumn("f_col", F.col("x") * (63 / 190)), c, "elev", 100, 64).drop("grid_id", "f_row", "f_col")


def sampled(points: str) -> str:
    """SQL that adds ``sample`` to the table ``points`` with ``x, y``; needs CELLS."""
    return f"""ground AS (SELECT row, col, avg(elev) AS elev FROM cells GROUP BY row, col),
spot AS (SELECT *, greatest(0e0, least(99e0, y * (99e0 / 240e0))) AS fr, greatest(0e0, least(63e0, x * (63e0 / 190e0))) AS fc FROM {points}),
sampled AS (SELECT spot.*, (a.elev * (1 - (fc - floor(fc))) + b.elev * (fc - floor(fc))) * (1 - (fr - floor(fr))) + (c.elev * (1 - (fc - floor(fc))) + e.elev * (fc - floor(fc))) * (fr - floor(fr)) AS sample FROM spot
  JOIN ground a ON a.row = floor(fr)::INT AND a.col = floor(fc)::INT JOIN ground b ON b.row = floor(fr)::INT AND b.col = least(floor(fc)::INT + 1, 63)
  JOIN ground c ON c.row = least(floor(fr)::INT + 1, 99) AND c.col = floor(fc)::INT JOIN ground e ON e.row = least(floor(fr)::INT + 1, 99) AND e.col = least(floor(fc)::INT + 1, 63))"""


#: Support of each station of the lines: three places along the line, five across it at each, the highest sample of those.
PROFILE = f"""{SEGMENTS}, {CELLS},
seg AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS station FROM segs),
size AS (SELECT route_id, sum(length) AS l FROM seg GROUP BY route_id),
own AS (SELECT *, least(1e0, greatest(0.05e0, l / 500)) AS delta FROM (SELECT DISTINCT route_id, station AS mark FROM seg) JOIN size USING (route_id)),
spread AS (SELECT *, greatest(0e0, least(l, mark + d)) AS s FROM own, (VALUES (1e0, -1.5e0), (2e0, 0e0), (1e0, 1.5e0)) AS v(w, d)),
three AS (SELECT *, CASE i WHEN 0 THEN s WHEN 1 THEN greatest(0e0, s - delta) ELSE least(l, s + delta) END AS q FROM spread, (VALUES (0), (1), (2)) AS k(i)),
head AS (SELECT route_id, station, arg_max(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, n := length), seq) AS g FROM seg GROUP BY ALL),
met AS (SELECT three.*, g, CASE WHEN g.n > 0 THEN least(1e0, (q - station) / g.n) ELSE 0e0 END AS t FROM three ASOF JOIN head ON three.route_id = head.route_id AND three.q >= head.station),
wide AS (SELECT route_id, mark, w, d, max(g.x0 + t * (g.x1 - g.x0)) FILTER (i = 0) AS x, max(g.y0 + t * (g.y1 - g.y0)) FILTER (i = 0) AS y,
  max(g.x0 + t * (g.x1 - g.x0)) FILTER (i = 2) - max(g.x0 + t * (g.x1 - g.x0)) FILTER (i = 1) AS tx, max(g.y0 + t * (g.y1 - g.y0)) FILTER (i = 2) - max(g.y0 + t * (g.y1 - g.y0)) FILTER (i = 1) AS ty FROM met GROUP BY route_id, mark, w, d),
turned AS (SELECT *, CASE WHEN sqrt(tx * tx + ty * ty) <= 1e-9 THEN 1e0 ELSE tx / sqrt(tx * tx + ty * ty) END AS ux, CASE WHEN sqrt(tx * tx + ty * ty) <= 1e-9 THEN 0e0 ELSE ty / sqrt(tx * tx + ty * ty) END AS uy FROM wide),
pts AS (SELECT route_id, mark, w, d, x - uy * o AS x, y + ux * o AS y FROM turned, (VALUES (-0.6e0), (-0.3e0), (0e0), (0.3e0), (0.6e0)) AS v(o)),
{sampled("pts")},
support AS (SELECT route_id, mark, w, d, max(sample) AS support FROM sampled GROUP BY route_id, mark, w, d),
need AS (SELECT route_id, mark AS station, sum(w * support) / 4 AS smooth, max(support) FILTER (w = 2) AS local FROM support GROUP BY route_id, mark),
limited AS (SELECT *, greatest(max(greatest(smooth, local) + 2 + 0.3e0 * station) OVER (PARTITION BY route_id ORDER BY station) - 0.3e0 * station,
  max(greatest(smooth, local) + 2 - 0.3e0 * station) OVER (PARTITION BY route_id ORDER BY station DESC) + 0.3e0 * station) AS limited FROM need)"""


@query(f"WITH {PROFILE} SELECT route_id, round(station, 6) AS station, round(smooth, 6) AS smooth, round(local, 6) AS local, round(limited, 6) AS limited FROM limited")
def route_profile(spark, d):
    """Cross-sections of every line over the terrain, smoothed along it and held to a slope."""
    pairs = spatial.segments(i.lines(spark, d))
    support = profile.smoothed_support(pairs.select("route_id", "station"), pairs, 1.2, 1.5, _ground(spark, d))
    return profile.slope_limited(support.withColumn("height", F.greatest("smooth", "local") + 2.0), 0.3).select("route_id", *r6("station", "smooth", "local", "limited"))


@query(f"WITH {PROFILE} SELECT seg.route_id, seq * 2 + k AS vid, round(seg.station, 6) AS station, round(limited - 2 + k, 6) AS z FROM seg JOIN limited ON seg.route_id = limited.route_id AND seg.station = limited.station, (VALUES (0), (1)) AS v(k)")
def draped_route(spark, d):
    ln = i.lines(spark, d)
    pairs = spatial.segments(ln)
    v = pairs.select("route_id", F.explode(F.array(*(F.struct((F.col("seq") * 2 + k).alias("vid"), F.lit(float(k)).alias("z")) for k in (0, 1)))).alias("v"), "station")
    v = v.select("route_id", "v.vid", "v.z", "station")
    return profile.drape_route(v.select("route_id", "vid", "z"), v.select("route_id", "vid", "station"), pairs, _ground(spark, d), 1.2, 1.0).select("route_id", "vid", *r6("station", "z"))


@query(f"""WITH {LINES}, {CELLS}, ends AS (SELECT route_id, arg_min(x_mm, seq) AS sx, arg_min(y_mm, seq) AS sy, arg_max(x_mm, seq) AS fx, arg_max(y_mm, seq) AS fy FROM lines GROUP BY route_id),
marks AS (SELECT route_id || '/start' AS marker_id, sx AS cx, sy AS cy FROM ends UNION ALL SELECT route_id || '/finish', fx, fy FROM ends WHERE sqrt((fx-sx)*(fx-sx)+(fy-sy)*(fy-sy)) > 1),
pts AS (SELECT marker_id, cx + 1.6e0 * CASE WHEN k = 0 THEN 0 ELSE cos(2 * pi() * (k - 1) / 32) END AS x, cy + 1.6e0 * CASE WHEN k = 0 THEN 0 ELSE sin(2 * pi() * (k - 1) / 32) END AS y FROM marks, (SELECT unnest(generate_series(0, 32)) AS k) WHERE cx - 1.6 >= 0 AND cx + 1.6 <= 190 AND cy - 1.6 >= 0 AND cy + 1.6 <= 240),
{sampled('pts')} SELECT marker_id, round(min(sample) - 0.2e0, 6) AS bottom_mm, round(max(sample) + 1, 6) AS top_mm FROM sampled GROUP BY marker_id""")
def draped_markers(spark, d):
    m = frames.markers(i.lines(spark, d)).selectExpr("concat(route_id, '/', marker) AS marker_id", "x_mm AS x", "y_mm AS y")
    return profile.marker_mesh(_ground(spark, d)(profile.marker_samples(m, plate=(0.0, 0.0, 190.0, 240.0)))).select("marker_id", *r6("bottom_mm", "top_mm"))


@query(f"""WITH {LINES}, {CELLS}, o AS (SELECT unnest([-1,-1,-1,0,0,0,1,1,1]) AS dx, unnest([-1,0,1,-1,0,1,-1,0,1]) AS dy),
pts AS (SELECT point_id AS vid, dx, dy, x_mm + 2e0 * dx AS x, y_mm + 2e0 * dy AS y FROM lines, o), {sampled('pts')}
SELECT vid, round(1 + greatest(sum(sample * (2 - abs(dx)) * (2 - abs(dy))) / 16, sum(CASE WHEN dx = 0 AND dy = 0 THEN sample END) + 0.4e0 - 1), 6) AS z FROM sampled GROUP BY vid""")
def smoothed_tops(spark, d):
    at = i.lines(spark, d).selectExpr("point_id AS vid", "x_mm AS x", "y_mm AS y", "1e0 AS z")
    return profile.smoothed_tops(at, _ground(spark, d), 2.0, 0.4).select("vid", *r6("z"))


def _layers(n: int) -> str:
    """SQL of ``n`` rounds that fill open cells with the mean of their known four neighbours."""
    one = "f{b} AS (SELECT k.grid_id, k.row, k.col, k.wet, CASE WHEN k.v IS NULL AND NOT k.wet THEN m.v ELSE k.v END AS v FROM f{a} k LEFT JOIN (SELECT n.grid_id, n.row + o.dr AS row, n.col + o.dc AS col, avg(n.v) AS v FROM f{a} n, four o WHERE NOT n.wet AND n.v IS NOT NULL GROUP BY ALL) m USING (grid_id, row, col))"
    return ",\n".join(one.format(a=k, b=k + 1) for k in range(n))


FLAT = CELLS + """,
flat AS (SELECT grid_id, row, col, water, CASE WHEN water OR (row * col) % 4 = 0 THEN 1e0 ELSE elev END AS h_mm FROM cells),
level_ AS (SELECT grid_id, round(h_mm, 9) AS level, count(*) AS n FROM flat WHERE water GROUP BY grid_id, round(h_mm, 9) QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY count(*) DESC, round(h_mm, 9)) = 1),
sure AS (SELECT l.grid_id, level, cells_ FROM level_ l JOIN (SELECT grid_id, count(*) AS cells_, count(*) FILTER (water) AS wet FROM flat GROUP BY grid_id) USING (grid_id) WHERE wet >= greatest(16, cells_ // 200) AND n >= greatest(16, wet // 20)),
marked AS (SELECT f.*, coalesce(abs(h_mm - level) <= 5e-9 AND NOT water, false) AS f FROM flat f LEFT JOIN sure USING (grid_id)),
land AS (SELECT m.grid_id, row, col, water, h_mm, f AND count(*) FILTER (f) OVER (PARTITION BY m.grid_id) >= greatest(16, count(*) OVER (PARTITION BY m.grid_id) // 2000) AS flattened FROM marked m)"""


def _flat(spark, d):
    return i.cells(spark, d).withColumn("h_mm", F.expr("CASE WHEN water OR (row * col) % 4 = 0 THEN 1e0 ELSE elev END"))


@query(f"WITH {FLAT} SELECT grid_id, row, col, flattened FROM land")
def flattened_land(spark, d):
    return raster.flattened_land(_flat(spark, d)).select("grid_id", "row", "col", "flattened")


@query(f"""WITH {FLAT}, four AS (SELECT unnest([-1, 0, 0, 1]) AS dr, unnest([0, -1, 1, 0]) AS dc), f0 AS (SELECT grid_id, row, col, water AS wet, CASE WHEN NOT flattened THEN h_mm END AS v FROM land), {_layers(12)}
SELECT grid_id, row, col, water, round(coalesce(CASE WHEN water THEN h_mm ELSE v END, h_mm), 6) AS h_mm FROM land JOIN f12 USING (grid_id, row, col)""")
def restored_land(spark, d):
    return raster.restore_land(_flat(spark, d)).select("grid_id", "row", "col", "water", *r6("h_mm"))


from . import shapes  # noqa: E402, F401  registers the queries of solids, water and masks

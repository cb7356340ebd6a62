"""Column functions for coordinates, tiles and colours. All are built-in expressions inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6378137.0
MERCATOR_LIMIT = 85.05112878
TILE_DEGREES = 3
# Raster codes of two land-cover products and the normalised classes they mean.
CLASSES = {"unknown": 0, "vegetation": 1, "bare": 2, "sand": 3, "rock": 4, "scree": 5, "shingle": 6, "mud": 7, "water": 8, "built": 9}
EXPOSED = (2, 3, 4, 5, 6, 7)
WORLDCOVER_CODES = {10: 1, 20: 1, 30: 1, 40: 1, 50: 9, 60: 2, 70: 2, 80: 8, 90: 1, 95: 1, 100: 1}
IMPACT_CODES = {1: 8, 2: 1, 4: 1, 5: 1, 7: 9, 8: 2, 9: 2, 11: 1}


def project(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Orthographic metres around a centre given in degrees."""
    p, q, p0, q0 = F.radians(lat), F.radians(lon), F.radians(lat0), F.radians(lon0)
    x = F.cos(p) * F.sin(q - q0)
    y = F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(q - q0)
    return x * F.lit(RADIUS_M), y * F.lit(RADIUS_M)


def unproject(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Degrees of orthographic metres; beyond the horizon is an error."""
    u, v = x / RADIUS_M, y / RADIUS_M
    far = F.hypot(u, v)
    rho = F.when(far > 1.0 + 1e-9, F.raise_error(F.lit("projected coordinates exceed the orthographic horizon")).cast("double")).otherwise(F.least(far, F.lit(1.0)))
    angle = F.asin(rho)
    p0, q0 = F.radians(lat0), F.radians(lon0)
    safe = F.when(rho > 1e-15, rho).otherwise(1.0)
    lat = F.asin(F.cos(angle) * F.sin(p0) + v * F.sin(angle) * F.cos(p0) / safe)
    lon = q0 + F.atan2(u * F.sin(angle), safe * F.cos(p0) * F.cos(angle) - v * F.sin(p0) * F.sin(angle))
    centre = rho <= 1e-15
    return F.when(centre, lat0).otherwise(F.degrees(lat)), F.when(centre, lon0).otherwise(F.degrees(lon))


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """Counter-clockwise rotation."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return x * c - y * s, x * s + y * c


def mercator_pixel(lat: Column, lon: Column, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    """Pixel of a web map at ``zoom``; latitude is limited to the square map's edge."""
    size = F.lit(float(tile * 2**zoom))
    bound = F.greatest(F.least(lat, F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT))
    return (lon + 180.0) / 360.0 * size, (1.0 - F.asinh(F.tan(F.radians(bound))) / math.pi) / 2.0 * size


def terrarium(red: Column, green: Column, blue: Column) -> Column:
    """Metres of an elevation tile's colour."""
    return red * 256.0 + green + blue / 256.0 - 32768.0


def tile_first(v: Column) -> Column:
    return (F.floor(v / TILE_DEGREES) * TILE_DEGREES).cast("int")


def tile_last(v: Column) -> Column:
    """Last tile that begins below ``v``; an upper edge on a tile boundary does not open the next one. Zero keeps tile zero."""
    return F.when(v == 0.0, F.lit(0)).otherwise(F.ceil(v / TILE_DEGREES) * TILE_DEGREES - TILE_DEGREES).cast("int")


def tiles(west: Column, south: Column, east: Column, north: Column) -> Column:
    """South-west corners of all tiles that bounds touch, south to north, then west to east."""
    lats = F.sequence(tile_first(south), tile_last(north), F.lit(TILE_DEGREES))
    lons = F.sequence(tile_first(west), tile_last(east), F.lit(TILE_DEGREES))
    return F.flatten(F.transform(lats, lambda a: F.transform(lons, lambda b: F.struct(a.alias("lat"), b.alias("lon")))))


def tile_name(lat: Column, lon: Column) -> Column:
    ns = F.when(lat >= 0, "N").otherwise("S")
    ew = F.when(lon >= 0, "E").otherwise("W")
    return F.concat(F.lit("ESA_WorldCover_10m_2021_v200_"), ns, F.lpad(F.abs(lat).cast("string"), 2, "0"), ew, F.lpad(F.abs(lon).cast("string"), 3, "0"), F.lit("_Map.tif"))


def recode(code: Column, table: dict[int, int]) -> Column:
    """Normalised class of a raster code, 0 where the table has none."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, code.cast("int")), F.lit(0))


def exposed(kind: Column) -> Column:
    return kind.isin(*EXPOSED)


def plausible_elevation(v: Column) -> Column:
    """The value, or null outside -12000 to 12000 metres and for NaN."""
    return F.when(v.between(-12000.0, 12000.0) & ~F.isnan(v), v)


def hex_colour(value: Column) -> Column:
    """``#RRGGBB`` in capitals, alpha dropped; anything else is an error."""
    good = value.rlike("^#[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?$")
    return F.when(good, F.upper(F.substring(value, 1, 7))).otherwise(F.raise_error(F.concat(F.lit("invalid layer colour: "), F.coalesce(value, F.lit("null")))))


def rgba(value: Column) -> Column:
    colour = hex_colour(value)
    return F.array(*(F.conv(F.substring(colour, i, 2), 16, 10).cast("int") for i in (2, 4, 6)), F.lit(255))


def safe_name(value: Column) -> Column:
    """Runs of other characters become one underscore, dots and underscores at the ends go, empty becomes ``item``."""
    plain = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(plain == "", "item").otherwise(plain)


def request_key(*parts: Column) -> Column:
    """Cache key of a request: hash of its fields as JSON in order of name."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)

"""Building dimensions, presets, landmark matches and the tiered height of printed relief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from .components import reachable
from .quantiles import percentiles
from .spatial import centroid, point_inside
from .tags import OVERRIDE_KEY, classify, first_value, number_m

# Per use, fallback storeys, storey height, least and greatest printed height, roofs, detail, parts may merge.
PRESETS = (
    ("residential", 2.0, 3.0, 0.8, 14.0, "flat,gabled,hipped", "standard", True),
    ("commercial_office", 6.0, 3.6, 0.8, 31.8, "flat,pyramidal,hipped", "preserve", True),
    ("industrial_warehouse", 1.0, 6.0, 0.8, 12.0, "flat,gabled,skillion", "simplify", True),
    ("retail", 1.0, 4.5, 0.8, 12.0, "flat,gabled", "simplify", True),
    ("parking", 4.0, 3.0, 0.8, 16.0, "flat", "simplify", True),
    ("civic_institutional", 3.0, 3.8, 0.8, 22.0, "flat,gabled,hipped", "preserve", True),
    ("stadium_arena", 3.0, 6.0, 1.0, 26.0, "flat,dome,barrel,retractable", "preserve", False),
    ("religious", 2.0, 4.5, 0.8, 26.0, "gabled,hipped,pyramidal,dome", "preserve", False),
    ("landmark", 8.0, 4.0, 1.0, 31.8, "flat,gabled,hipped,pyramidal,dome", "preserve", False),
    ("unknown", 2.0, 3.0, 0.8, 18.0, "flat", "standard", True),
)
# Metres assumed for a building type without other facts.
TYPE_HEIGHTS = {"apartments": 12.0, "office": 12.0, "commercial": 9.0, "hotel": 12.0, "hospital": 12.0, "industrial": 8.0, "warehouse": 8.0, "retail": 6.0, "church": 12.0, "cathedral": 18.0, "garage": 3.0, "garages": 3.0, "shed": 3.0}
ROOFS = ("flat", "gabled", "hipped", "pyramidal", "skillion")
ACCESSORY = ("carport", "garage", "garages", "kiosk", "shed")
SMALL_HOMES = ("bungalow", "cabin", "detached", "house", "semidetached_house")
TALL_USES = ("commercial_office", "civic_institutional", "landmark", "parking", "religious", "stadium_arena")
STOREY_MIN_M = 1.5


def presets(spark) -> DataFrame:
    """The ten presets as a dimension table."""
    return spark.createDataFrame([(*p, p[1] * p[2]) for p in PRESETS], "building_class string, fallback_levels double, floor_height_m double, min_printable_mm double, max_visual_mm double, roofs string, detail string, merge_parts boolean, fallback_height_m double")


def preset(kind: Column, field: int) -> Column:
    """One number of a use's preset."""
    table = F.create_map(*(x for p in PRESETS for x in (F.lit(p[0]), F.lit(float(p[field])))))
    return F.try_element_at(table, kind)


def real_height(tags: Column, default: float = 6.0, per_level: float = 3.0, most: float = 400.0) -> Column:
    """Metres from the height tag, storeys, roof storeys on the default, the type's height, or the default."""
    value = F.trim(first_value(tags, "height"))
    feet = F.endswith(value, F.lit("ft"))
    h = F.when(feet, F.trim(F.substring(value, F.lit(1), F.length(value) - 2)).try_cast("double") * 0.3048).otherwise(F.trim(F.replace(value, F.lit("m"), F.lit(""))).try_cast("double"))
    levels = F.trim(first_value(tags, "building:levels")).try_cast("double")
    roof = F.trim(first_value(tags, "roof:levels")).try_cast("double")
    kinds = F.create_map(*(F.lit(x) for pair in TYPE_HEIGHTS.items() for x in pair))
    kind = F.try_element_at(kinds, F.lower(F.trim(first_value(tags, "building"))))
    return F.coalesce(
        F.when(~F.isnan(h) & (h > 0) & (h <= most), h),
        F.when(~F.isnan(levels) & (levels > 0) & (levels <= most / per_level), levels * per_level),
        F.when(~F.isnan(roof) & (roof > 0) & (F.lit(default) + roof * per_level <= most), F.lit(default) + roof * per_level),
        F.least(kind, F.when(kind.isNotNull(), F.lit(most))),
        F.lit(default),
    )


def dimensions(features: DataFrame, default: float = 6.0, per_level: float = 3.0, most: float = 400.0, override_key: str = OVERRIDE_KEY) -> DataFrame:
    """Heights and roof of buildings and parts; ``features`` need ``tags``. Adds the dimension columns."""
    tags = F.col("tags")
    out = features.withColumn("building_class", classify(tags, override_key))
    unknown = F.col("building_class") == "unknown"
    out = out.withColumn("_lh", F.when(unknown, F.lit(per_level)).otherwise(preset(F.col("building_class"), 2)))
    lh = F.col("_lh")
    fallback = preset(F.col("building_class"), 1) * preset(F.col("building_class"), 2)
    zero = lambda key: number_m(first_value(tags, key), True)
    out = out.withColumn("min_height_m", F.coalesce(zero("min_height"), F.coalesce(zero("building:min_level"), F.lit(0.0)) * lh))
    out = out.withColumn("_roof", F.coalesce(zero("roof:height"), F.coalesce(zero("roof:levels"), F.lit(0.0)) * lh))
    out = out.withColumn("_h", number_m(first_value(tags, "height"))).withColumn("levels", number_m(first_value(tags, "building:levels")))
    part = F.coalesce(F.map_contains_key(tags, F.lit("building:part")), F.lit(False))
    fine = F.col("_h").isNotNull() & (F.col("_h") <= most) & (part | F.col("levels").isNull() | (F.col("_h") >= F.col("levels") * STOREY_MIN_M))
    by_levels = F.col("levels") * lh + F.col("_roof")
    source = F.when(fine, "height").when(by_levels <= most, "levels").when(~unknown, "class").otherwise("fallback")
    total = F.when(fine, F.col("_h")).when(by_levels <= most, by_levels).when(~unknown, F.least(fallback + F.col("_roof"), F.lit(most))).otherwise(real_height(tags, default, per_level, most))
    out = out.withColumn("height_source", source).withColumn("total_height_m", F.least(F.greatest(total, F.col("min_height_m") + 0.01), F.lit(most)))
    room = F.col("total_height_m") - F.col("min_height_m")
    shape = F.lower(F.trim(F.coalesce(F.try_element_at(tags, F.lit("roof:shape")), F.lit("flat"))))
    out = out.withColumn("roof_shape", F.when(shape.isin(*ROOFS), shape).otherwise("flat"))
    roof = F.least(F.col("_roof"), room)
    out = out.withColumn("roof_height_m", F.when(F.col("roof_shape") == "flat", 0.0).when(roof <= 0, F.least(lh, room)).otherwise(roof))
    lean = F.lower(F.trim(F.coalesce(F.try_element_at(tags, F.lit("roof:orientation")), F.lit("along"))))
    out = out.withColumn("roof_orientation", F.when(lean.isin("along", "across"), lean).otherwise("along"))
    out = out.withColumn("building_type", F.lower(F.trim(F.coalesce(first_value(tags, "building"), F.lit("yes"))))).withColumn("is_part", part)
    return out.withColumn("eave_height_m", F.greatest("min_height_m", F.col("total_height_m") - F.col("roof_height_m"))).drop("_lh", "_roof", "_h")


def storeys(real: Column) -> Column:
    """Storeys a building's height speaks for."""
    by_source = F.when((F.col("height_source") == "levels") & F.col("levels").isNotNull(), F.col("levels")).when(F.col("height_source") == "class", preset(F.col("building_class"), 1))
    return F.coalesce(by_source, real / 3.0)


def tier_references(dims: DataFrame, *group: str) -> DataFrame:
    """High reference (90th percentile, at least 9 storeys) and exceptional one, from confident heights only.

    Over a whole table the percentile comes from a histogram; for each of several groups it is an aggregate.
    """
    sure = dims.where(F.col("height_source").isin("height", "levels"))
    if not group:
        sure = sure.select(storeys(F.col("total_height_m")).alias("s"))
        (p,) = percentiles(sure, "s", [0.9])
        found = sure.agg(F.lit(p).cast("double").alias("p"), F.max("s").alias("m"))
    else:
        found = sure.groupBy(*group).agg(F.percentile(storeys(F.col("total_height_m")), 0.9).alias("p"), F.max(storeys(F.col("total_height_m"))).alias("m"))
    high = F.greatest(F.coalesce("p", F.lit(9.0)), F.lit(9.0))
    return found.select(*group, high.alias("high_ref"), F.greatest(high, F.coalesce("m", F.lit(9.0))).alias("top_ref"))


def tiered_height(dims: DataFrame, area: Column, ceiling_mm: float = 30.0, map_scale: float | None = None, reference_scale: float = 0.04, out: str = "tier_mm") -> DataFrame:
    """Adds the printed millimetres of each building; needs the dimension columns and ``high_ref, top_ref``."""
    if ceiling_mm <= 0 or reference_scale <= 0:
        raise ValueError("building height ceiling and reference scale must be positive")
    f = 1.0 if not map_scale or map_scale <= 0 else min(max((map_scale / reference_scale) ** 0.5, 0.45), 1.0)
    top = max(1.2, ceiling_mm * f)
    kind, use, source, levels = F.col("building_type"), F.col("building_class"), F.col("height_source"), F.col("levels")
    unknown = use == "unknown"
    base = F.when(kind.isin(*ACCESSORY), 1.2).when((use == "residential") & kind.isin(*SMALL_HOMES) & (area <= 180.0), 1.6).when(unknown & (area <= 40.0), 1.2).when(unknown & (area <= 120.0), 1.6).otherwise(2.0)
    dims = dims.withColumn("_s", storeys(F.col("total_height_m"))).withColumn("_low", F.greatest(F.lit(1.2), base * f))
    low, s = F.col("_low"), F.col("_s")
    two = max(1.2, 2.8 * f)
    mid = lambda s: F.greatest(F.lit(1.2), (3.0 + (s - 3.0) / 5.0 * 6.0) * f)
    counted = (source == "levels") & levels.isNotNull()
    sure = source.isin("height", "levels")
    floor = max(1.2, 9.0 * f)
    regular = max(floor, top * 0.58)
    ref, peak = F.col("high_ref"), F.col("top_ref")
    tier = F.least(
        F.when(kind.isin(*ACCESSORY), low)
        .when(counted & (levels <= 1.0), low)
        .when(counted & (levels <= 2.0), F.lit(two))
        .when(counted & (levels <= 8.0), mid(levels))
        .when(((s <= 2.0) | ~(sure | use.isin(*TALL_USES))) & sure & (s > 1.0), low + F.least(F.lit(1.0), s - 1.0) * (F.lit(two) - low))
        .when((s <= 2.0) | ~(sure | use.isin(*TALL_USES)), low)
        .when(s < 3.0, F.greatest(F.lit(1.2), (2.8 + (s - 2.0) * 0.2) * f))
        .when(s <= 8.0, mid(s))
        .when(s <= 9.0, F.lit(floor))
        .when((ref > 9.0) & (s <= ref), floor + F.pow((s - 9.0) / F.when(ref > 9.0, ref - 9.0), F.lit(0.85)) * (regular - floor))
        .when(peak <= ref + 1e-9, F.lit(regular))
        .otherwise(regular + F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - ref) / F.when(peak > ref, peak - ref))), F.lit(1.25)) * (top - regular)),
        F.lit(top),
    )
    return dims.withColumn(out, tier).drop("_s", "_low")


def rendered_heights(dims: DataFrame, ceiling_mm: float = 30.0, map_scale: float | None = None, area: str = "footprint_area_m2") -> DataFrame:
    """Total, bottom and eave heights in millimetres of each building or part. The dimensions are stored once; one row of references is broadcast."""
    dims = staged(dims, "dimensions")
    both = dims.crossJoin(F.broadcast(tier_references(dims)))
    both = tiered_height(both, F.col(area), ceiling_mm, map_scale, out="_tier")
    capped = F.when(F.col("height_source").isin("height", "levels"), F.col("_tier")).otherwise(F.least("_tier", preset(F.col("building_class"), 4)))
    both = both.withColumn("_full", capped).drop("_tier")
    share = lambda h: F.col("_full") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), h / F.greatest(F.col("total_height_m"), F.lit(1e-9))))
    both = both.withColumn("total_mm", share(F.col("total_height_m")))
    body = F.least(F.lit(0.6), F.col("total_mm"))
    both = both.withColumn("bottom_mm", F.least(F.when(F.col("min_height_m") > 0, share(F.col("min_height_m"))).otherwise(0.0), F.greatest(F.lit(0.0), F.col("total_mm") - body)))
    both = both.withColumn("eave_mm", F.least(F.col("total_mm"), F.greatest(F.col("bottom_mm") + body, share(F.col("eave_height_m")))))
    return both.drop("_full", "high_ref", "top_ref")


def embed_depth(bottom: Column, embed: float = 0.2) -> Column:
    return F.when(bottom <= 1e-9, F.lit(embed)).otherwise(F.least(F.lit(embed), bottom))


def adaptive_heights(table: DataFrame, height: str, scale: float, ceiling: float, least: float) -> DataFrame:
    """Linear heights; if the tallest passes the ceiling, what lies above the 95th percentile is squeezed. Adds ``visible_mm``."""
    clip = lambda c: F.greatest(F.lit(least), F.least(F.lit(ceiling), c))
    h = F.col(height)
    if scale <= 0:
        return table.withColumn("visible_mm", clip(h))
    (p95,) = percentiles(table, height, [0.95])
    stats = table.agg(F.max(height).alias("_max"), F.lit(p95).cast("double").alias("_knee"))
    both = table.crossJoin(F.broadcast(stats))
    knee, peak = F.col("_knee"), F.col("_max")
    mark = F.least(knee * scale, F.lit(ceiling * 0.8))
    lower = F.when(knee > 0, mark / F.when(knee > 0, knee)).otherwise(F.lit(scale))
    bent = F.when(h <= knee, h * lower).otherwise(mark + (h - knee) / F.when(peak > knee, peak - knee) * (ceiling - mark))
    out = F.when(peak * scale <= ceiling, h * scale).when(knee >= peak, h * scale * (ceiling / (peak * scale))).otherwise(bent)
    return both.withColumn("visible_mm", clip(out)).drop("_max", "_knee")


def height_distribution(rendered: DataFrame, ceiling_mm: float = 30.0) -> DataFrame:
    """One row: counts by source, percentiles of real and printed heights, and how much of the ceiling is used."""
    rendered = staged(rendered.select("height_source", "total_height_m", "total_mm"), "rendered")
    real, out = (F.array(*(F.lit(p).cast("double") for p in percentiles(rendered, c, [0.5, 0.9, 0.99]))) for c in ("total_height_m", "total_mm"))
    at = lambda share: F.coalesce(F.avg((F.col("total_mm") >= ceiling_mm * share).cast("double")), F.lit(0.0))
    counted = [F.count_if(F.col("height_source") == s).alias(f"n_{s}") for s in ("class", "fallback", "height", "levels")]
    wide = rendered.agg(F.count("*").alias("n"), *counted, F.max("total_height_m").alias("real_max"), F.max("total_mm").alias("mm_max"), *(at(x / 100).alias(f"at_least_{x}") for x in (50, 75, 90)))
    wide = wide.withColumn("r", real).withColumn("p", out)
    return wide.select("n", *(f"n_{s}" for s in ("class", "fallback", "height", "levels")), *(F.col("r")[i].alias(f"real_p{x}") for i, x in enumerate((50, 90, 99))), "real_max", *(F.col("p")[i].alias(f"mm_p{x}") for i, x in enumerate((50, 90, 99))), "mm_max", "at_least_50", "at_least_75", "at_least_90")


def landmark_ids(registry: DataFrame) -> DataFrame:
    """One row for each stable identifier of a registry of ``key, wikidata array, osm array<struct<type,id>>``."""
    wiki = registry.select("key", F.explode("wikidata").alias("id")).select("key", F.concat(F.lit("wikidata/"), F.col("id")).alias("ident"))
    osm = registry.select("key", F.explode("osm").alias("e")).select("key", F.concat(F.col("e.type"), F.lit("/"), F.col("e.id").cast("string")).alias("ident"))
    return wiki.unionByName(osm)


def duplicate_identifiers(ids: DataFrame) -> DataFrame:
    """Identifiers that several landmarks claim."""
    return ids.groupBy("ident").agg(F.count_distinct("key").alias("n")).where("n > 1")


def match_landmarks(features: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    """The landmark of each feature by Wikidata or element id; none if there is none or if ids disagree (``strict``: error).

    The registry is a dimension table; joins are left to the optimiser's size check.
    """
    wiki = F.transform(F.filter(F.transform(F.split(F.coalesce(F.try_element_at("tags", F.lit("wikidata")), F.lit("")), ";"), F.trim), lambda w: w.rlike("^Q[1-9][0-9]*$")), lambda w: F.concat(F.lit("wikidata/"), w))
    element = F.when(F.col("osm_type").isNotNull() & F.col("osm_id").isNotNull(), F.array(F.concat(F.col("osm_type"), F.lit("/"), F.col("osm_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    asked = features.select("feature_id", F.explode(F.array_distinct(F.concat(wiki, element))).alias("ident"))
    found = asked.join(landmark_ids(registry), "ident").groupBy("feature_id").agg(F.min("key").alias("landmark"), F.count_distinct("key").alias("_n"))
    clash = F.raise_error(F.lit("identifiers resolve to different landmarks")).cast("string") if strict else F.lit(None).cast("string")
    return features.join(found, "feature_id", "left").withColumn("landmark", F.when(F.col("_n") > 1, clash).otherwise(F.col("landmark"))).drop("_n")


def corrected_tags(features: DataFrame, registry: DataFrame) -> DataFrame:
    """Tags with the corrections of a feature's landmark put in; needs ``landmark`` of :func:`match_landmarks`."""
    fixes = registry.select(F.col("key").alias("landmark"), F.col("tag_corrections").alias("_fix"))
    both = features.join(fixes, "landmark", "left")
    kept = F.map_filter(F.col("tags"), lambda k, v: ~F.coalesce(F.map_contains_key("_fix", k), F.lit(False)))
    return both.withColumn("tags", F.when(F.col("_fix").isNull(), F.col("tags")).otherwise(F.map_concat(kept, "_fix"))).drop("_fix")


def supported_parts(parts: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Parts with a path of overlapping, high enough supports to the ground.

    ``parts``: ``part_id, min_height_m, total_height_m``; ``overlaps``: ``a, b`` pairs whose footprints share
    area. Parts that carry each other fall together first; rounds then follow the one-way links.
    """
    carries = overlaps.unionByName(overlaps.select(F.col("b").alias("a"), F.col("a").alias("b")))
    top = parts.select(F.col("part_id").alias("a"), F.col("total_height_m").alias("top"))
    foot = parts.select(F.col("part_id").alias("b"), F.col("min_height_m").alias("foot"))
    carries = carries.join(top, "a").join(foot, "b").where("top >= foot - 0.5").select("a", "b")
    return reachable(carries, parts.where("min_height_m <= 1e-9").select(F.col("part_id").alias("node"))).select(F.col("node").alias("part_id"))


def footprint_ground(footprints: DataFrame, sample, rings: str = "rings", key: str = "feature_id", out: str = "ground_mm") -> DataFrame:
    """Lowest terrain at a footprint's corners, centroid and an inner point; ``sample`` adds ``sample`` to points ``x, y``."""
    own = F.col(rings)
    at = F.concat(F.flatten(own), F.array(centroid(own), point_inside(own)))
    points = footprints.select(key, F.explode(at).alias("p")).where("p.x IS NOT NULL").select(key, "p.x", "p.y")
    return sample(points).groupBy(key).agg(F.min("sample").alias(out))

"""The whole map as one plan: frame, terrain, water, route, roads, buildings, audit and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buildings, frames, mesh, overlay, profile, raster, spatial, tags, water
from ..sources.settings import merged
from ..sources.stage import staged


def draped_body(body: DataFrame, pairs: DataFrame, sample, width: float, visible: float, longest: float, distance: float, slope: float, key: str = "route_id") -> DataFrame:
    """Triangles of a line's body, made finer and set on the ground along the line, thickness kept."""
    kind = dict(pairs.dtypes)[key]
    vertices, faces = mesh.refine(*mesh.indexed(body, key), longest)
    own = vertices.select(F.col("layer").cast(kind).alias(key), "vid", "x", "y", "z")
    stations = spatial.near_stations(own, pairs, width, key)
    lifted = profile.drape_route(own.select(key, "vid", "z"), stations, pairs, sample, width, visible, distance, slope, key)
    vertices = staged(vertices.drop("z").join(lifted.select(F.col(key).cast("string").alias("layer"), "vid", "z"), ["layer", "vid"]), "draped")
    return mesh.corners(vertices, faces).select(F.col("layer").cast(kind).alias(key), "fid", "a", "b", "c", *(f"{p}{k}" for p in "abc" for k in "xyz"))


def road_bodies(roads: DataFrame, route: DataFrame, sample, cfg: dict, route_width: float, key: str = "feature_id") -> DataFrame:
    """Triangles of roads ``key, width_mm, points`` less the route's corridor, set on graded ground.

    Tops follow the road's smoothed profile, taken across the widest road's width, and undersides the ground itself.
    """
    kind, height, embed = dict(roads.dtypes)[key], float(cfg["road_height"]), float(cfg["feature_embed_depth"])
    points = roads.select(key, F.posexplode("points").alias("seq", "p")).select(key, "seq", F.col("p.x").alias("x_mm"), F.col("p.y").alias("y_mm"))
    pairs = staged(spatial.segments(points, key).join(roads.select(key, "width_mm"), key), "roads")
    wide = pairs.agg(F.max("width_mm")).first()[0] or 1.0
    flat = overlay.remainders(overlay.corridors(pairs, F.col("width_mm"), key, flat=False), overlay.corridors(route, route_width), 16.0, key, 16.0)
    levels = roads.select(key, F.lit(-embed).alias("bottom"), F.lit(height).alias("top"))
    body = overlay.region_prisms(flat, levels, key)
    vertices, faces = mesh.refine(*mesh.indexed(body, key), cfg["road_terrain_max_edge_mm"], cfg["road_terrain_refinement_passes"], partial=True)
    # Numbers of vertices are a body's own; together with the road they tell all vertices apart.
    own = staged(sample(vertices.select("layer", F.col("layer").cast(kind).alias(key), F.col("vid").alias("_no"), F.concat_ws("/", "layer", "vid").alias("vid"), "x", "y", F.col("z").alias("_z"))), "corners")
    stations = spatial.near_stations(own, pairs, wide, key).select("vid", key, "station")
    tops = profile.drape_roads(own.select("vid", (F.col("sample") + height).alias("z")), stations, pairs, sample, height, cfg["road_terrain_min_visible_height_mm"], cfg["road_terrain_smoothing_radius_mm"], wide, key)
    share, low = (F.col("_z") + embed) / (height + embed), F.col("sample") - embed
    placed = own.join(tops, "vid").select("layer", F.col("_no").alias("vid"), "x", "y", (low + share * (F.col("z") - low)).alias("z"))
    return mesh.corners(staged(placed, "draped"), faces).select(F.col("layer").cast(kind).alias(key), "fid", "a", "b", "c", *(f"{p}{k}" for p in "abc" for k in "xyz"))


def plan_map(points: DataFrame, elevation: DataFrame | None = None, roads: DataFrame | None = None, houses: DataFrame | None = None, waters: DataFrame | None = None, overrides: dict | None = None, shape: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """Tables of a map of one route.

    ``points``: ``route_id, seq, lat, lon``; ``elevation``: cells ``grid_id, row, col, elev`` already on the
    plate (row 0 north; missing: flat ground, with a warning); ``roads`` and ``houses``: features with ``tags``;
    roads may have ``feature_id`` and ``points`` (``x, y`` on the plate) and then get bodies on the ground, less the route's corridor;
    houses may have ``feature_id`` and ``rings`` on the plate and then get bodies and roofs, as ``waters`` (``water_id, rings``)
    get bodies at their levels with the terrain lowered beneath them. Tables that several others read are stored once.
    """
    cfg = merged(overrides)
    spark = points.sparkSession
    orient = frames.orientation(points).first()
    size = cfg[orient["orientation"] if orient else "portrait"]
    plate = frames.Plate(size["map_width"], size["map_height"], cfg["margin"]).for_border(cfg["flat_border_enabled"])
    out: dict[str, DataFrame] = {"frame": frames.fit_frames(points, plate), "route": frames.frame_points(points, plate)}
    warnings = []
    spec = raster.grid_for_print(plate.width, plate.height, shape, cfg["terrain_target_cell_size_mm"], cfg["terrain_grid_max_samples"], cfg["terrain_grid_max_dimension"])
    x, y = F.col("col") * (plate.width / (spec.columns - 1)), F.lit(plate.height) - F.col("row") * (plate.height / (spec.rows - 1))
    if elevation is None:
        warnings.append("no elevation source; the terrain is flat")
        grid = spark.range(spec.rows * spec.columns).select(F.lit(0).alias("grid_id"), (F.col("id") / spec.columns).cast("int").alias("row"), (F.col("id") % spec.columns).cast("int").alias("col"), F.lit(0.0).alias("h_mm"))
    else:
        span = out["frame"].select(F.hypot("coverage_width_m", "coverage_height_m")).first()[0]
        grid = raster.normalised_relief(raster.repair_elevation(elevation, "elev"), "elev", span, cfg["terrain_detail_gamma"], cfg["terrain_max_relief_mm"], cfg["terrain_min_relief_mm"])
    out["surface"] = grid.withColumn("x", x).withColumn("y", y)
    ground = lambda p: raster.bilinear(p.withColumn("grid_id", F.lit(0)).withColumn("f_row", (plate.height - F.col("y")) * ((spec.rows - 1) / plate.height)).withColumn("f_col", F.col("x") * ((spec.columns - 1) / plate.width)), out["surface"], "h_mm", spec.rows, spec.columns).drop("grid_id", "f_row", "f_col")
    if waters is not None:
        thick, lap = cfg["water_mesh_thickness_mm"], cfg["water_support_overlap_mm"]
        flat = staged(water.merged_bodies(waters, (plate.margin, plate.margin, plate.width - plate.margin, plate.height - plate.margin)), "water")
        out["water_levels"] = staged(water.water_levels(flat, ground, cfg["water_recess_mm"]), "levels")
        out["water_solids"] = water.water_solids(flat, out["water_levels"], thick)
        wet = spatial.points_in_boxes(out["surface"].select("row", "col", "x", "y"), water.triangle_boxes(flat), 8.0, closed=True)
        level = mesh.triangle_height(wet).where("height IS NOT NULL").join(out["water_levels"], "layer").groupBy("row", "col").agg(F.max("level_mm").alias("_level"))
        out["surface"] = staged(out["surface"].join(level, ["row", "col"], "left").withColumn("h_mm", F.coalesce(F.col("_level") - thick + lap, "h_mm")).drop("_level"), "surface")
    out["mesh_vertices"], out["mesh_faces"] = mesh.terrain_solid(out["surface"], spec.rows, spec.columns, cfg["base_thickness"], "base")
    sample = ground
    pairs = spatial.segments(out["route"])
    height = frames.route_height(cfg["style_profile"], cfg["route_height"])
    stations = pairs.select("route_id", "station")
    support = profile.smoothed_support(stations, pairs, cfg["route_width"], cfg["route_terrain_smoothing_distance_mm"], sample)
    need = support.withColumn("height", F.greatest("smooth", "local") + height)
    slope = spark.range(1).select(frames.route_slope(F.lit(cfg["route_layer_height_mm"]))).first()[0]
    out["route_profile"] = profile.slope_limited(need, slope)
    levels = out["frame"].select("route_id", F.lit(-float(cfg["feature_embed_depth"])).alias("bottom"), F.lit(float(height)).alias("top"))
    body = overlay.region_prisms(overlay.union(overlay.corridors(pairs, cfg["route_width"]), "route_id", 16.0), levels, "route_id")
    out["route_body"] = draped_body(body, pairs, ground, cfg["route_width"], float(height), cfg["route_mesh_max_edge_mm"], cfg["route_terrain_smoothing_distance_mm"], slope)
    out["markers"] = frames.markers(out["route"], cfg["route_markers"], cfg["route_marker_diameter_mm"])
    if roads is not None:
        out["roads"] = tags.printable_roads(roads, cfg["style_profile"], tuple(cfg["excluded_road_service_types"]), tuple(cfg["excluded_road_access"]))
        if {"feature_id", "points"} <= set(roads.columns):
            out["road_bodies"] = road_bodies(staged(out["roads"].select("feature_id", "width_mm", "points"), "printed"), pairs, ground, cfg, cfg["route_width"])
    if houses is not None:
        dims = buildings.dimensions(houses, cfg["building_default_height_m"], cfg["building_levels_to_m"], cfg["building_max_real_height_m"])
        out["buildings"] = buildings.rendered_heights(dims, cfg["max_print_height_mm"])
        out["height_distribution"] = buildings.height_distribution(out["buildings"], cfg["max_print_height_mm"])
    if houses is not None and "rings" in houses.columns:
        solid = out["buildings"].join(buildings.footprint_ground(houses, ground), "feature_id")
        lift = lambda c: F.col(c) + F.col("ground_mm")
        solid = solid.select("feature_id", "rings", "roof_shape", "roof_orientation", (lift("bottom_mm") - buildings.embed_depth(F.col("bottom_mm"), cfg["feature_embed_depth"])).alias("bottom"), lift("eave_mm").alias("top"), lift("eave_mm").alias("eave_mm"), (F.col("total_mm") - F.col("eave_mm")).alias("roof_mm"))
        out["building_bodies"] = overlay.prisms(solid, key="feature_id")
        out["building_roofs"] = overlay.roofs(solid, overlap=0.05, key="feature_id")
    out["issues"] = mesh.audit(out["mesh_vertices"], out["mesh_faces"])
    out["mesh_stats"] = mesh.mesh_stats(out["mesh_vertices"], out["mesh_faces"])
    out["warnings"] = spark.createDataFrame([(w,) for w in warnings[-4:]], "warning string")
    return out

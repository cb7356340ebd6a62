"""Known values of single operators and numpy cross-checks of the iterative ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoloom.functions import geo
from cartoloom.operators import buildings, frames, mesh, overlay, profile, quantiles, raster, spatial, tags, water


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def tag_map(d):
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize("text,want", [("238.4 m", 238.4), ("100ft", 30.48), ("100 FT", 30.48), ("x", None), ("-3", None), ("0", None), ("nan", None), ("", None)])
def test_number(spark, text, want):
    got = one(spark, tags.number_m(F.lit(text)))[0]
    assert got == pytest.approx(want) if want is not None else got is None


@pytest.mark.parametrize(
    "given,want",
    [({"height": "238.4 m"}, 238.4), ({"height": "100ft"}, 30.48), ({"height": "not_a_number"}, 6.0), ({"height": "500", "building:levels": "10"}, 30.0), ({"roof:levels": "2"}, 12.0), ({"building": "apartments"}, 12.0), ({"building": "garage"}, 3.0)],
)
def test_real_height(spark, given, want):
    assert one(spark, buildings.real_height(tag_map(given)))[0] == pytest.approx(want)


@pytest.mark.parametrize(
    "given,want",
    [({"building": "apartments", "amenity": "parking"}, "parking"), ({"building": "cathedral", "landmark": "yes"}, "landmark"), ({"office": "Government;Company"}, "commercial_office"), ({"map:class": "Arena", "building": "church"}, "stadium_arena"), ({"map:class": "zoo;Retail"}, "retail"), ({"heatmap:class": "stadium", "building": "church"}, "religious"), ({"shop": "no", "building": "house"}, "residential"), ({"tourism": "attraction", "wikidata": "Q1"}, "landmark"), ({}, "unknown")],
)
def test_classes(spark, given, want):
    assert one(spark, tags.classify(tag_map(given)))[0] == want


def test_class_key_is_exact_and_chosen(spark):
    own = tag_map({"own:class": "parking", "map:class": "retail"})
    assert one(spark, tags.classify(own, "own:class"))[0] == "parking"


def test_missing_tag_values_do_not_hide_others(spark):
    f = spark.createDataFrame([({"shop": None, "building": "church"},), ({"shop": None},), (None,)], "tags map<string,string>")
    assert [r[0] for r in f.select(tags.classify(F.col("tags"))).collect()] == ["religious", "unknown", "unknown"]


def dims(spark, rows):
    names = "feature_id string, building_class string, height_source string, building_type string, levels double, min_height_m double, total_height_m double, eave_height_m double, footprint_area_m2 double"
    return spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], names)


def test_tiers(spark):
    rows = [("parking", "class", "garage", None, 0.0, 12.0, 12.0, 30.0), ("residential", "class", "house", None, 0.0, 6.0, 6.0, 120.0), ("residential", "class", "house", None, 0.0, 6.0, 6.0, 240.0), ("residential", "levels", "yes", 3.0, 0.0, 9.0, 9.0, 500.0), ("residential", "levels", "yes", 8.0, 0.0, 24.0, 24.0, 500.0), ("residential", "levels", "yes", 9.0, 0.0, 27.0, 27.0, 500.0)]
    got = {r["feature_id"]: r["total_mm"] for r in buildings.rendered_heights(dims(spark, rows), 24.8).collect()}
    assert [round(got[str(k)], 6) for k in range(6)] == [1.2, 1.6, 2.0, 3.0, 9.0, 9.0]


def test_uniform_towers(spark):
    got = buildings.rendered_heights(dims(spark, [("commercial_office", "levels", "office", 20.0, 0.0, 72.0, 72.0, 900.0)] * 40), 24.8).select("total_mm").distinct().collect()
    assert [round(r[0], 9) for r in got] == [round(24.8 * 0.58, 9)]


def test_supported_parts(spark):
    parts = spark.createDataFrame([(1, 0.0, 10.0), (2, 9.0, 20.0), (3, 20.2, 30.0), (4, 15.0, 18.0)], "part_id long, min_height_m double, total_height_m double")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "a long, b long")
    spark.sparkContext.setCheckpointDir("/tmp/cartoloom-test-checkpoints")
    assert {r[0] for r in buildings.supported_parts(parts, pairs).collect()} == {1, 2, 3}


def test_landmark_clash(spark):
    reg = spark.createDataFrame([("a", ["Q1"], []), ("b", ["Q2"], [("way", 5)])], "key string, wikidata array<string>, osm array<struct<type: string, id: long>>")
    f = spark.createDataFrame([("1", {"wikidata": "Q1"}, None, None), ("2", {"wikidata": "Q1"}, "way", 5), ("3", {}, "way", 5), ("4", {}, None, None)], "feature_id string, tags map<string,string>, osm_type string, osm_id long")
    assert dict(buildings.match_landmarks(f, reg).select("feature_id", "landmark").collect()) == {"1": "a", "2": None, "3": "b", "4": None}
    with pytest.raises(Exception, match="different landmarks"):
        buildings.match_landmarks(f, reg, strict=True).collect()


def test_frame_round_trip(spark):
    plate = frames.Plate(190.0, 240.0, 5.0, 27.0)
    frame = {"center_lat": F.lit(36.25), "center_lon": F.lit(-121.75), "coverage_width_m": F.lit(20000.0), "coverage_height_m": F.lit(30000.0)}
    lat, lon = frames.from_print(F.lit(33.0), F.lit(201.5), frame, plate)
    x, y = geo.project(lat, lon, frame["center_lat"], frame["center_lon"])
    assert one(spark, *frames.to_print(x, y, frame["coverage_width_m"], frame["coverage_height_m"], plate)) == pytest.approx((33.0, 201.5))
    turned = frames.Plate(100.0, 100.0, 0.0, 90.0)
    assert one(spark, *frames.to_print(F.lit(10.0), F.lit(0.0), F.lit(100.0), F.lit(100.0), turned)) == pytest.approx((50.0, 40.0))
    with pytest.raises(ValueError):
        frames.Plate(10.0, 10.0, 5.0)


def test_horizon_is_an_error(spark):
    with pytest.raises(Exception, match="horizon"):
        spark.range(1).select(*geo.unproject(F.lit(7e6), F.lit(0.0), F.lit(0.0), F.lit(0.0))).collect()


def test_grid_spec():
    spec = raster.grid_for_print(240, 190)
    assert (spec.rows, spec.columns) == (347, 438) and spec.faces < 1_000_000
    assert raster.grid_for_print(10, 10, 5).rows == 5
    with pytest.raises(ValueError):
        raster.grid_for_print(10, 10, True)


@pytest.mark.parametrize("grid,span,rating,relief", [([[10, 10.5], [11, 11.5]], 10_000.0, 5, 3.0), ([[0, 400], [800, 1200]], 2_000.0, 0, 1.5)])
def test_terrain_analysis(spark, grid, span, rating, relief):
    cells = spark.createDataFrame([(0, r, c, float(v)) for r, row in enumerate(grid) for c, v in enumerate(row)], "grid_id int, row int, col int, elev double")
    got = raster.terrain_analysis(cells, "elev", span).first()
    assert got["rating"] == rating and got["target_relief_mm"] == pytest.approx(relief, abs=0.03)


def test_labels_equal_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.45
        own, seen = raster.label(m), {}
        for start in map(tuple, np.argwhere(m)):
            if start in seen:
                continue
            stack, k = [start], start[0] * m.shape[1] + start[1]
            seen[start] = k
            while stack:
                r, c = stack.pop()
                for p in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and m[p] and p not in seen:
                        seen[p] = k
                        stack.append(p)
        assert all(own[p] == k for p, k in seen.items()) and (own[~m] == -1).all()


def test_cleanup_rules():
    m = np.zeros((9, 30), bool)
    m[1, 1] = True  # isolated
    m[4, 2:27] = True  # thin and long
    out = raster.cleanup(m, np.zeros_like(m), raster.CLEANUP["balanced"], 0.1, 0.1)
    assert not out[1, 1] and out[4, 2:27].all()
    ring = np.ones((5, 5), bool)
    ring[2, 2] = ring[1, 1] = False
    wet = np.zeros_like(ring)
    wet[1, 1] = True
    assert raster.cleanup(ring, wet, raster.CLEANUP["balanced"], 0.5, 0.5)[2, 2] and not raster.cleanup(ring, wet, raster.CLEANUP["balanced"], 0.5, 0.5)[1, 1]


def test_coastal_distance_columns(spark):
    cells = spark.createDataFrame([(0, r, c, c == 4 and r == 2) for r in range(5) for c in range(9)], "grid_id int, row int, col int, wet boolean")
    got = {(r["row"], r["col"]) for r in raster.coastal_distance(cells, "wet", 100.0, 250.0, 210.0).where("coastal").collect()}
    assert got == {(2, c) for c in range(2, 7)}


def test_land_restored(spark):
    h = np.random.default_rng(2).random((40, 40)) + 1
    h[:24] = 0.5
    rows = [(g, r, c, float(h[r, c]), r < 20 if g == 0 else r * c == 1) for g in (0, 1) for r in range(40) for c in range(40)]
    cells = spark.createDataFrame(rows, "grid_id int, row int, col int, h_mm double, water boolean")
    out = {(r["grid_id"], r["row"], r["col"]): r["h_mm"] for r in raster.restore_land(cells).collect()}
    assert all(out[0, r, c] > 0.9 for r in range(20, 24) for c in range(40)) and all(out[0, r, c] == 0.5 for r in range(20) for c in range(40))
    assert all(out[1, r, c] == h[r, c] for r in range(40) for c in range(40))


def test_bilinear_keeps_repeated_points_and_null_neighbours(spark):
    cells = spark.createDataFrame([(0, r, c, 10.0) for r in range(3) for c in range(3) if (r, c) != (2, 2)], "grid_id int, row int, col int, v double")
    points = spark.createDataFrame([(0, 0.5, 0.5), (0, 0.5, 0.5), (0, 9.0, 0.0), (0, 1.5, 1.5), (0, -1.0, 2.0)], "grid_id int, f_row double, f_col double")
    got = [r["sample"] for r in raster.bilinear(points, cells, "v", 3, 3).orderBy("f_row", "f_col").collect()]
    assert got == [10.0, 10.0, 10.0, None, 10.0]


def test_coastal_distance_equals_shortest_paths(spark):
    rng = np.random.default_rng(5)
    wet = rng.random((9, 14)) < 0.06
    cells = spark.createDataFrame([(0, r, c, bool(wet[r, c])) for r in range(9) for c in range(14)], "grid_id int, row int, col int, wet boolean")
    for cx, cy, limit in ((100.0, 250.0, 610.0), (70.0, 40.0, 155.0), (30.0, 30.0, 0.0)):
        got = {(r["row"], r["col"]) for r in raster.coastal_distance(cells, "wet", cx, cy, limit).where("coastal").collect()}
        far = lambda dr, dc: min(dr, dc) * math.hypot(cx, cy) + (dr - min(dr, dc)) * cy + (dc - min(dr, dc)) * cx  # noqa: B023, E731
        assert got == {(r, c) for r in range(9) for c in range(14) if any(far(abs(r - a), abs(c - b)) <= limit for a, b in np.argwhere(wet))}


def test_percentiles_equal_the_aggregate(spark):
    rng = np.random.default_rng(6)
    for values in (rng.normal(size=500).tolist(), [3.0] * 7, [1.0], [1e9, *rng.random(300).tolist()], [float(k % 5) for k in range(99)]):
        t = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double").unionByName(spark.createDataFrame([(None,)], "v double"))
        assert quantiles.percentiles(t, "v", [0.0, 0.05, 0.5, 0.93, 1.0], bins=16) == pytest.approx(np.quantile(values, [0.0, 0.05, 0.5, 0.93, 1.0]).tolist())
    assert quantiles.percentiles(t.limit(0), "v", [0.5]) == [None]


def test_slope_limit_equals_two_passes(spark):
    rng = np.random.default_rng(3)
    s, h = np.sort(rng.integers(0, 40, 60)).astype(float), rng.random(60) * 10
    want = h.copy()
    for k in range(1, 60):
        want[k] = max(want[k], want[k - 1] - 0.3 * (s[k] - s[k - 1]))
    for k in range(58, -1, -1):
        want[k] = max(want[k], want[k + 1] - 0.3 * (s[k + 1] - s[k]))
    t = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(s, h, strict=True))], "route_id int, k int, station double, height double")
    got = [r["limited"] for r in profile.slope_limited(t, 0.3).orderBy("k").collect()]
    assert np.allclose(got, want)


def test_flat_ground_drapes_level(spark):
    pts = spark.createDataFrame([("r", k, float(10 * k), 0.0) for k in range(4)], "route_id string, seq int, x_mm double, y_mm double")
    pairs = spatial.segments(pts)
    flat = lambda p: p.withColumn("sample", F.lit(2.0))
    v = spark.createDataFrame([("r", k, float(z)) for k, z in enumerate([0.0, 1.0, 1.0])], "route_id string, vid int, z double")
    st = spark.createDataFrame([("r", k, 7.0 * k) for k in range(3)], "route_id string, vid int, station double")
    got = {r["vid"]: r["z"] for r in profile.drape_route(v, st, pairs, flat, 1.2, 1.0).collect()}
    assert got == pytest.approx({0: 2.0, 1: 3.0, 2: 3.0})


def test_cross_sections_are_normal(spark):
    pts = spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, 10.0, 0.0)], "route_id string, seq int, x_mm double, y_mm double")
    st = spark.createDataFrame([("r", 4.0)], "route_id string, station double")
    got = [(r["x"], r["y"]) for r in profile.cross_sections(st, spatial.segments(pts), 2.0).orderBy("offset_no").collect()]
    assert np.allclose(got, [(4, y) for y in (-1, -0.5, 0, 0.5, 1)])


def test_membership_has_flat_ends(spark):
    pts = spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, 10.0, 0.0), ("r", 2, 10.0, 10.0)], "route_id string, seq int, x_mm double, y_mm double")
    at = spark.createDataFrame([(x, y) for x, y in ((5.0, 0.9), (5.0, 1.1), (-0.5, 0.0), (10.5, -0.5), (10.0, 10.5))], "x double, y double")
    got = {(r["x"], r["y"]) for r in spatial.route_membership(at, spatial.segments(pts), 2.0).collect()}
    assert got == {(5.0, 0.9), (10.5, -0.5)}


def test_support_reaches_the_top_of_long_stacks(spark, monkeypatch):
    spark.sparkContext.setCheckpointDir("/tmp/cartoloom-test-checkpoints")
    parts = spark.createDataFrame([(k, 5.0 * k, 5.0 * k + 5) for k in range(36)], "part_id long, min_height_m double, total_height_m double").coalesce(1)
    pairs = spark.createDataFrame([(k, k + 1) for k in range(35)], "a long, b long").coalesce(1)
    assert {r[0] for r in buildings.supported_parts(parts, pairs).collect()} == set(range(36))
    chain = [("base", 0), *(("top", k) for k in range(1, 68))]
    graph = spark.createDataFrame([(*upper, *lower) for lower, upper in zip(chain, chain[1:], strict=False)], "layer string, component long, s_layer string, s_component long").coalesce(1)
    monkeypatch.setattr(mesh, "supports", lambda *_, **__: graph)
    monkeypatch.setattr(mesh, "shells", lambda _: spark.createDataFrame([*chain, ("top", 99)], "layer string, component long").coalesce(1))
    assert [(r["layer"], r["component"]) for r in mesh.floating_shells(None, None).collect()] == [("top", 99)]


def test_polygon_holes_and_borders(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    p = spark.createDataFrame([(1, [ring(0.0, 10.0), ring(4.0, 6.0)])], "poly int, rings array<array<struct<x: double, y: double>>>")
    at = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (0.0, 5.0), (4.0, 5.0), (11.0, 1.0)], "x double, y double")
    assert [(r["x"], r["y"]) for r in spatial.points_in_polygons(at, p, 3.0).collect()] == [(1.0, 1.0)]
    assert p.select(spatial.polygon_area(F.col("rings"))).first()[0] == 96.0


def test_base_plate_is_sound_and_floaters_are_found(spark):
    spark.sparkContext.setCheckpointDir("/tmp/cartoloom-test-checkpoints")
    v, f = mesh.base_plate(spark, 10.0, 8.0)
    assert mesh.audit(v, f).count() == 0
    assert mesh.volumes(mesh.corners(v, f)).first()["volume_mm3"] == pytest.approx(160.0)

    def box(layer, z, at):
        lift = v.select(F.lit(layer).alias("layer"), "vid", (F.col("x") / 5 + at).alias("x"), (F.col("y") / 5 + at).alias("y"), (F.col("z") + z).alias("z"))
        return lift, f.withColumn("layer", F.lit(layer))

    low, high = box("low", 1.9, 2.0), box("high", 30.0, 2.0)
    v2, f2 = v.unionByName(low[0]).unionByName(high[0]), f.unionByName(low[1]).unionByName(high[1])
    assert {r["layer"] for r in mesh.floating_shells(v2, f2).collect()} == {"high"}
    assert mesh.drop_small_floaters(v2, f2, "high").where("layer = 'high'").count() == 0
    assert mesh.audit(v2, f2, mesh.floating_shells(v2, f2)).first()["code"] == "floating_components"


def test_open_mesh_is_reported(spark):
    v, f = mesh.base_plate(spark, 10.0, 8.0)
    assert [r["code"] for r in mesh.audit(v, f.where("fid > 0")).collect()] == ["non_manifold"]
    turned = f.withColumn("b", F.when(F.col("fid") == 0, F.col("c")).otherwise(F.col("b"))).withColumn("c", F.when(F.col("fid") == 0, F.lit(2)).otherwise(F.col("c")))
    assert "inconsistent_winding" in {r["code"] for r in mesh.audit(v, turned).collect()}


def refined_plainly(points, faces, longest):
    """Halve edges face by face, with the middles in a dictionary."""
    points, faces = [tuple(p) for p in points], [tuple(f) for f in faces]
    size = lambda p, q: sum((a - b) ** 2 for a, b in zip(points[p], points[q], strict=True)) ** 0.5
    middle = {}
    for f in faces:
        for p, q in zip(f, f[1:] + f[:1], strict=True):
            if size(p, q) > longest and (min(p, q), max(p, q)) not in middle:
                middle[min(p, q), max(p, q)] = len(points)
                points.append(tuple((a + b) / 2 for a, b in zip(points[p], points[q], strict=True)))
    return points, {(min(p, q), max(p, q)) for f in faces for p, q in zip(f, f[1:] + f[:1], strict=True)}, middle


def tetrahedron(spark, layer="t", shift=0.0):
    at = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 4.0, 0.0), (0.0, 0.0, 4.0)]
    v = spark.createDataFrame([(layer, k, x + shift, y, z) for k, (x, y, z) in enumerate(at)], mesh.VERTICES)
    return v, spark.createDataFrame([(layer, k, *f) for k, f in enumerate([(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)])], mesh.FACES)


def test_refinement_keeps_surface_closed(spark):
    (v, f), (v2, f2) = tetrahedron(spark), tetrahedron(spark, "u", 9.0)
    points, faces = mesh.refine(v.unionByName(v2), f.unionByName(f2), 1.5)
    tri = mesh.corners(points, faces)
    assert mesh.edge_defects(faces).where("open_edges + overused_edges + winding_defects > 0").count() == 0
    assert {r["layer"]: round(r["volume_mm3"], 9) for r in mesh.volumes(tri).collect()} == {"t": round(64 / 6, 9), "u": round(64 / 6, 9)}
    size = F.sqrt(sum((F.col(f"a{k}") - F.col(f"b{k}")) ** 2 for k in "xyz"))
    assert tri.agg(F.max(size)).first()[0] <= 1.5 + 1e-9
    assert points.groupBy("layer", "vid").count().where("count > 1").count() == 0 and faces.groupBy("layer", "fid").count().where("count > 1").count() == 0
    # One pass puts in exactly the middles of the edges above the limit, and keeps the others.
    once, cut = mesh.refine(v, f, 4.5, passes=1, partial=True)
    want, _, middle = refined_plainly([r[2:] for r in v.orderBy("vid").collect()], [r[2:] for r in f.orderBy("fid").collect()], 4.5)
    assert sorted(tuple(r[2:]) for r in once.collect()) == sorted(want) and len(middle) == 3
    assert cut.count() == 4 + 3 + 3 and mesh.edge_defects(cut).where("open_edges + overused_edges + winding_defects > 0").count() == 0
    with pytest.raises(ValueError, match="pass limit"):
        mesh.refine(v, f, 0.5, passes=1)


def test_refinement_stays_in_its_region(spark):
    v, f = mesh.base_plate(spark, 16.0, 4.0)
    ring = [[(-1.0, -1.0), (3.0, -1.0), (3.0, 5.0), (-1.0, 5.0)]]
    region = spark.createDataFrame([(ring,)], "rings array<array<struct<x: double, y: double>>>")
    points, faces = mesh.refine(v, f, 1.0, passes=3, partial=True, region=region)
    assert mesh.edge_defects(faces).where("open_edges + overused_edges + winding_defects > 0").count() == 0
    tri = mesh.corners(points, faces)
    left, right = (tri.where(w).count() for w in ("greatest(ax, bx, cx) <= 4", "least(ax, bx, cx) >= 8"))
    assert left > right > 0 and mesh.volumes(tri).first()["volume_mm3"] == pytest.approx(128.0)


def test_common_areas_of_triangles_equal_the_sweep():
    rng = np.random.default_rng(13)
    low, high = rng.random((300, 3, 2)) * 4, rng.random((300, 3, 2)) * 4
    high[:20], low[20:40, 0] = low[:20], high[20:40, 0]
    turn = np.cross(high[:, 1] - high[:, 0], high[:, 2] - high[:, 0])
    high[turn < 0] = high[turn < 0][:, ::-1]
    area, at = mesh.clipped_triangles(low, high)
    for k in range(300):
        want = float(overlay._areas(overlay.slabs([[low[k]], [high[k]]], lambda s: bool(s.all()))).sum())
        assert area[k] == pytest.approx(want, abs=1e-9)
        if want > 1e-9:
            for tri in (low[k], high[k]):
                side = np.cross(np.roll(tri, -1, axis=0) - tri, at[k] - tri)
                assert (side > -1e-9).all() or (side < 1e-9).all()


def test_names_do_not_meet_given_ones(spark):
    given = ["a", "a", "a_2", "a", "b", "a_2", "a_x", "a_02", "a_4", "b"]
    got = mesh.unique_names(spark.createDataFrame(list(enumerate(given)), "n int, name string")).orderBy("n").collect()
    assert [r["unique_name"] for r in got] == ["a", "a_3", "a_2", "a_5", "b", "a_2_2", "a_x", "a_02", "a_4", "b_2"]
    assert got[0].asDict().keys() == {"n", "name", "unique_name"}


def test_fans_on_overused_edges_are_parted():
    tetra = lambda p, q, r, s: [[p, r, q], [p, q, s], [q, r, s], [r, p, s]]
    faces = np.array([*tetra(0, 1, 2, 3), *tetra(0, 1, 4, 5)])
    out, copies = mesh.split_fans(faces, 6)
    assert sorted(copies.tolist()) == [0, 1] and overlay.watertight(out) and not overlay.watertight(faces)
    assert mesh.split_fans(np.array([[0, 1, 2], [0, 3, 4]]), 5)[1].tolist() == []


def square(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)


def body_volume(body):
    p, f = body
    return float(np.einsum("ij,ij->i", p[f[:, 0]], np.cross(p[f[:, 1]], p[f[:, 2]])).sum() / 6)


def test_sweep_of_all_slabs_equals_one_by_one():
    rng = np.random.default_rng(21)
    for _ in range(12):
        polygons = [[rng.random((rng.integers(3, 9), 2)) * 10 for _ in range(rng.integers(1, 3))] for _ in range(7)]
        role = np.array([0, 0, 0, 0, 1, 1, 1])
        plain = overlay.slabs(polygons, lambda s: bool(s[role == 0].any() and not s[role == 1].any()))
        for most in (50, 1 << 20):
            got = overlay.swept(polygons, role, lambda a, b: (a > 0) & (b <= 0), most)
            assert overlay._areas(got).sum() == pytest.approx(overlay._areas(plain).sum()) and len(got) == len(plain)


def test_parts_of_a_polygon_fill_it():
    rng = np.random.default_rng(3)
    area = lambda rings: abs(sum(float(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1))) / 2 for r in rings))
    for _ in range(30):
        angle = np.sort(rng.random(17)) * 2 * np.pi
        ring = np.stack([np.cos(angle), np.sin(angle)], 1) * (4 + 9 * rng.random((17, 1))) + rng.normal(size=2) * 5
        hole = (ring - ring.mean(axis=0)) * 0.2 + ring.mean(axis=0)
        parts = list(overlay.parted([ring, hole[::-1]], 2.5))
        assert sum(area(p) for _, _, p in parts) == pytest.approx(area([ring, hole[::-1]])) and len({p[:2] for p in parts}) == len(parts) > 4
        for column, row, own in parts:
            at = np.concatenate(own) - np.array([column, row]) * 2.5
            assert at.min() >= -1e-9 and at.max() <= 2.5 + 1e-9


def test_tiles_give_the_union_of_the_whole(spark):
    rng = np.random.default_rng(12)
    walk = np.cumsum(rng.normal(size=(60, 2)) * 2.0, axis=0) + 20
    points = spark.createDataFrame([("r", k, float(x), float(y)) for k, (x, y) in enumerate(walk)], "route_id string, seq int, x_mm double, y_mm double")
    flat = overlay.corridors(spatial.segments(points), 1.2)
    polygons = [overlay.as_rings(r["rings"]) for r in flat.collect()]
    want = float(overlay._areas(overlay.slabs(polygons, lambda s: bool(s.any()))).sum())
    levels = spark.createDataFrame([("r", 0.0, 2.0)], "route_id string, bottom double, top double")
    for tile in (3.0, 7.0):
        traps = overlay.union(flat, "route_id", tile)
        assert overlay.region_areas(traps, "route_id").first()["area"] == pytest.approx(want, abs=1e-7)
        body = overlay.region_prisms(traps, levels, "route_id").withColumn("layer", F.col("route_id"))
        assert mesh.edge_defects(body.select("layer", "fid", "a", "b", "c")).where("open_edges + overused_edges + winding_defects > 0").count() == 0
        assert mesh.volumes(body).first()["volume_mm3"] == pytest.approx(2 * want, abs=1e-6)


def test_overlays_equal_cell_counts():
    rng = np.random.default_rng(7)
    for _ in range(25):
        boxes = [[square(*rng.integers(1, 8, 4))] for _ in range(5)]
        grid = np.zeros((5, 20, 20), bool)
        for k, (ring,) in enumerate(boxes):
            (x0, y0), (x1, y1) = ring[0].astype(int), ring[2].astype(int)
            grid[k, x0:x1, y0:y1] = True
        for rule, cells in ((lambda s: s.any(), grid.any(0)), (lambda s: s[0] and not s[1:].any(), grid[0] & ~grid[1:].any(0)), (lambda s: s[0] and s[1], grid[0] & grid[1])):
            body = overlay.prism(boxes, rule, 0.0, 2.0)
            assert not len(body[1]) and not cells.any() or overlay.watertight(body[1]) and body_volume(body) == pytest.approx(2 * cells.sum())


def test_slanted_shapes_with_holes_become_closed_bodies():
    star = np.array([(math.cos(k) * r, math.sin(k) * r) for k, r in zip(np.arange(0, 2 * math.pi, math.pi / 5), [5, 2] * 5, strict=False)])
    hole = star[::-1] * 0.3
    body = overlay.prism([[star, hole]], lambda s: s[0], 1.0, 2.5)
    area = abs(overlay._ring_area(star)) * (1 - 0.09)
    assert overlay.watertight(body[1]) and body_volume(body) == pytest.approx(1.5 * area)
    for shape in ("gabled", "hipped", "pyramidal", "skillion"):
        roof = overlay.roof_solid([star, hole], shape, 3.0, 2.0, "across")
        assert overlay.watertight(roof[1]) and body_volume(roof) > 0 and roof[0][:, 2].max() <= 5.0 + 1e-9 and roof[0][:, 2].min() >= 3.0 - 1e-9


def test_concave_pyramids_keep_an_apex_inside():
    shape = np.array([(0, 0), (10, 0), (10, 10), (8, 10), (8, 1.5), (0, 1.5)], float)
    roof = overlay.roof_over([shape], "pyramidal")
    held = overlay.slabs([[shape], [square(roof.centre[0] - 1e-3, roof.centre[1] - 1e-3, 2e-3, 2e-3)]], lambda s: s[0] and s[1])
    assert overlay._areas(held).sum() == pytest.approx(4e-6)


@pytest.mark.parametrize("style,bodies", [("none", 3), ("asymmetric", 5), ("retractable", 7), ("closed", 4)])
def test_stadium_bodies_are_closed_and_stand_on_each_other(style, bodies):
    made = overlay.stadium_bodies(square(5, 5, 60, 40), overlay.StadiumRecipe(roof_style=style, roof_orientation_degrees=20.0))
    assert len(made) == bodies and all(overlay.watertight(f) and body_volume((p, f)) > 0 for p, f in made)
    assert min(p[:, 2].min() for p, _ in made) == 0
    if style == "none":
        assert sum(map(body_volume, made)) == pytest.approx(sum(4 * k / 3 * ((60 - 16 + 16 / 3 * k) * (40 - 16 + 16 / 3 * k) - (60 - 16 + 16 / 3 * (k - 1)) * (40 - 16 + 16 / 3 * (k - 1))) for k in (1, 2, 3)))


def test_unfit_stadiums_are_told(spark):
    ring = lambda w, h: [[(0.0, 0.0), (w, 0.0), (w, h), (0.0, h)]]
    t = spark.createDataFrame([(1, ring(60.0, 40.0)), (2, ring(3.0, 2.0)), (3, []), (4, ring(60.0, 40.0) + [[(0.2, 0.2), (59.0, 0.2), (59.0, 39.0), (0.2, 39.0)]])], "layer int, rings array<array<struct<x: double, y: double>>>")
    made = {r["layer"] for r in overlay.stadiums(t).select("layer").distinct().collect()}
    told = {r["layer"]: r["problem"] for r in overlay.unfit_stadiums(t).collect()}
    assert made == {1} and set(told) == {2, 3, 4} and "opening" in told[4] and "ring" in told[3]


def test_stadium_recipes():
    assert overlay.recipe_of({"type": "procedural_recipe", "recipe": "stadium_closed_roof", "parameters": {"tier_count": "2", "roof_height_mm": 9}}) == overlay.StadiumRecipe(roof_style="closed", tier_count=2, roof_height_mm=9.0)
    assert overlay.recipe_of({"type": "procedural_recipe", "recipe": "x"}) is None and overlay.recipe_of(None) is None
    assert len(overlay.StadiumRecipe(minimum_feature_mm=0.5, tier_count=0, roof_style="closed", closed_roof_band_count=9).problems()) == 3
    with pytest.raises(ValueError, match="every side"):
        overlay.stadium_bodies(square(0, 0, 20, 20), overlay.StadiumRecipe(), square(0.2, 0.2, 19, 19))


def test_ocean_is_right_of_the_coast(spark):
    cells = spark.createDataFrame([(0, r, c) for r in range(10) for c in range(12)], "grid_id int, row int, col int")
    for lines, want in (([(5.5, 0.0, 5.5, 10.0)], range(6, 12)), ([(5.5, 10.0, 5.5, 0.0)], range(5)), ([(3.0, 3.0, 5.0, 5.0)], [])):
        coast = spark.createDataFrame([(0, *x) for x in lines], "grid_id int, x0 double, y0 double, x1 double, y1 double")
        got = {(r["row"], r["col"]) for r in water.ocean(cells, coast, 1.0, 1.0, 10, 12).where("ocean").collect()}
        assert got == {(r, c) for r in range(10) for c in want}


def test_water_bodies_merge_and_get_levels(spark):
    ring = lambda x, y, w, h: [[tuple(p) for p in square(x, y, w, h).tolist()]]
    ponds = spark.createDataFrame([(1, ring(0, 0, 10, 10)), (2, ring(8, 2, 10, 4)), (3, ring(16, 5, 3, 3)), (4, ring(40, 40, 5, 5)), (5, [])], "water_id long, rings array<array<struct<x: double, y: double>>>")
    flat = water.merged_bodies(ponds, (-5.0, -5.0, 60.0, 60.0))
    assert {r["layer"]: round(r["area_mm2"], 6) for r in mesh.projected_area(flat).collect()} == {"1/0": 100 + 32 + 9 - 2, "4/0": 25.0}
    levels = water.water_levels(flat, lambda p: p.withColumn("sample", F.col("x") / 10), recess=0.1, least=-9.0)
    assert {r["layer"]: round(r["level_mm"], 6) for r in levels.collect()} == {"1/0": -0.1, "4/0": 3.9}
    solids = water.water_solids(flat, levels, 0.5)
    assert {r["layer"]: round(r["volume_mm3"], 6) for r in mesh.volumes(solids).collect()} == {"1/0": 69.5, "4/0": 12.5}
    assert mesh.edge_defects(solids.select("layer", "fid", "a", "b", "c")).where("open_edges + overused_edges + winding_defects > 0").count() == 0


def test_cover_signature(spark):
    areas = spark.createDataFrame([("vegetation", 1000.0), ("exposed", 200.0), ("water", 500.0)], "layer string, area_mm2 double")
    got = mesh.cover_signature(areas, 100.0, 50.0).first()
    assert (got["vegetation_fraction"], got["exposed_fraction"], got["water_fraction"]) == pytest.approx((0.2, 0.04, 0.1))


def test_evidence_overlap_scores_120(spark):
    c = spark.createDataFrame([(2, 2, False, False, True, False, True, True), (9, 2, False, False, True, False, True, True), (9, 2, False, True, False, False, False, False), (2, 2, True, True, False, False, False, False)], "wc int, io int, water boolean, osm boolean, cliff boolean, vegetation boolean, coastal boolean, connected boolean")
    c = c.withColumn("cliff", F.lit(False)).withColumn("k", F.monotonically_increasing_id())
    got = raster.evidence(c).orderBy("k").collect()
    assert got[0]["score"] == 120 and got[0]["class"] == 2
    assert got[1]["class"] == 9 and got[2]["class"] == 2 and got[3]["class"] == 8


def test_tile_of_exact_edge(spark):
    names = spark.range(1).select(F.explode(geo.tiles(F.lit(-3.0), F.lit(-3.0), F.lit(0.0), F.lit(3.0))).alias("t")).select("t.*").collect()
    assert [(r["lat"], r["lon"]) for r in names] == [(a, b) for a in (-3, 0) for b in (-3, 0)]
    assert math.isclose(one(spark, geo.terrarium(F.lit(128.0), F.lit(0.0), F.lit(0.0)))[0], 0.0)

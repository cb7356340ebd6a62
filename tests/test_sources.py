import json
import zipfile

import pytest

from pyspark.sql import functions as F

from cartoloom.operators import buildings, frames, mesh, raster
from cartoloom.plans.mapmaker import plan_map
from cartoloom.sources import readers, settings, sinks
from cartoloom.streaming import sessions

GPX = '<?xml version="1.0"?><{p}gpx{ns}><{p}trk><{p}trkseg><{p}trkpt lat="29.7" lon="-95.4"><{p}ele>3.5</{p}ele></{p}trkpt><{p}trkpt lat="29.8" lon="-95.3"/></{p}trkseg></{p}trk><{p}trk><{p}trkseg><{p}trkpt lat="29.9" lon="-95.2"><{p}ele>7</{p}ele></{p}trkpt></{p}trkseg></{p}trk></{p}gpx>'


@pytest.mark.parametrize("prefix,ns", [("", ""), ("", ' xmlns="http://www.topografix.com/GPX/1/1"'), ("gpx:", ' xmlns:gpx="http://www.topografix.com/GPX/1/1"'), ("my-1.x:", ' xmlns:my-1.x="urn:other"')])
def test_gpx(spark, tmp_path, prefix, ns):
    (tmp_path / "t.gpx").write_text(GPX.format(p=prefix, ns=ns))
    got = [tuple(r)[1:] for r in readers.read_gpx(spark, str(tmp_path / "t.gpx")).orderBy("seq").collect()]
    assert got == [(0, 29.7, -95.4, 3.5), (1, 29.8, -95.3, None), (2, 29.9, -95.2, 7.0)]


def test_gpx_without_points(spark, tmp_path):
    (tmp_path / "t.gpx").write_text("<gpx></gpx>")
    with pytest.raises(ValueError, match="no track points"):
        readers.read_gpx(spark, str(tmp_path / "t.gpx"))


def test_gpx_of_any_prefix_in_one_pass(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"{k}.gpx").write_text(GPX.format(p=f"ns{k}:", ns=f' xmlns:ns{k}="urn:x"').replace("<?xml version", "\ufeff<?xml version" if k % 50 == 0 else "<?xml version"))
    (tmp_path / "broken.gpx").write_text("<gpx><trk>")
    (tmp_path / "other.gpx").write_text("<kml></kml>")
    got = readers.read_gpx(spark, str(tmp_path / "*.gpx"))
    assert got.count() == 450 and got.select("route_id").distinct().count() == 150
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_3mf_leaves_out_tiny_floating_shells(spark, tmp_path):
    v, f = mesh.base_plate(spark, 20.0, 20.0)
    box = lambda layer, shift, z: (v.selectExpr(f"'{layer}' AS layer", f"vid + {shift} AS vid", "x / 5 + 4 AS x", "y / 5 + 4 AS y", f"z + {z} AS z"), f.selectExpr(f"'{layer}' AS layer", f"fid + {shift} AS fid", f"a + {shift} AS a", f"b + {shift} AS b", f"c + {shift} AS c"))
    stands, floats, road = box("buildings", 0, 1.9), box("buildings", 100, 30.0), box("roads", 0, 50.0)
    points, sides = v.unionByName(stands[0]).unionByName(floats[0]), f.unionByName(stands[1]).unionByName(floats[1])
    sinks.write_3mf(points, sides, str(tmp_path / "m.3mf"))
    with zipfile.ZipFile(tmp_path / "m.3mf") as archive:
        model = archive.read("3D/3dmodel.model").decode()
    assert model.count("<triangle ") == 24 and model.count("<vertex ") == 16
    with pytest.raises(ValueError, match="floating"):
        sinks.write_3mf(points.unionByName(road[0]), sides.unionByName(road[1]), str(tmp_path / "n.3mf"))


def test_geojson_mixes_types(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 0]]
    shapes = [("LineString", [[0, 0], [1, 1]], {"highway": "primary", "name": None}), ("Polygon", [square, [[1, 0.5], [1.2, 0.5], [1.2, 0.6], [1, 0.5]]], {"height": 9, "building:levels": 4}), ("MultiPolygon", [[square], [square]], {"natural": "water"}), ("Point", [3, 4], {})]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": t, "coordinates": c}} for t, c, p in shapes]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    got = readers.read_geojson(spark, str(tmp_path / "f.geojson")).collect()
    assert sorted((r["geom_type"], r["part_id"], len(r["rings"])) for r in got) == [("LineString", 0, 1), ("MultiPolygon", 0, 1), ("MultiPolygon", 1, 1), ("Point", 0, 1), ("Polygon", 0, 2)]
    by = {r["geom_type"]: r for r in got}
    assert by["Polygon"]["tags"] == {"height": "9", "building:levels": "4"} and by["LineString"]["tags"] == {"highway": "primary"}
    assert by["Point"]["rings"][0][0].asDict() == {"x": 3.0, "y": 4.0}


def test_overpass(spark, tmp_path):
    ring = [{"lat": a, "lon": b} for a, b in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0))]
    doc = {"elements": [{"type": "way", "id": 1, "tags": {"building": "yes"}, "geometry": ring}, {"type": "way", "id": 2, "geometry": ring[:2]}, {"type": "node", "id": 3}, {"type": "relation", "id": 4, "members": [{"type": "way", "role": "outer", "geometry": ring}, {"type": "way", "role": "inner", "geometry": ring}]}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    (tmp_path / "e.json").write_text(json.dumps({"elements": []}))
    got = {r["feature_id"]: len(r["rings"]) for r in readers.read_overpass(spark, str(tmp_path / "*.json")).collect()}
    assert got == {"way/1": 1, "relation/4": 2}
    box = lambda at, size: [{"lat": at + a * size, "lon": at + b * size} for a, b in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))]
    two = {"type": "relation", "id": 5, "members": [{"type": "way", "role": r, "geometry": g} for r, g in (("outer", box(0.0, 4.0)), ("outer", box(10.0, 4.0)), ("inner", box(11.0, 1.0)), ("inner", box(50.0, 1.0)))]}
    (tmp_path / "two.json").write_text(json.dumps({"elements": [two]}))
    assert [len(r["rings"]) for r in readers.read_overpass(spark, str(tmp_path / "two.json")).orderBy("part_id").collect()] == [1, 2]


def test_fallbacks(spark):
    notes = []

    def broken():
        raise OSError("down")

    assert readers.first_available([("a", broken), ("b", lambda: spark.range(0)), ("c", lambda: spark.range(2))], notes).count() == 2
    assert notes == ["a: down", "b: no rows"]


def test_settings(spark, tmp_path):
    assert settings.merged({"portrait": {"map_width": 1.0}})["portrait"] == {"map_width": 1.0, "map_height": 240.0}
    assert settings.palette("urban", overrides={"route": "#abcdef12"})["route"] == "#ABCDEF"
    with pytest.raises(ValueError):
        settings.palette("urban", overrides={"route": "red"})
    mark = {"schema_version": 1, "registry_version": "x", "landmarks": [{"key": "a", "identifiers": {"wikidata": ["Q1"], "osm": {"way": [4]}}}]}
    assert settings.registry(mark) == [{"key": "a", "display_name": "a", "aliases": [], "wikidata": ["Q1"], "osm": [("way", 4)], "tag_corrections": {}, "enhancement": None}]
    rich = dict(mark["landmarks"][0], aliases=["A"], display_name="Arena", tag_corrections={"building": "stadium"}, enhancement={"type": "procedural_recipe", "recipe": "stadium_closed_roof", "parameters": {"tier_count": 2}})
    table = settings.registry_table(spark, dict(mark, landmarks=[rich]))
    assert table.first()["enhancement"]["parameters"] == {"tier_count": "2"}
    f = spark.createDataFrame([("a", {"building": "yes", "name": "x"}), (None, {"building": "yes"})], "landmark string, tags map<string,string>")
    assert [r["tags"] for r in buildings.corrected_tags(f, table).orderBy(F.col("landmark").desc_nulls_last()).collect()] == [{"name": "x", "building": "stadium"}, {"building": "yes"}]
    for wrong in ({"identifiers": {}}, {"aliases": "A"}, {"tag_corrections": {"building": None}}, {"enhancement": {"type": "x"}}, {"display_name": " "}):
        with pytest.raises(ValueError):
            settings.registry(dict(mark, landmarks=[{**rich, **wrong}]))
    mark["landmarks"].append({"key": "b", "identifiers": {"wikidata": ["Q1"]}})
    with pytest.raises(ValueError, match="duplicate"):
        settings.registry(mark)
    settings.save_project(tmp_path / "p.json", {"version": 1, "settings": {"route_height": None}})
    assert settings.load_project(tmp_path / "p.json")["settings"] == {"route_height": 2.0, "route_markers": "none"}


def test_3mf(spark, tmp_path):
    v, f = mesh.base_plate(spark, 10.0, 8.0)
    sinks.write_3mf(v, f, str(tmp_path / "m.3mf"), plate=(20.0, 20.0))
    with zipfile.ZipFile(tmp_path / "m.3mf") as z:
        text = z.read("3D/3dmodel.model").decode()
    assert text.count("<vertex ") == 8 and text.count("<triangle ") == 12 and 'displaycolor="#FFFFFFFF"' in text
    with pytest.raises(ValueError, match="printability"):
        sinks.write_3mf(v, f.where("fid > 0"), str(tmp_path / "bad.3mf"))
    assert not (tmp_path / "bad.3mf").exists()
    assert sinks.report(v, f)["layers"] == {"base": {"vertices": 8, "faces": 12}}


def test_whole_map(spark):
    pts = spark.createDataFrame([("r", k, 29.7 + k / 1000, -95.4 + k / 500) for k in range(5)], "route_id string, seq int, lat double, lon double")
    box = lambda x, y, w, h: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]
    houses = spark.createDataFrame([("h", {"building": "house", "height": "9 m", "roof:shape": "gabled"}, 100.0, box(50.0, 50.0, 4.0, 3.0))], "feature_id string, tags map<string,string>, footprint_area_m2 double, rings array<array<struct<x: double, y: double>>>")
    ponds = spark.createDataFrame([(1, box(80.0, 80.0, 30.0, 30.0)), (2, box(100.0, 90.0, 30.0, 5.0))], "water_id long, rings array<array<struct<x: double, y: double>>>")
    out = plan_map(pts, houses=houses, waters=ponds, shape=(12, 15))
    assert [round(r["level_mm"], 6) for r in out["water_levels"].collect()] == [-0.4]
    for name, key in (("water_solids", "layer"), ("building_bodies", "feature_id"), ("building_roofs", "feature_id"), ("route_body", "route_id")):
        soup = out[name].withColumn("layer", F.col(key))
        assert mesh.edge_defects(soup.select("layer", "fid", "a", "b", "c")).where("open_edges + overused_edges + winding_defects > 0").count() == 0, name
        assert mesh.volumes(soup).first()["volume_mm3"] > 0
    assert mesh.volumes(out["water_solids"]).first()["volume_mm3"] == pytest.approx((900 + 100) * 0.6)
    assert {round(r["h_mm"], 6) for r in out["surface"].collect()} == {0.0, -0.6}
    assert out["issues"].count() == 0 and out["warnings"].count() == 1
    assert {round(r["limited"], 6) for r in out["route_profile"].collect()} == {2.0}
    assert out["buildings"].first()["height_source"] == "height"


def test_road_bodies_leave_the_route_and_follow_the_ground(spark):
    from cartoloom.operators import spatial
    from cartoloom.plans.mapmaker import road_bodies

    roads = spark.createDataFrame([(1, 1.2, [(0.0, 5.0), (6.0, 5.0), (12.0, 7.0)]), (2, 0.8, [(2.0, 0.0), (2.0, 9.0)])], "feature_id long, width_mm double, points array<struct<x: double, y: double>>")
    route = spatial.segments(spark.createDataFrame([("r", 0, 6.0, -2.0), ("r", 1, 6.0, 12.0)], "route_id string, seq int, x_mm double, y_mm double"))
    sample = lambda p: p.withColumn("sample", 0.1 * F.col("x") + 0.05 * F.col("y"))
    cfg = settings.merged(None)
    body = road_bodies(roads, route, sample, cfg, 1.2).withColumn("layer", F.col("feature_id").cast("string"))
    assert mesh.edge_defects(body.select("layer", "fid", "a", "b", "c")).where("open_edges + overused_edges + winding_defects > 0").count() == 0
    assert mesh.volumes(body).where("volume_mm3 > 0").count() == 2
    v, _ = mesh.indexed(body, "layer")
    got = v.withColumn("rise", F.col("z") - 0.1 * F.col("x") - 0.05 * F.col("y")).collect()
    assert min(r["rise"] for r in got) == pytest.approx(-cfg["feature_embed_depth"])
    tops = [r for r in got if r["rise"] > 0.39]
    assert len(tops) > 20 and all(abs(r["x"] - 6.0) >= 0.6 - 1e-6 for r in got)


def test_route_body_stands_on_a_slope(spark):
    shape = (12, 15)
    pts = spark.createDataFrame([("r", k, 29.7 + 0.01 * k, -95.4 + 0.013 * ((k * k) % 5)) for k in range(5)], "route_id string, seq int, lat double, lon double")
    hills = spark.createDataFrame([(0, r, c, 40.0 * r + 25.0 * c + 300.0 * ((r + c) % 3 == 0)) for r in range(shape[0]) for c in range(shape[1])], "grid_id int, row int, col int, elev double")
    cfg = settings.merged(None)
    out = plan_map(pts, elevation=hills, shape=shape)
    body = out["route_body"].withColumn("layer", F.col("route_id"))
    assert mesh.edge_defects(body.select("layer", "fid", "a", "b", "c")).where("open_edges + overused_edges + winding_defects > 0").count() == 0
    assert mesh.volumes(body).first()["volume_mm3"] > 0
    size = frames.Plate(cfg[o := frames.orientation(pts).first()["orientation"]]["map_width"], cfg[o]["map_height"], cfg["margin"]).for_border(cfg["flat_border_enabled"])
    up = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    v, _ = mesh.indexed(body.where(up > 1e-9), "route_id")
    at = v.select("vid", "x", "y", "z", F.lit(0).alias("grid_id"), ((size.height - F.col("y")) * (shape[0] - 1) / size.height).alias("f_row"), (F.col("x") * (shape[1] - 1) / size.width).alias("f_col"))
    met = raster.bilinear(at, out["surface"], "h_mm", *shape).select(F.col("z").alias("top"), F.col("sample").alias("ground")).collect()
    visible = frames.route_height(cfg["style_profile"], cfg["route_height"])
    assert len(met) > 50 and max(r["ground"] for r in met) > 1.0
    assert min(r["top"] - r["ground"] for r in met) > 0.98 * visible


def test_sessions_stream_like_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = {tuple(r) for r in sessions.tumbling_counts(events).select("start", "event_type", "n").collect()}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select start, event_type, n from counts").collect()} == batch
    assert sessions.user_sessions(events).agg({"n": "sum"}).first()[0] == events.count()

"""Work that grows with the input: copies stand as one, small shapes are settled at once, sizes are not taken for smaller than they are."""

import math

from cartoloom.operators import mesh, outlines, spatial, water


def _box(x, y, w, h):
    return [[dict(x=float(p), y=float(q)) for p, q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]


def test_copies_of_ponds_add_no_pairs(spark, monkeypatch):
    asked = []
    found = water.box_overlaps
    monkeypatch.setattr(water, "box_overlaps", lambda boxes, *a, **k: asked.append(boxes.count()) or found(boxes, *a, **k))
    kinds = ((0, 0, 4, 4), (3, 0, 4, 4), (20, 20, 2, 2), (30, 30, 0, 5))
    rows = [(n * 4 + k, _box(*kind)) for n in range(50) for k, kind in enumerate(kinds)] + [(1000, None)]
    ponds = spark.createDataFrame(rows, "water_id int, rings array<array<struct<x: double, y: double>>>")
    got = {r.water_id: r.cluster for r in water.clusters(ponds, 8.0).collect()}
    # Boxes without area and missing ones overlap nothing, not even their copies.
    assert got == {k: (0, 0, 2, k)[k % 4] for k, _ in rows[:-1]} | {1000: 1000}
    assert asked == [3]
    area = mesh.projected_area(water.merged_bodies(ponds.where("water_id % 4 < 3 AND water_id < 1000"), (-5.0, -5.0, 60.0, 60.0))).collect()
    assert sorted(round(r.area_mm2, 9) for r in area) == [4.0, 28.0]


def _lines(spark):
    rows = [(k, i, float(i * 37 % 190), float(i * i * 53 % 240)) for k in range(3) for i in range(40)]
    return spark.createDataFrame(rows, "route_id int, seq int, x_mm double, y_mm double")


def test_nearest_places_are_found_without_sorting_pairs(spark):
    lines = _lines(spark)
    points = lines.selectExpr("route_id", "seq AS point_id", "y_mm / 2 AS x", "x_mm AS y").unionByName(spark.createDataFrame([(0, 99, None, 1.0), (1, 98, float(190 * 0), 0.0), (2, 97, 0.0, 0.0)], "route_id int, point_id int, x double, y double"))
    pairs = spatial.segments(lines)
    found = spatial.project_to_lines(points, pairs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "HashAggregate" in x and "min(HYPOT" in x] and not [x for x in plan.splitlines() if "SortAggregate" in x and "HYPOT" in x]
    own = {}
    for r in pairs.collect():
        own.setdefault(r.route_id, []).append(r)
    got = {(r.route_id, r.point_id): (r.distance, r.station) for r in found.collect()}
    asked = points.collect()
    assert set(got) == {(r.route_id, r.point_id) for r in asked} and got[0, 99][0] is None
    for p in asked:
        if p.x is None:
            continue
        best = None
        for s in sorted(own[p.route_id], key=lambda s: s.seq):
            dx, dy = s.x1 - s.x0, s.y1 - s.y0
            t = max(0.0, min(1.0, ((p.x - s.x0) * dx + (p.y - s.y0) * dy) / (dx * dx + dy * dy))) if s.length else 0.0
            gap = math.hypot(p.x - s.x0 - t * dx, p.y - s.y0 - t * dy)
            if best is None or gap < best[0] - 1e-12:
                best = gap, s.station + t * s.length
        assert abs(got[p.route_id, p.point_id][0] - best[0]) < 1e-9 and abs(got[p.route_id, p.point_id][1] - best[1]) < 1e-6


def test_short_lines_take_no_rounds_and_long_ones_end_alike(spark, monkeypatch):
    made = []
    kept = outlines.staged
    monkeypatch.setattr(outlines, "staged", lambda df, label: made.append(label) or kept(df, label))
    points = _lines(spark).selectExpr("route_id AS line_id", "seq", "x_mm AS x", "CASE WHEN route_id = 1 AND seq % 7 = 3 THEN NULL ELSE y_mm END AS y")
    rows = lambda table: sorted(tuple(r) for r in table.select("line_id", "seq").collect())
    short = rows(outlines.simplified(points, 50.0))
    assert len(made) <= 2 and 20 < len(short) < 100
    assert rows(outlines.simplified(points, 50.0, most=5)) == short and rows(outlines.simplified(points, 50.0, most=0)) == short
    flat = spark.range(50).selectExpr("0 AS line_id", "id AS seq", "cast(id AS double) AS x", "0e0 AS y")
    assert rows(outlines.simplified(flat, 1.0, most=4)) == [(0, 0), (0, 49)]
    assert rows(outlines.simplified(flat.where("seq = 7"), 1.0)) == [(0, 7)]


def test_small_grids_are_traced_at_once_and_large_ones_alike(spark, monkeypatch):
    made = []
    kept = outlines.staged
    monkeypatch.setattr(outlines, "staged", lambda df, label: made.append(label) or kept(df, label))
    cells = spark.range(3 * 400).selectExpr("cast(id / 400 AS int) AS grid_id", "cast(id % 400 / 20 AS int) AS row", "cast(id % 20 AS int) AS col", "xxhash64(id) % 5 > -1 AND id < 800 AS m")
    rows = lambda table: sorted(tuple(r) for r in table.collect())
    small = outlines.ring_points(cells, "m")
    assert not made
    large = outlines.ring_points(cells, "m", tile=8)
    assert made and small.dtypes == large.dtypes and rows(small) == rows(large) and small.count() > 200
    assert rows(outlines.ring_points(cells.where("grid_id = 2"), "m")) == []


def test_vertices_of_arrays_are_never_broadcast(spark):
    shells = spark.range(4).selectExpr("id AS p")
    vertices = shells.selectExpr("'low' AS layer", "inline(transform(sequence(0, 3), k -> struct(p * 4 + k AS vid, cast(k AS double) AS x, 0e0 AS y, 1e0 AS z)))")
    faces = shells.selectExpr("'low' AS layer", "p AS fid", "p * 4 AS a", "p * 4 + 1 AS b", "p * 4 + 2 AS c")
    whole = mesh.corners(vertices, faces)
    assert "Broadcast" not in whole._jdf.queryExecution().executedPlan().toString() and whole.count() == 4

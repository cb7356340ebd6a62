"""Equal shapes are compared once, and long lines meet only the cells along them."""

import pytest

from cartoloom.operators import spatial


@pytest.fixture
def seen(monkeypatch):
    """Numbers of places and boxes that each comparison gets."""
    sizes, held = [], spatial._held
    monkeypatch.setattr(spatial, "_held", lambda places, boxes, *how: sizes.append((places.count(), boxes.count())) or held(places, boxes, *how))
    return sizes


def points(spark, copies):
    return spark.createDataFrame([(k * 3 + n, 0.5 + 2 * n, 0.5) for k in range(copies) for n in range(3)], "point_id long, x double, y double")


def boxes(spark, copies):
    return spark.createDataFrame([(k * 2 + n, 3.0 * n, 0.0, 3.0 * n + 3, 1.0, float(k)) for k in range(copies) for n in range(2)], "box_id long, min_x double, min_y double, max_x double, max_y double, level_mm double")


def test_copies_of_places_and_boxes_are_compared_once(spark, seen):
    found = {(r.point_id, r.box_id) for r in spatial.points_in_boxes(points(spark, 4), boxes(spark, 5), 2.0).collect()}
    assert found == {(k * 3 + n, j * 2 + n // 2) for k in range(4) for n in range(3) for j in range(5)}
    last = spatial.last_wins(points(spark, 4), boxes(spark, 5), "point_id", "level_mm", "box_id", 2.0).collect()
    assert {r.point_id: r.level_mm for r in last} == dict.fromkeys(range(12), 4.0)
    assert seen == [(3, 2), (3, 2)]


def test_copies_of_polygons_are_compared_once(spark, seen):
    ring = "array(array(struct(min_x AS x, min_y AS y), struct(max_x AS x, min_y AS y), struct(max_x AS x, max_y AS y), struct(min_x AS x, max_y AS y)))"
    found = spatial.points_in_polygons(points(spark, 4), boxes(spark, 5).selectExpr("box_id", f"{ring} AS rings"), 2.0)
    assert found.count() == 4 * 5 * 3 and found.columns == ["point_id", "x", "y", "box_id"]
    assert seen == [(3, 2)]


def test_overlaps_of_copies_are_written_from_lists(spark):
    own = boxes(spark, 7).selectExpr("box_id", "min_x - box_id % 2 AS min_x", "min_y", "max_x", "max_y")
    at = {r.box_id: r for r in own.collect()}
    want = {(a, b): min(at[a].max_x, at[b].max_x) - max(at[a].min_x, at[b].min_x) for a in at for b in at if a < b}
    for block in (1, 3, 1024):
        got = spatial.box_overlaps(own, 2.0, block=block).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.area for r in got} == want


def test_lines_meet_cells_along_them_only(spark):
    pairs = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 90.0), (1, 2, 100.0, 90.0, 100.0, -50.0), (2, 1, 5.0, 7.0, 5.0, 7.0)], "route_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    assert spatial._line_bins(pairs.where("route_id = 1 AND seq = 1"), 0.5, 2.0).count() < 200  # its box has 2,392
    cells = spark.createDataFrame([(k * 2 + c, k % 101 * 1.0, k // 101 * 1.0 - 50) for k in range(101 * 141) for c in range(2)], "vid long, x double, y double")
    got = {(r.vid, r.route_id) for r in spatial.route_membership(cells, pairs, 1.0, cell=2.0).collect()}
    want, lines = set(), pairs.collect()
    for r in cells.collect():
        for p in lines:
            dx, dy = p.x1 - p.x0, p.y1 - p.y0
            raw = ((r.x - p.x0) * dx + (r.y - p.y0) * dy) / (dx * dx + dy * dy) if dx or dy else None
            t = min(1.0, max(0.0, raw or 0.0))
            beyond = raw is not None and ((raw < 0 and p.seq == 1) or (raw > 1 and p.seq == (2 if p.route_id == 1 else 1)))
            if ((r.x - p.x0 - t * dx) ** 2 + (r.y - p.y0 - t * dy) ** 2) ** 0.5 <= 0.5 and not beyond:
                want.add((r.vid, p.route_id))
    assert got == want
    assert {r.vid for r in spatial.line_cells(cells, pairs, 1.0, cell=2.0).collect()} == {v for v, _ in want}


def test_lines_that_meet_places_are_not_shuffled(spark, monkeypatch):
    pairs = spark.createDataFrame([(k, n, 10.0 * n, 0.0, 10.0 * n + 10, 0.3) for k in range(3) for n in range(4)], "route_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(c, c % 50 * 1.0, c % 7 * 0.25) for c in range(700)], "vid long, x double, y double")
    ask = lambda cells: spatial.route_membership(cells, pairs, 1.0, cell=2.0)
    plan = ask(cells)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    dealt = ask(cells)._jdf.queryExecution().executedPlan().toString()
    assert not [r for r in dealt.splitlines() if "Exchange hashpartitioning" in r and "route_id" in r and "x#" in r]
    found = sorted(ask(cells).collect())
    want = set()
    for r in cells.collect():
        for n in range(4):
            raw = ((r.x - 10 * n) * 10 + r.y * 0.3) / 100.09
            t = min(1.0, max(0.0, raw))
            if ((r.x - 10 * n - 10 * t) ** 2 + (r.y - 0.3 * t) ** 2) ** 0.5 <= 0.5 and not (raw < 0 and n == 0) and not (raw > 1 and n == 3):
                want |= {(r.vid, k) for k in range(3)}
    assert len(found) == len(want) and {(r.vid, r.route_id) for r in found} == want
    only = sorted(ask(cells.select("x", "y")).collect())
    assert only == sorted({(r.x, r.y, r.route_id) for r in found})
    for most in ("FEW_PLACES", "FEW_CELLS"):
        monkeypatch.setattr(spatial, most, 0)
        assert sorted(ask(cells).collect()) == found


def test_overlaps_that_are_found_are_not_shuffled(spark):
    plan = spatial.box_overlaps(boxes(spark, 3), 2.0)._jdf.queryExecution().executedPlan().toString()
    dealt = [r for r in plan.splitlines() if "Exchange hashpartitioning" in r and ("a_min_x" in r or "b_min_x" in r)]
    assert not dealt and plan.count("Exchange hashpartitioning(_cx") == 2
    twice = boxes(spark, 3).unionByName(boxes(spark, 3).selectExpr("box_id", "min_x + 1 AS min_x", "min_y", "max_x", "max_y", "level_mm"))
    ours = sorted(spatial.box_overlaps(twice, 2.0, block=2).collect())
    rows = twice.collect()
    area = lambda p, q: max(0.0, min(p.max_x, q.max_x) - max(p.min_x, q.min_x)) * max(0.0, min(p.max_y, q.max_y) - max(p.min_y, q.min_y))
    assert ours == sorted((p.box_id, q.box_id, area(p, q)) for p in rows for q in rows if p.box_id < q.box_id and area(p, q) > 1e-8)

"""Equal shapes are made once in a worker; groups that come in pieces are whole; free numbers of names."""

import random

from cartoloom.operators import mesh, offsets, overlay


def test_equal_shapes_are_made_once_within_bounds(monkeypatch):
    monkeypatch.setattr(overlay, "KEPT_BYTES", 32_000)
    overlay._kept.clear()
    overlay._kept_size[0] = 0
    made = []
    make = lambda k: overlay.once(k, 8, lambda: made.append(k) or k, lambda _: 1000)
    assert [make(k) for k in (1, 2, 1, 1, 2)] == [1, 2, 1, 1, 2] and made == [1, 2]
    for k in range(100):
        make(k)
    assert overlay._kept_size[0] <= 32_000 and make(1) == 1 and made[-1] == 1
    overlay._kept.clear()
    overlay._kept_size[0] = 0


def test_groups_in_small_batches_are_whole(spark):
    box = lambda k, x: (k, [[dict(x=x, y=0.0), dict(x=x + 1.5, y=0.0), dict(x=x + 1.5, y=1.0), dict(x=x, y=1.0)]])
    rows = [box(k, float(n)) for k in range(30) for n in range(k % 7 + 1)]
    random.Random(5).shuffle(rows)
    table = spark.createDataFrame(rows, "k int, rings array<array<struct<x: double, y: double>>>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.k: round(r.area, 9) for r in overlay.region_areas(overlay.union(table, "k", 2.0), "k").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: k % 7 + 1.5 for k in range(30)}


def test_corners_get_discs_on_their_outer_side_only(spark):
    ell = [[dict(x=float(x), y=float(y)) for x, y in ((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))]]
    flat = overlay.union(spark.createDataFrame([(1, ell)], "k int, rings array<array<struct<x: double, y: double>>>"), "k")
    turns = [r.turn for r in offsets.borders(flat, "k").collect()]
    assert turns.count(1.0) == 5 and turns.count(-1.0) == 1
    area = lambda t: overlay.region_areas(t, "k").first().area
    assert abs(area(offsets.grown(flat, 0.2, "k")) - (7 + 16 * 0.2 - 0.04 + 5 * 0.04 * 0.7804)) < 1e-3
    assert abs(area(offsets.shrunk(flat, 0.2, "k")) - (3.6 * 0.6 * 2 - 0.36 + 0.04 - 0.04 * 0.7804)) < 0.05


def test_names_pass_over_given_numbers(spark):
    draw = random.Random(3)
    pool = ["a", "b", "a_2", "a_3", "a_5", "b_3", "a_2_2", "b_1", "c_07"]
    names = [(k, draw.choice(pool)) for k in range(120)]
    got = {r.n: r.unique_name for r in mesh.unique_names(spark.createDataFrame(names, "n int, name string")).collect()}
    given, seen, want = {name for _, name in names}, {}, {}
    for n, name in names:
        if name not in seen:
            seen[name], want[n] = 1, name
            continue
        seen[name] += 1
        while f"{name}_{seen[name]}" in given:
            seen[name] += 1
        want[n] = f"{name}_{seen[name]}"
    assert got == want


def test_names_repeated_often_carry_no_list_of_numbers(spark):
    plan = mesh.unique_names(spark.range(10).selectExpr("id AS n", "'x' AS name"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan.lower()

"""Contraction, reachability and tiled labelling against brute force."""

import random

import numpy as np
import pytest

from cartoloom.operators import mesh, raster, water
from cartoloom.operators.components import contract, reachable


def plain(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root}


@pytest.mark.parametrize("small", [0, 1 << 17])
def test_components_with_keys(spark, small):
    rng = random.Random(4)
    rows = [(g, rng.randint(0, 60), rng.randint(0, 60)) for g in range(3) for _ in range(40)] + [(9, 5, 5), (9, None, 4), (0, 1, 2), (0, 1, 2)]
    got = {(r["g"], r["node"]): r["component"] for r in contract(spark.createDataFrame(rows, "g int, u long, v long"), ["g"], small=small).collect()}
    want = {(g, n): c for g in range(3) for n, c in plain([(a, b) for k, a, b in rows if k == g and a != b]).items()}
    assert got == want
    names = spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "y")], "u string, v string")
    assert {tuple(r) for r in contract(names, small=small).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert contract(spark.createDataFrame([], "u long, v long"), small=small).count() == 0


def test_a_long_chain_and_a_star_take_few_rounds(spark):
    chain = [(k, k + 1) for k in range(1000)] + [(5000, k) for k in range(5001, 6000)]
    got = contract(spark.createDataFrame(chain, "u long, v long"), small=0, rounds=19).collect()
    assert {(r["node"], r["component"]) for r in got} == {(k, 0) for k in range(1001)} | {(k, 5000) for k in range(5000, 6000)}


@pytest.mark.parametrize("small", [0, 1 << 17])
def test_reachable_follows_directions(spark, small):
    rng = random.Random(6)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(90)] + [(200, 201), (201, 200), (201, 202)]
    seeds = {0, 1, 2, 200, 999}
    known, grown = set(), set(seeds)
    while grown != known:
        known, grown = grown, grown | {b for a, b in pairs if a in grown}
    got = reachable(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(k,) for k in seeds], "node long"), small=small)
    assert sorted(r["node"] for r in got.collect()) == sorted(known)


@pytest.mark.parametrize("diagonal", [True, False])
def test_tiles_give_the_components_of_the_whole_grid(spark, diagonal):
    rng = np.random.default_rng(2)
    grids = {7: rng.random((150, 130)) < 0.5, 8: np.zeros((90, 140), bool), 9: rng.random((33, 70)) < 0.6}
    grids[8][::2], grids[8][:, -1] = True, True  # a comb: one component through all tiles
    rows = [(g, int(r), int(c), bool(m[r, c])) for g, m in grids.items() for r, c in np.ndindex(*m.shape)]
    cells = spark.createDataFrame(rows, "grid_id int, row int, col int, m boolean")
    got = {(r["grid_id"], r["row"], r["col"]): r["component"] for r in raster.components(cells, "m", diagonal, tile=32).collect()}
    want = {(g, int(r), int(c)): int(own[r, c]) for g, m in grids.items() for own in [raster.label(m, diagonal)] for r, c in np.argwhere(m)}
    assert got == want


def test_a_thousand_ponds_in_a_row(spark):
    ring = lambda k: [[(k * 3.0, 0.0), (k * 3.0 + 4, 0.0), (k * 3.0 + 4, 2.0), (k * 3.0, 2.0)]]
    ponds = spark.createDataFrame([(k, ring(k)) for k in range(1000)] + [(5000, ring(3000))], "water_id long, rings array<array<struct<x: double, y: double>>>")
    got = {r["water_id"]: r["cluster"] for r in water.clusters(ponds, 8.0).collect()}
    assert got == {k: 0 for k in range(1000)} | {5000: 5000}


def test_shells_of_a_layer_in_blocks(spark):
    strip = [("long", k, k, k + 1, k + 2) for k in range(500)] + [("long", 900 + k, 2000 + 3 * k, 2001 + 3 * k, 2002 + 3 * k) for k in range(20)] + [("other", 0, 0, 1, 2)]
    faces = spark.createDataFrame(strip, mesh.FACES)
    got = {(r["layer"], r["fid"]): r["component"] for r in mesh.shells(faces, block=64).collect()}
    assert got == {("long", k): 0 for k in range(500)} | {("long", 900 + k): 2000 + 3 * k for k in range(20)} | {("other", 0): 0}


def test_tables_of_rounds_go(spark):
    from cartoloom.sources import stage

    before = len(stage._made)
    contract(spark.createDataFrame([(k, k + 1) for k in range(64)], "u long, v long"), small=0).count()
    assert len(stage._made) - before <= 3

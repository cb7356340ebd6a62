"""Outlines and simplification against brute force."""

import numpy as np
import pytest

from cartoloom.operators import outlines, raster


def grids():
    rng = np.random.default_rng(8)
    ring = np.ones((9, 9), bool)
    ring[2:7, 2:7] = False
    ring[4, 4] = True
    return {0: rng.random((14, 11)) < 0.5, 1: ring, 2: np.eye(5, dtype=bool), 3: np.zeros((3, 3), bool), 4: np.ones((1, 1), bool), 5: rng.random((20, 20)) < 0.7}


def test_outlines_hold_their_cells(spark):
    rows = [(g, int(r), int(c), bool(m[r, c])) for g, m in grids().items() for r, c in np.ndindex(*m.shape)]
    cells = spark.createDataFrame(rows, "grid_id int, row int, col int, m boolean")
    points = outlines.ring_points(cells, "m")
    drawn = {(r["grid_id"], r["part"]): r["rings"] for r in outlines.polygons(points).collect()}
    areas = outlines.ring_areas(points).collect()
    for g, mask in grids().items():
        parts = raster.label(mask, False)
        for part in np.unique(parts[mask]):
            own = parts == part
            rings = [np.array([(p["x"], p["y"]) for p in ring]) for ring in drawn[g, int(part)]]
            edges = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings])
            assert ((edges[:, 0] == edges[:, 2]) != (edges[:, 1] == edges[:, 3])).all()
            up = edges[edges[:, 0] == edges[:, 2]]
            for r, c in np.ndindex(*mask.shape):  # even-odd at the cell's middle, over upright edges to its right
                crossed = ((up[:, 0] > c + 0.5) & (np.minimum(up[:, 1], up[:, 3]) < r + 0.5) & (np.maximum(up[:, 1], up[:, 3]) > r + 0.5)).sum()
                assert bool(crossed % 2) == bool(own[r, c])
            sizes = sorted((r["area"] for r in areas if r["grid_id"] == g and r["part"] == part), reverse=True)
            assert sum(sizes) == own.sum() and sizes[0] > 0 and all(a < 0 for a in sizes[1:])
    assert sum(r["length"] for r in areas if r["grid_id"] == 1) == 36 + 20 + 4


def thinned(line, tolerance):
    """The usual recursion."""

    def gap(p, a, b):
        d = b - a
        t = 0.0 if not d @ d else min(1.0, max(0.0, float((p - a) @ d) / float(d @ d)))
        return float(np.hypot(*(p - a - t * d)))

    def walk(i, j):
        far = [(gap(line[k], line[i], line[j]), -k) for k in range(i + 1, j)]
        if not far or max(far)[0] <= tolerance:
            return []
        k = -max(far)[1]
        return [*walk(i, k), k, *walk(k, j)]

    return [0, *walk(0, len(line) - 1), len(line) - 1]


def test_simplified_lines_equal_the_recursion(spark):
    rng = np.random.default_rng(4)
    lines = {k: np.cumsum(rng.normal(size=(n, 2)), axis=0) for k, n in enumerate((2, 3, 60, 150))}
    lines[4] = np.concatenate([lines[2], lines[2][:1]])  # closed
    lines[5] = np.zeros((4, 2))
    rows = [(k, i, float(x), float(y)) for k, own in lines.items() for i, (x, y) in enumerate(own)]
    got = outlines.simplified(spark.createDataFrame(rows, "line_id int, seq int, x double, y double"), 0.8).collect()
    assert sorted((r["line_id"], r["seq"]) for r in got) == sorted((k, i) for k, own in lines.items() for i in thinned(own, 0.8))
    assert 20 < len(got) < len(rows) - 40
    with pytest.raises(ValueError, match="tolerance"):
        outlines.simplified(spark.createDataFrame(rows, "line_id int, seq int, x double, y double"), 0.0)

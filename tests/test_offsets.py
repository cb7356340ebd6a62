"""Regions moved outwards and inwards, against areas of circles and rectangles."""

import math

import pytest

from cartoloom.operators import offsets, overlay

SCHEMA = "k int, rings array<array<struct<x: double, y: double>>>"


def box(x, y, w, h):
    return [[(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]]


def areas(traps):
    return {r["k"]: r["area"] for r in overlay.region_areas(traps, "k").collect()}


def test_growing_and_shrinking(spark):
    ring = box(0, 0, 6, 5) + [p[::-1] for p in box(2, 2, 2, 1)]
    t = overlay.union(spark.createDataFrame([(1, box(1, 1, 4, 3)), (2, ring), (3, box(0, 0, 4, 0.4))], SCHEMA), "k", 2.5)
    disc = 16 * 0.25**2 * math.sin(2 * math.pi / 32)
    big = areas(offsets.grown(t, 0.25, "k", 2.5))
    assert big[1] == pytest.approx(12 + 14 * 0.25 + disc) and big[2] == pytest.approx(30 + 22 * 0.25 + disc - 1.5 * 0.5)
    small = areas(offsets.shrunk(t, 0.25, "k", 2.5))
    assert set(small) == {1, 2} and small[1] == pytest.approx(3.5 * 2.5) and small[2] == pytest.approx(5.5 * 4.5 - (2 + 6 * 0.25 + disc))
    assert [r["k"] for r in offsets.narrow(t, 0.5, "k").collect()] == [3] and offsets.narrow(t, 0.39, "k").count() == 0


def test_gaps_are_closed(spark):
    t = overlay.union(spark.createDataFrame([(1, box(0, 0, 4, 3)), (1, box(4.5, 0, 3.5, 3)), (2, box(0, 0, 4, 3)), (2, box(4.7, 0, 3.3, 3))], SCHEMA), "k")
    got = areas(offsets.closed(t, 0.3, "k"))
    h = math.sqrt(0.3**2 - 0.25**2)
    notch = 0.3**2 * math.acos(h / 0.3) - h * 0.25
    assert got[1] == pytest.approx(24 - 2 * notch, abs=4e-3) and got[2] == pytest.approx(21.9, abs=4e-3)

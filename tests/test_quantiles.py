"""Percentiles against numpy, with far-off and infinite values."""

import math

import numpy as np
import pytest

from cartoloom.operators.quantiles import _narrowed, percentiles

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small", [1, 50, 1 << 20])
def test_percentiles_equal_numpy(spark, small):
    rng = np.random.default_rng(6)
    for values in (rng.normal(size=400), np.append(rng.normal(size=400), [1e300, -1e305]), np.repeat([1.0, 2.0, 5.0], 100), np.array([3.0]), np.append(rng.integers(0, 9, 300).astype(float), 1e12)):
        t = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "h double")
        assert percentiles(t, "h", SHARES, bins=16, small=small) == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-12)
    assert percentiles(spark.createDataFrame([], "h double"), "h", SHARES) == [None] * 5


def test_infinite_values_count(spark):
    t = spark.createDataFrame([(x,) for x in [-math.inf, 1.0, 2.0, 3.0, math.inf]], "h double")
    assert percentiles(t, "h", SHARES, small=1) == [-math.inf, 1.0, 2.0, math.inf, math.inf]
    assert percentiles(spark.createDataFrame([(math.inf,)] * 2, "h double"), "h", [0.0, 1.0]) == [math.inf, math.inf]


def test_one_far_value_takes_one_more_pass(spark):
    values = [float(k) for k in range(3000)] + [1e9]
    v = spark.createDataFrame([(x,) for x in values], "v double")
    (span,) = _narrowed(v, [1500], [(0.0, 1e9, 0, 3001)], 64, 60)
    assert span[0] <= 1500 <= span[1] and span[3] <= 60

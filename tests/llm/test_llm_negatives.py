import numpy as np
import pytest

from cartoloom.llm.hard_negatives import Pivots, brackets, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, v int, block int, chunk string, marks int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def rows(count=600, width=12, spread=0.3, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    x = [(centres[k % 8] + spread * rng.normal(size=width)).round(3) for k in range(count)]
    out = [[k, [float(c) for c in own], int(k * 7 // 3 % 5)] for k, own in enumerate(x)]
    for k in range(40, 60):  # ties: the same vector under many ids
        out[k][1] = out[100][1]
    out[200][1], out[300][1] = [0.0] * width, [-c for c in out[301][1]]
    n = len(out)
    odd = [None, [], [0.5], [1.0, None], [float("nan")], [float("inf")], [1e300]]
    out += [[n + k, own, 1] for k, own in enumerate(odd)]
    out += [[n + 20, out[5][1], None], [None, out[5][1], 1], [400, out[7][1], 0], [7, out[7][1], out[7][2]], [7, out[7][1], out[7][2]]]
    out += [[k, [9.0 + k / 1e4] * 2, 77] for k in range(10_000, 10_003)]  # an anchor with two positives
    return [(a, b, c, 1, 2, "x", 3) for a, b, c in out]


def plain(given, every=100, top=5):
    """Every anchor against every row, in Python's whole numbers."""
    own = []
    for vec, x, label, *_ in given:
        if vec is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = [int(np.floor(256 * c)) for c in x]
        if sum(c * c for c in v) < 2**55:
            own.append((vec, label, v))
    anchors = {}
    for vec, label, v in own:
        if vec % every == 0:
            anchors[vec] = min(anchors.get(vec, (label, v)), (label, v))
    out = []
    for vec, (label, v) in anchors.items():
        scored = sorted(((-sum(p * q for p, q in zip(v, x, strict=False)), k, m) for k, m, x in own))
        positives = [(k, -s) for s, k, m in scored if m == label and k != vec][:5]
        for positive, p in positives:
            found = [(k, -s) for s, k, m in scored if m != label and 80 * p <= -100 * s <= 100 * p][:top]
            out += [(vec, positive, r + 1, k, p, s) for r, (k, s) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "block": 40, "asked": 2}, {"pivots": 1, "sample": 1}])
def test_equals_every_pair(spark, options):
    given = rows()
    want = plain(given)
    table = spark.createDataFrame(given, SCHEMA).repartition(3)
    got = hard_negatives(table, **options)
    assert got.columns == COLUMNS
    assert len(want) > 40 and sorted(tuple(r) for r in got.collect()) == want


def test_large_numbers_stay_exact(spark):
    given = [(k, [float(c) * 3e4 for c in x], *rest) for k, x, *rest in rows(400, 16) if x and None not in x and np.isfinite(x).all() and max(map(abs, x)) < 1e5]
    assert max(sum((256 * c) ** 2 for c in r[1]) for r in given) > 2**50
    wide = [(k, [c * 60 for c in x], *rest) for k, x, *rest in given]
    for each in (given, wide):
        assert sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(each, SCHEMA)).collect()) == plain(each)


def test_no_rows_and_no_anchors(spark):
    for given in ([], [(1, [1.0], 1, 1, 1, "", 1)], [(100, [1.0], 1, 1, 1, "", 1)]):
        assert hard_negatives(spark.createDataFrame(given, SCHEMA)).collect() == []


def test_brackets_hold_and_rule_out():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(6, 20))[rng.integers(0, 6, 800)] + 0.1 * rng.normal(size=(800, 20))))
    pivots = Pivots(x[:300], float((x * x).sum(axis=1).max()))
    low, high = brackets(pivots, pivots.from_rows(x), pivots.from_queries(x[:50]), (x[:50] ** 2).sum(axis=1))
    score = x[:50] @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high < np.sort(low, axis=1)[:, -5:-4]).mean() > 0.5

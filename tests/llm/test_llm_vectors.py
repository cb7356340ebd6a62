import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoloom.llm.components import components
from cartoloom.llm.embedding_dedup import Quantised, embedding_groups, int_products, tile_links
from cartoloom.llm.inner_product_search import Block, Codebook, fit_codebook, nearest_by_product, scan, search_block

SCHEMA = "vec_id long, embedding array<float>, label int, v int, tile int, u string"


def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 24))
    x = [centres[k % 6] + rng.normal(size=24) * 0.25 for k in range(240)] + [rng.normal(size=24) for _ in range(60)]
    x += [x[0] * 3, x[0], x[1] + 1e-3]
    out = [(k, [float(np.float32(c)) for c in row], 0, 1, 2, "x") for k, row in enumerate(x)]
    n = len(out)
    odd = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [0.0] * 23]
    return out + [(n + k, v, None, 1, 2, "x") for k, v in enumerate(odd)] + [(None, out[5][1], 0, 1, 2, "x")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


def valid():
    good = [(r[0], r[1]) for r in vectors() if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    return np.array([g[0] for g in good]), np.array([g[1] for g in good])


@pytest.mark.parametrize("tile", [8192, 64])
def test_groups_equal_brute_force(table, tile):
    ids, x = valid()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T) >= 0.95
    root = {i: i for i in ids.tolist()}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a, b in np.argwhere(np.triu(links, 1)):
        p, q = sorted((find(int(ids[a])), find(int(ids[b]))))
        root[q] = p
    count = dict(zip(ids.tolist(), (links.sum(1) - 1).tolist(), strict=True))
    got = embedding_groups(table, tile=tile).collect()
    assert len(got) == len(vectors()) and sum(count.values()) > 20
    for r in got:
        k = r["vec_id"]
        want = (count.get(k, 0), find(k) if k in root else k, k is not None and (k not in root or find(k) == k))
        assert (r["n_links"], r["component_id"], r["kept"]) == want


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    q = Quantised(np.arange(200), rng.normal(size=(200, 32)))
    estimate = (q.codes.astype(float) @ q.codes.astype(float).T) * q.scale[:, None] * q.scale[None, :]
    bound = q.error[:, None] + q.error[None, :] + q.error[:, None] * q.error[None, :]
    assert (np.abs(estimate - q.unit @ q.unit.T) <= bound).all()
    a, b, spans = tile_links(q, q, -1.0, True, side=64)
    assert (a + b == 199).all()


def brute(ids, x, q, top=20):
    """By definition: exact products in double precision, ties to the smaller id."""
    score = (x * x[int(np.flatnonzero(ids == q)[0])]).sum(axis=1)
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:top]
    return [(k + 1, int(ids[j]), float(score[j])) for k, j in enumerate(order)]


@pytest.mark.parametrize("how", [{}, {"block": 50, "chunk": 9, "rerank": 5}])
def test_search_equals_brute_force(table, how):
    ids, x = valid()
    got = {}
    for r in nearest_by_product(table, query_every=10, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [k for k in ids.tolist() if k % 10 == 0]
    for q, rows in got.items():
        assert sorted(rows) == brute(ids, x, q)


def test_identical_vectors_rank_by_id_in_many_blocks(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(400, 30)).astype(np.float32)
    base[rng.permutation(400)[:150]] = base[0]
    rows = [(int(k), [float(v) for v in base[k]]) for k in rng.permutation(400)] + [(20, [float(v) for v in base[7]])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, again = ([tuple(r) for r in nearest_by_product(u, block=64, chunk=5).orderBy("query_id", "rank").collect()] for u in (t, t.repartition(5)))
    assert got == again and {r[0] for r in got} == set(range(0, 400, 20))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q in range(0, 400, 20):
        own = [x[j] for j in np.flatnonzero(ids == q)]
        score = (x * min(own, key=lambda v: v.tolist())).sum(axis=1)
        want = [(q, k + 1, int(ids[j]), float(score[j])) for k, j in enumerate([j for j in np.lexsort((ids, -score)) if ids[j] != q][:20])]
        assert [r for r in got if r[0] == q] == want


def test_products_stay_exact_in_many_dimensions():
    rng = np.random.default_rng(13)
    a, b = rng.integers(-127, 128, (5, 3000)).astype(np.int8), np.full((4, 3000), 127, np.int8)
    a[0] = 127
    assert np.array_equal(int_products(a, b), a.astype(np.int64) @ b.astype(np.int64).T)


def test_repeated_ids_of_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 1, True)] * 3 + [(2, 1, 1, False), (3, 0, 3, True)]


def test_anisotropic_codes_keep_near_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 16))
    q = x[:40]
    exact = x @ q.T
    err = {}
    for parallel in (1.0, 8.0):
        book = fit_codebook(x, parallel=parallel)
        codes = book.encode(x)
        decoded = book.words[np.arange(book.words.shape[0])[None, :], codes].reshape(800, 16)
        err[parallel] = np.mean([abs(decoded[i] @ x[i] - x[i] @ x[i]) for i in range(800)])
        assert np.corrcoef(scan(book, codes, q).astype(float)[:, 0], exact[:, 0])[0, 1] > 0.9
    assert err[8.0] < err[1.0]


@pytest.mark.parametrize("copies", [0.0, 0.02])
def test_search_is_exact_in_a_large_group_of_copies(copies):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x[:1200] = x[0] + copies * rng.normal(size=(1200, 32))
    order = rng.permutation(3000)
    x, ids = np.ascontiguousarray(x[order]), np.arange(3000)
    asked = np.concatenate([np.flatnonzero(order < 1200)[::100], np.flatnonzero(order >= 1200)[::200]])
    book = fit_codebook(x[:1000])
    block = Block.read(Block(book, ids, x, book.encode(x)).stored())
    found = search_block(book, block, ids[asked], x[asked], 20, 256)
    for q, (_, near) in zip(asked, found, strict=True):
        score = (x * x[q]).sum(1)
        want = [int(j) for j in np.lexsort((ids, -score)) if j != q][:20]
        assert near.tolist() == want


def test_table_sums_of_many_subspaces_do_not_wrap():
    words = np.zeros((300, 2, 2))
    words[:, 1] = 1
    codes = np.array([[0] * 300, [1] * 300], np.uint8)
    assert scan(Codebook(words, 4.0), codes, np.ones((1, 600)))[:, 0].tolist() == [0, 300 * 255]


def test_few_vectors_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embedding_groups(none).count() == 0 and nearest_by_product(none).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 0, 0, 0, ""), (1, [0.5], 0, 0, 0, "")], SCHEMA)
    assert [tuple(r) for r in nearest_by_product(two).collect()] == [(0, 1, 1, 0.5)]
    assert {r["component_id"] for r in embedding_groups(two).collect()} == {0}


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    order = rng.permutation(300)
    pairs = [(int(a), int(b)) for a, b in zip(order, order[1:], strict=False)] + [(1000, k) for k in range(1001, 1400)] + [(2000, 2000), (None, 5)]
    got = components(spark.createDataFrame(pairs, "u long, v long").repartition(7))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(k, 0) for k in range(1, 300)} | {(k, 1000) for k in range(1001, 1400)}
    assert got.agg(F.count("*")).first()[0] == 299 + 399

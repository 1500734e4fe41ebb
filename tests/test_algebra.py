import numpy as np
import pytest

from polyad.frame import TensorFrame
from polyad.operators import blocks as bl
from polyad.operators import relational as rel

CASES = [((5, 7), (2, 3)), ((6, 4, 5), (4, 4, 2)), ((3, 4, 5, 2), (2, 3, 5, 1)), ((4, 4, 4), (2, 2, 2)), ((2, 3), (9, 9))]


@pytest.fixture(params=CASES, ids=str)
def tensor(request, spark):
    shape, block = request.param
    x = np.random.default_rng(sum(shape)).integers(-5, 6, shape).astype(float)
    return TensorFrame.from_numpy(spark, x, block), x


def matricized(x, n):
    order = [*range(n, x.ndim), *range(n)]
    return np.transpose(x, order).reshape(x.shape[n], -1, order="F")


def times(x, factors):
    for m, b in factors.items():
        x = np.moveaxis(np.tensordot(x, b, axes=(m, 0)), -1, m)
    return x


def factors_of(x, seed=0):
    rng = np.random.default_rng(seed)
    return {m: rng.integers(-3, 4, (e, r)).astype(float) for m, (e, r) in enumerate(zip(x.shape, (3, 6, 2, 4)))}


def matrix(df, rows, cols, names):
    out = np.zeros((rows, cols))
    for r in df.collect():
        out[r[names[0]], r[names[1]]] += r["v"]
    return out


def test_kernels_unfold_and_refold():
    for shape, _ in CASES:
        x = np.random.default_rng(1).random(shape)
        for n in range(x.ndim):
            m = bl.unfold_local(x, n)
            assert np.array_equal(m, matricized(x, n)) and np.array_equal(bl.refold_local(m, n, shape), x)


def test_cells_and_blocks(tensor):
    t, x = tensor
    assert np.array_equal(t.to_numpy(), x)
    blocks = t.to_blocks()
    assert np.array_equal(blocks.to_cells().to_numpy(), x)
    assert blocks.to_cells(zeros=True).df.count() == x.size == t.zero_filled().df.count()
    for row in blocks.df.collect():
        key = tuple(row[k] for k in blocks.keys)
        part = x[tuple(slice(*t.meta.block_range(m, b)) for m, b in enumerate(key))]
        assert np.array_equal(np.array(row["data"]), part.reshape(-1, order="F"))


def test_unfold_refold_and_norms(tensor):
    t, x = tensor
    for n in range(x.ndim):
        m = matricized(x, n)
        got = rel.unfold(t, n)
        assert np.array_equal(matrix(got, *m.shape, ("row", "col")), m)
        assert np.array_equal(rel.refold(got, n, t.meta).to_numpy(), x)
        vectors = {r["row"]: r["vec"] for r in rel.row_vectors(t, n).collect()}
        assert np.array_equal(np.array([vectors[i] for i in range(len(m))]), m)
    norms = {r["row"]: r["norm"] for r in rel.row_norms(t, 0).collect()}
    assert np.allclose([norms.get(i, 0) for i in range(x.shape[0])], np.linalg.norm(matricized(x, 0), axis=1))
    assert rel.norm_squared(t) == (x * x).sum()
    assert np.array_equal(matrix(rel.slice_row(t, 0, 1), *matricized(x, 0).shape, ("row", "col"))[1], matricized(x, 0)[1])


def test_products(tensor, spark):
    t, x = tensor
    local = factors_of(x)
    expected = times(x, local)
    tables = {m: (rel.factor_table(spark, b), b.shape[1]) for m, b in local.items()}
    assert np.array_equal(rel.mode_n_products(t, tables).to_numpy(), expected)
    assert np.array_equal(rel.mode_n_products(t, tables, order=sorted(tables, reverse=True)).to_numpy(), expected)  # products on different modes commute
    assert np.array_equal(rel.mode_n_products_fused(t, tables).to_numpy(), expected)
    got = bl.mode_n_products(t.to_blocks(), local)
    assert got.meta.shape == expected.shape and np.allclose(got.to_cells().to_numpy(), expected)
    one = bl.mode_n_products(t.to_blocks(), {1: local[1]})
    assert np.allclose(one.to_cells().to_numpy(), times(x, {1: local[1]}))
    assert rel.mode_n_products(t, {}) is t


def test_gram(tensor):
    t, x = tensor
    for n in range(x.ndim):
        m = matricized(x, n)
        assert np.array_equal(matrix(rel.gram(t, n), len(m), len(m), ("r", "c")), m @ m.T)
        assert np.allclose(matrix(bl.gram(t.to_blocks(), n), len(m), len(m), ("r", "c")), m @ m.T)


def test_block_unfold_has_all_values(tensor):
    t, x = tensor
    for n in range(x.ndim):
        got = bl.unfold(t.to_blocks(), n).collect()
        for i in range(x.shape[n]):
            mine = sorted(v for r in got if r["row"] == i for v in r["vec"])
            assert mine == sorted(np.take(x, i, axis=n).reshape(-1).tolist())


def test_matmul_and_projection(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-4, 5, (4, 6)).astype(float), rng.integers(-4, 5, (3, 4)).astype(float)
    ta, tb = rel.factor_table(spark, a), rel.factor_table(spark, b)
    assert np.array_equal(matrix(rel.project_onto(ta, tb), 3, 6, ("i", "r")), b @ a)
    assert np.array_equal(matrix(rel.project_onto(rel.transposed(ta), tb, transpose=True), 3, 6, ("i", "r")), b @ a)


def test_block_filters_and_order(spark):
    x = np.arange(1, 61, dtype=float).reshape(3, 4, 5)
    t = TensorFrame.from_numpy(spark, x, (2, 3, 2)).to_blocks()
    assert t.lookup((1, 0, 2)).count() == 1 and t.lookup((5, 0, 0)).count() == 0
    assert t.stripe(1, 1).count() == 6 and t.edge(2).count() == 4 and t.edge(2, last=False).count() == 8
    got = [tuple(r) for r in t.ordered(1).select(*t.keys).collect()]
    assert got == sorted(got, key=lambda k: (k[1], k[0], k[2]))


def test_large_factor_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(rel, "BROADCAST_CELLS", 3)
    x = np.random.default_rng(0).random((4, 5))
    t = TensorFrame.from_numpy(spark, x)
    b = np.random.default_rng(1).random((4, 2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rel.mode_n_product(t, 0, rel.factor_table(spark, b), 2)
        assert "BroadcastHashJoin" not in got.df._jdf.queryExecution().executedPlan().toString()
        assert np.allclose(got.to_numpy(), b.T @ x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

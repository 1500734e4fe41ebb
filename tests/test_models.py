import numpy as np
import pytest

from polyad.frame import TensorFrame
from polyad.operators import blocks as bl
from polyad.operators import clusters as cl
from polyad.operators import clusterwise as cw
from polyad.operators import kmeans as km
from polyad.operators import relational as rel
from polyad.operators import tucker as tk


def low_rank(shape, ranks, seed=0, noise=0.01):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=ranks)
    for m, (e, r) in enumerate(zip(shape, ranks, strict=True)):
        x = np.moveaxis(np.tensordot(x, np.linalg.qr(rng.normal(size=(e, r)))[0], axes=(m, 1)), -1, m)
    return x + noise * rng.normal(size=shape)


@pytest.mark.parametrize(("shape", "block", "ranks"), [((6, 5), (4, 2), (2, 2)), ((5, 4, 3), (2, 3, 3), (2, 2, 2)), ((4, 3, 3, 2), (3, 2, 2, 2), (2, 2, 2, 2))], ids=str)
@pytest.mark.parametrize("form", ["cells", "blocks"])
def test_tucker(spark, shape, block, ranks, form):
    x = low_rank(shape, ranks)
    t = TensorFrame.from_numpy(spark, x, block)
    t = t.to_blocks() if form == "blocks" else t
    model = tk.hooi(t, ranks, max_iter=4, eps=1e-6)
    as_cells = (lambda y: y.to_cells()) if form == "blocks" else (lambda y: y)
    core, back = as_cells(model.core).to_numpy(), as_cells(tk.reconstruct(model.core, model.factors)).to_numpy()
    assert core.shape == ranks and model.sweeps > 0
    for m, f in model.factors.items():
        assert np.allclose(f.T @ f, np.eye(f.shape[1]), atol=1e-8)
    assert np.isclose((x**2).sum(), (core**2).sum() + ((x - back) ** 2).sum())
    assert np.linalg.norm(x - back) / np.linalg.norm(x) < 0.1


def test_full_rank_is_exact_and_energy_grows(spark):
    x = np.random.default_rng(2).normal(size=(4, 3, 5))
    t = TensorFrame.from_numpy(spark, x)
    model = tk.hooi(t, x.shape, max_iter=1)
    assert np.allclose(tk.reconstruct(model.core, model.factors).to_numpy(), x)
    energy = [rel.norm_squared(tk.hooi(t, (2, 2, 2), max_iter=n, init="random", seed=3).core) for n in (1, 2, 3)]
    assert energy[0] <= energy[1] + 1e-9 <= energy[2] + 2e-9


def test_some_modes_only_and_clamped_rank(spark):
    x = np.random.default_rng(2).normal(size=(4, 3, 5))
    model = tk.hooi(TensorFrame.from_numpy(spark, x), (2, 9), modes=(2, 1), max_iter=2)
    assert model.core.meta.shape == (4, 3, 2) and set(model.factors) == {1, 2}


@pytest.mark.parametrize("args", [((2, 2), (0, 0)), ((0, 2), (0, 1)), ((2,), (0, 1)), ((2, 2), (0, 7))])
def test_bad_arguments(spark, args):
    t = TensorFrame.from_numpy(spark, np.ones((3, 3)))
    with pytest.raises(ValueError):
        tk.hooi(t, args[0], modes=args[1])


def test_leading_and_convergence():
    g = np.diag([1.0, 5.0, 3.0])
    assert np.array_equal(np.abs(tk.leading(g, 2)), [[0, 0], [1, 0], [0, 1]])
    assert tk.leading(g, 5).shape == (3, 3) and tk.leading(g, 5, pad=True).shape == (3, 5)
    a = np.eye(3)
    assert tk.converged(a, -a, 1e-9) and not tk.converged(a, a[:, ::-1], 1e-9) and not tk.converged(a, a * np.nan, 1e-9)


@pytest.mark.parametrize("sign", [1, -1])
def test_leading_keeps_every_column_under_both_signs(monkeypatch, sign):
    eigh = np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda g: (eigh(g)[0], sign * eigh(g)[1]))
    rng = np.random.default_rng(0)
    for _ in range(50):
        m = rng.random((6, 20)) * (rng.random(6) < 0.6)[:, None]
        out = tk.leading(m @ m.T, 6)
        assert np.allclose(out.T @ out, np.eye(6)) and np.all(out[np.abs(out).argmax(axis=0), range(6)] > 0)
    assert np.array_equal(tk.leading(np.diag([0.0, 3.0, 0.0]), 1), [[0], [1], [0]])


def with_empty_slices(shape=(6, 5, 4), seed=4):
    x = np.random.default_rng(seed).random(shape)
    x[[1, 4]], x[:, 0], x[:, :, 3] = 0, 0, 0
    return x


@pytest.mark.parametrize("form", ["cells", "blocks"])
@pytest.mark.parametrize("sign", [1, -1])
def test_models_with_empty_slices_lose_nothing(spark, monkeypatch, form, sign):
    eigh = np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda g: (eigh(g)[0], sign * eigh(g)[1]))
    x = with_empty_slices()
    t = TensorFrame.from_numpy(spark, x, (4, 2, 3))
    t = t.to_blocks() if form == "blocks" else t
    for m, f in tk.hosvd(t, x.shape).items():
        assert np.allclose(f.T @ f, np.eye(x.shape[m]))
    model = tk.hooi(t, (4, 4, 3), max_iter=2)
    back = tk.reconstruct(model.core, model.factors)
    assert np.allclose((back.to_cells() if form == "blocks" else back).to_numpy(), x)


def test_models_of_clusters_with_empty_slices(spark):
    x = with_empty_slices()
    t = TensorFrame.from_numpy(spark, x)
    members = spark.createDataFrame([(i, i % 2) for i in range(6)], "slice long, cluster int")
    for c, model in cw.fit_models(t, members, 2, 0, [0, 1, 2], (3, 5, 4), 2, 1e-6).items():
        assert np.allclose(tk.reconstruct(model.core, model.factors).to_numpy(), x[c::2])


def lloyd(x, centers, rounds):
    for _ in range(rounds):
        d = ((x[:, None] - centers[None]) ** 2).sum(-1)
        members = d.argmin(1)
        centers = np.array([x[members == c].mean(0) if (members == c).any() else centers[c] for c in range(len(centers))])
    return members, centers


@pytest.mark.parametrize("mode", [0, 1])
def test_kmeans_matches_numpy(spark, mode):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 9, 2)) + np.arange(12)[:, None, None] % 3 * 4 + np.arange(9)[None, :, None] % 3 * 4
    x[0] = 0
    m = np.transpose(x, [mode, *range(mode + 1, 3), *range(mode)]).reshape(x.shape[mode], -1, order="F")
    t = TensorFrame.from_numpy(spark, x)
    members, centroids = km.KMeans(3, 3, early_stop=False).run(t, mode)
    expected, centers = lloyd(m, m[:3].copy(), 3)
    assert [r["cluster"] for r in members.orderBy("slice").collect()] == expected.tolist()
    assert np.allclose([r["vec"] for r in centroids.orderBy("cluster").collect()], centers)


@pytest.mark.parametrize(("mode", "form"), [(0, "blocks"), (1, "long centroids, blocks"), (2, "long rows")])
def test_kmeans_of_blocks_and_without_broadcast(spark, mode, form, monkeypatch):
    """Dense blocks, and centroids above the bound, give what rows and broadcast centroids give."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(7, 5, 4)) + np.arange(7)[:, None, None] % 3 * 4 + np.arange(5)[None, :, None] % 3 * 4
    x[6] = 0
    t = TensorFrame.from_numpy(spark, x, (3, 2, 4))
    m = np.transpose(x, [mode, *range(mode + 1, 3), *range(mode)]).reshape(x.shape[mode], -1, order="F")
    expected, centers = lloyd(m, m[:3].copy(), 4)
    if "long" in form:
        monkeypatch.setattr(km, "CENTROID_VALUES", 3)
    job = km.KMeans(3, 4, early_stop=form == "blocks")
    members, centroids = job.run_rows(rel.row_vectors(t, mode)) if form == "long rows" else job.run(t.to_blocks() if "blocks" in form else t, mode)
    assert [r["cluster"] for r in members.orderBy("slice").collect()] == expected.tolist()
    if form != "blocks":
        assert np.allclose([r["vec"] for r in centroids.orderBy("cluster").collect()], centers)


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_row_vectors_of_blocks(spark, mode):
    x = np.random.default_rng(7).normal(size=(5, 4, 3))
    x[3:] = 0
    blocks = TensorFrame.from_numpy(spark, x, (3, 3, 2)).to_blocks()  # the second stripe's blocks are missing
    expected = {r["row"]: r["vec"] for r in rel.row_vectors(blocks.to_cells(), mode).collect()}
    assert {r["row"]: r["vec"] for r in bl.row_vectors(blocks, mode).collect()} == expected and len(expected) == x.shape[mode]


def test_blocks_meet_large_factors_by_a_join(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(5, 4, 3))
    b = np.random.default_rng(9).normal(size=(5, 2))
    t = TensorFrame.from_numpy(spark, x, (3, 2, 2)).to_blocks()
    monkeypatch.setattr(rel, "BROADCAST_CELLS", 4)
    got = tk._products(t, {0: b})
    assert got.meta.shape == (2, 4, 3) and np.allclose(got.to_cells().to_numpy(), np.tensordot(b.T, x, 1))


@pytest.mark.parametrize("held", [1, 4_000_000])
def test_gram_of_blocks_passes_sums_on(spark, monkeypatch, held):
    x = np.random.default_rng(10).normal(size=(5, 4, 3))
    monkeypatch.setattr(bl, "HELD", held)
    assert np.allclose(tk.gram_matrix(TensorFrame.from_numpy(spark, x, (2, 2, 2)).to_blocks(), 0), x.reshape(5, -1) @ x.reshape(5, -1).T)


@pytest.mark.parametrize("form", ["cells", "blocks"])
def test_clusters_with_gram_matrices_too_large_to_fetch(spark, monkeypatch, form):
    x = np.random.default_rng(4).normal(size=(8, 5, 4))
    t = TensorFrame.from_numpy(spark, x, (3, 5, 4))
    t = t.to_blocks() if form == "blocks" else t
    members = spark.createDataFrame([(i, i % 2) for i in range(8)], "slice long, cluster int")
    want = cw.fit_models(t, members, 2, 0, (0, 1, 2), (2, 2, 2), 2, 1e-9)
    monkeypatch.setattr(cl, "GRAM_CELLS", 9)
    held = cl.gathered(t, members, 0, {0: 4, 1: 4})
    with pytest.raises(ValueError, match="not fetched"):
        held.grams(0)
    monkeypatch.setattr(tk, "GRAM_CELLS", 9)
    monkeypatch.setattr(cw, "LOCAL_CELLS", 0)
    got = cw.fit_models(t, members, 2, 0, (0, 1, 2), (2, 2, 2), 2, 1e-9)
    for c in range(2):
        assert all(np.allclose(got[c].factors[m], want[c].factors[m], atol=1e-6) for m in range(3))


def test_kmeans_inits_empty_clusters_and_inertia(spark):
    x = np.array([[0.0, 0.0], [0.1, 0.0], [5.0, 5.0], [5.0, 5.1]])
    t = TensorFrame.from_numpy(spark, x)
    rows = rel.row_vectors(t, 0)
    given = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0]), (2, [99.0, 99.0])], "cluster int, vec array<double>")
    members, centroids = km.KMeans(3, 5, "given").run(t, 0, given)
    assert [r["cluster"] for r in members.orderBy("slice").collect()] == [0, 0, 1, 1]
    assert [r["vec"] for r in centroids.where("cluster = 2").collect()] == [[99.0, 99.0]]
    inertia = [km.inertia(rows, *km.KMeans(2, n, "random", seed=1, early_stop=False).run(t, 0)) for n in (1, 2, 3)]
    assert inertia[0] >= inertia[1] >= inertia[2]
    for bad in ({"k": 0}, {"k": 1, "init": "other"}):
        with pytest.raises(ValueError):
            km.KMeans(**bad)
    with pytest.raises(ValueError):
        km.KMeans(1, init="given").run(t, 0)


def test_gather_partitions_slices(spark):
    x = np.random.default_rng(1).normal(size=(6, 4, 3))
    t = TensorFrame.from_numpy(spark, x)
    members = spark.createDataFrame([(i, [0, 2, 0, 2, 2, 0][i]) for i in range(6)], "slice long, cluster int")
    sizes = {r["cluster"]: r["size"] for r in rel.cluster_sizes(members, 3).collect()}
    assert sizes == {0: 3, 1: 0, 2: 3}
    gathered = rel.gather(t, members, 0)
    for c, own in ((0, [0, 2, 5]), (2, [1, 3, 4])):
        assert np.array_equal(rel.cluster(gathered, c, rel.cluster_meta(t.meta, 0, 3)).to_numpy(), x[own])
    assert {r["cluster"]: r["slices"] for r in rel.members_of(members).collect()} == {0: [0, 2, 5], 2: [1, 3, 4]}


def test_cluster_models_are_those_of_each_alone(spark):
    x = np.random.default_rng(4).normal(size=(7, 4, 3))
    t = TensorFrame.from_numpy(spark, x)
    members = spark.createDataFrame([(i, i % 2) for i in range(7)], "slice long, cluster int")
    models = cw.fit_models(t, members, 2, 0, (0, 1, 2), (2, 2, 2), 2, 1e-9)
    for c in range(2):
        alone = tk.hooi(TensorFrame.from_numpy(spark, x[c::2]), (2, 2, 2), max_iter=2, eps=1e-9)
        for m in range(3):
            assert np.allclose(models[c].factors[m], alone.factors[m], atol=1e-6)
        assert np.allclose(models[c].core.to_numpy(), alone.core.to_numpy(), atol=1e-6)


def test_refinement_separates_two_models(spark):
    rng = np.random.default_rng(0)
    parts = [low_rank((5, 6, 4), (2, 1, 1), seed=s, noise=0) for s in (11, 12)]
    x = np.concatenate(parts) + 0.001 * rng.normal(size=(10, 6, 4))
    t = TensorFrame.from_numpy(spark, x)
    start = spark.createDataFrame([(i, int(i >= 5) if i not in (1, 7) else int(i < 5)) for i in range(10)], "slice long, cluster int")
    done = cw.refine(t, start, 2, (2, 1, 1), max_iter=4, sweeps=3)
    found = [r["cluster"] for r in done.members.orderBy("slice").collect()]
    assert len(set(found[:5])) == 1 and len(set(found[5:])) == 1 and found[0] != found[5]


def test_scores_are_norms_of_projections(spark):
    x = np.random.default_rng(3).normal(size=(4, 5, 3))
    t = TensorFrame.from_numpy(spark, x)
    model = tk.hooi(t, (2, 2, 2), max_iter=2)
    y = np.einsum("abc,bi,cj->aij", x, model.factors[1], model.factors[2])
    got = {r["row"]: r["score"] for r in cw.score_table(t, {0: model}, 0).collect()}
    assert np.allclose([got[i] for i in range(4)], np.linalg.norm(y.reshape(4, -1), axis=1))
    dual = {r["row"]: r["score"] for r in cw.dual_scores(t, model, 0).collect()}
    core = model.core.to_numpy()
    basis = np.linalg.svd(core.reshape(2, -1), full_matrices=False)[2]
    assert np.allclose([dual[i] for i in range(4)], np.linalg.norm(y.reshape(4, -1) @ basis.T, axis=1))

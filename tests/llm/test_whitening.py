import math

import numpy as np
import pytest

from polyad.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label string, x string, part string"


def brute(rows, k=4):
    """By the eigenvalues of the covariance of the distinct vectors."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, total = len(distinct), distinct.sum(axis=0)
    centred = (distinct - np.array([t / n for t in total])).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in kept:
        w = ((np.array(x) - np.array([t / n for t in total])) @ u[:, :k] / np.sqrt(e[:k])).tolist()
        out[i] = (n, sum((n * a - int(t)) ** 2 for a, t in zip(x, total, strict=True)), w, (e[:k] / e.sum()).tolist())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(900, 12)) @ np.diag(np.arange(12, 0, -1)) @ rng.normal(size=(12, 12)) / 8 + 3).astype(np.float32).tolist()
    return [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0]) for i in range(400)] + [(2001, None), (2002, vectors[1][:5] + [None] * 7), (2003, [float("nan")] * 12), (2004, [float("inf")] * 12)]


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(parts)


def test_equals_brute_force(spark, rows):
    want, signs, seen = brute(rows), {}, 0
    for r in wh.whiten(frame(spark, rows)).collect():
        n, deviation, w, explained = want[r["vec_id"]]
        c = r["component"] - 1
        sign = signs.setdefault(c, math.copysign(1, r["whitened"] * w[c]))
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["whitened"] - sign * w[c]) < 1e-9
        assert abs(r["explained"] / explained[c] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9
        seen += 1
    assert seen == 4 * 1300


def test_merging_loses_nothing():
    rng = np.random.default_rng(1)
    x = (1000 * rng.normal(size=(500, 9)) + 10**6).astype(np.int64)
    whole = wh.Summary.of(x)
    for cuts in ([250], [1, 3, 10, 499], list(range(7, 500, 7))):
        held = None
        for part in np.split(x, cuts):
            held = held.merge(wh.Summary.of(part)) if held else wh.Summary.of(part)
        assert held.n == 500 and held.total == whole.total and held.v.shape == (9, 9)
        assert np.allclose(held.s, whole.s, rtol=1e-10) and np.allclose(np.abs(np.sum(held.v * whole.v, axis=1)), 1, atol=1e-9)


def test_tree_of_several_levels(spark, rows, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["vec_id"], r["component"]): r["deviation"] for r in wh.whiten(frame(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(i, c): v[1] for i, v in brute(rows).items() for c in (1, 2, 3, 4)}


def test_null_ids_lengths_and_repeats(spark):
    rows = [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 4.5]), (3, [9.0]), (4, []), (5, [-1.0, 0.5])]
    got = wh.whiten(frame(spark, rows, 2)).collect()
    assert sorted([r["vec_id"] for r in got], key=str) == sorted([None, 1, 1, 2, 5] * 2, key=str) and {r["n"] for r in got} == {3}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]], ids=str)
def test_nothing_to_whiten(spark, rows):
    assert wh.whiten(frame(spark, rows, 1)).count() == 0


def test_rank_below_the_number_of_components(spark):
    got = wh.whiten(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], 2)).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_large_entries_are_exact_or_null():
    x = np.array([[2**40, -(2**40)], [1, 2], [3, 5]])
    s = wh.Summary.of(x)
    assert s.deviation(x) == [None, *(sum((3 * int(a) - t) ** 2 for a, t in zip(r, s.total, strict=True)) if sum((3 * int(a) - t) ** 2 for a, t in zip(r, s.total, strict=True)) < 2**63 else None for r in x[1:])]
    assert wh.column_sums(np.array([[2**62], [2**62]])) == [2**63]


def test_query_on_the_table(spark, sf):
    import __spark_entry__ as entry

    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = entry.queries()["op13_whitening"](spark, sf).collect()
    assert len(got) == 4 * len(want) and all((r["n"], r["deviation"]) == want[r["vec_id"]][:2] and abs(abs(r["whitened"]) - abs(want[r["vec_id"]][2][r["component"] - 1])) < 1e-6 for r in got)

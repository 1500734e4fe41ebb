"""Clusterwise Tucker approximation: slices are given to the cluster whose model holds most of them, and models are fitted anew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import BlockFrame, TensorFrame
from ..functions.index import l2_norm
from ..functions.index import modes as modes_of
from ..storage import materialise
from .blocks import unfold_local
from .clusters import ClusterCells, factor_tables, gathered, projected
from .relational import best, by_shrinkage, cluster_sizes, mode_n_products, row_norms, small
from .subspace import lists, right_vectors, tree_r
from .tucker import LOCAL_CELLS, Tucker, converged, leading


def slice_scores(t: TensorFrame, factors: Mapping[int, tuple[DataFrame, int]], mode: int) -> DataFrame:
    """row, score: the Frobenius norm of each slice after projection on all factors but that of `mode`."""
    others = {m: f for m, f in factors.items() if m != mode}
    return row_norms(mode_n_products(t, others, by_shrinkage(t.meta, {m: r for m, (_, r) in others.items()})), mode).select("row", F.col("norm").alias("score"))


def dual_scores(t: TensorFrame | BlockFrame, models: Mapping[int, Tucker] | Tucker, mode: int) -> DataFrame:
    """row, cluster, score: each slice projected on a model's bases, and further on the row space of its core's mode-n matricization M.

    Of a model's core only a triangle reaches the driver, of a tall QR of the columns of M: M^T = Q R, and with the singular values S and
    right vectors V of R the coordinates in the row space are those of P M^T V / S for the projected slices P. All models go through one plan,
    and t is scanned once. For a single model: row, score.
    """
    one = isinstance(models, Tucker)
    models = {0: models} if one else dict(models)
    names, spark = modes_of(t.meta.ndim), t.df.sparkSession
    others = [n for m, n in enumerate(names) if m != mode]
    cores = None
    for c, model in models.items():
        core = model.core.to_cells() if isinstance(model.core, BlockFrame) else model.core
        part = core.df.select(F.lit(c).cast("int").alias("cluster"), *others, F.col(names[mode]).alias("r"), F.col("v").alias("w"))
        cores = part if cores is None else cores.unionByName(part)
    cores, width = materialise(cores, "cores"), {c: m.core.meta.shape[mode] for c, m in models.items()}

    def columns(batches):
        for b in batches:
            for c, at, v in zip(b.column("cluster").to_pylist(), b.column("at"), b.column("v"), strict=True):
                x = np.zeros((1, width[c]))
                x[0, at.values.to_numpy()] = v.values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), lists(x)], ["cluster", "x"])

    packed = cores.groupBy("cluster", *others).agg(F.collect_list("r").alias("at"), F.collect_list("w").alias("v"))
    triangles, turns = tree_r(packed.select("cluster", "at", "v").mapInArrow(columns, "cluster int, x array<double>")), {}
    for c, n in width.items():
        s, v = right_vectors(triangles.get(c), n)
        turns[c] = v / s
    turn = factor_tables(spark, turns).select(F.col("cluster").alias("tc"), F.col("i").alias("ti"), F.col("r").alias("q"), F.col("v").alias("tv"))
    found = projected(t, {c: {m: b for m, b in model.factors.items() if m != mode} for c, model in models.items()})
    met = found.cells().join(cores, ["cluster", *others])
    inner = met.groupBy("cluster", F.col(names[mode]).alias("row"), "r").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    coordinates = inner.join(small(turn, sum(b.size for b in turns.values())), (F.col("cluster") == F.col("tc")) & (F.col("r") == F.col("ti")))
    summed = coordinates.groupBy("row", "cluster", "q").agg(F.sum(F.col("v") * F.col("tv")).alias("v"))
    out = summed.groupBy("row", "cluster").agg(l2_norm(F.col("v")).alias("score"))
    return out.drop("cluster") if one else out


def reassign(scores: DataFrame) -> DataFrame:
    """slice, cluster of the greatest score (row, cluster, score), ties to the lowest cluster."""
    return best(scores, "row", [F.desc("score"), F.col("cluster")]).select(F.col("row").alias("slice"), F.col("cluster").cast("int").alias("cluster"))


@dataclass(frozen=True)
class Clusterwise:
    members: DataFrame
    models: dict[int, Tucker]
    rounds: int


def _local_grams(held: ClusterCells, mode: int) -> dict[int, np.ndarray]:
    """From fetched tensors, whose extents are known to be small."""
    flat = {c: unfold_local(x, mode) for c, x in held.arrays().items()}
    return {c: m @ m.T for c, m in flat.items()}


def fit_models(t: TensorFrame | BlockFrame, members: DataFrame, k: int, mode: int, modes: Sequence[int], ranks: Sequence[int], max_iter: int, eps: float, before: Mapping[int, Tucker] | None = None) -> dict[int, Tucker]:
    """A Tucker model for each cluster by HOOI; an empty cluster keeps the one before.

    All clusters go through each step in one plan with a cluster column, on cells or on blocks as t is: the number of jobs doesn't grow with k. A
    cluster whose bases have converged keeps them while others go on.
    """
    sizes = {r["cluster"]: r["size"] for r in cluster_sizes(members, k).collect() if r["size"]}  # k rows
    held = gathered(t, members, mode, sizes).stored("clusters")
    rank = {c: {m: min(r, meta.shape[m]) for m, r in zip(modes, ranks, strict=True)} for c, meta in held.metas.items()}
    bases: dict[int, dict[int, np.ndarray]] = {c: {} for c in sizes}
    for m in modes:
        for c, found in held.bases(m, {c: r[m] for c, r in rank.items()}).items():
            bases[c][m] = found
    sweeps, going = dict.fromkeys(sizes, 0), set(sizes)
    for sweep in range(1, max_iter + 1):
        done = dict.fromkeys(going, True)
        for m in modes:
            left = held.only(going).products({c: {o: bases[c][o] for o in modes if o != m} for c in going})
            own = {c: rank[c][m] for c in going}
            found = {c: leading(g, own[c]) for c, g in _local_grams(left, m).items()} if left.size <= LOCAL_CELLS else left.stored("projected").bases(m, own)
            for c, new in found.items():
                done[c] &= converged(new, bases[c][m], eps)
                bases[c][m] = new
        sweeps |= {c: sweep for c in going if done[c]}
        going -= {c for c in done if done[c]}
        if not going:
            break
    cores = held.products(bases).stored("cores")
    return {c: m for c, m in (before or {}).items() if c not in sizes} | {c: Tucker(cores.cluster(c), bases[c], sweeps[c]) for c in sizes}


def score_table(t: TensorFrame | BlockFrame, models: Mapping[int, Tucker], mode: int, dual: bool = False) -> DataFrame:
    """row, cluster, score of every slice against every model, from one scan of t; slices without a cell have no row."""
    if dual:
        return dual_scores(t, models, mode)
    return projected(t, {c: {m: b for m, b in model.factors.items() if m != mode} for c, model in models.items()}).norms(mode)


def refine(t: TensorFrame | BlockFrame, members: DataFrame, k: int, ranks: Sequence[int], mode: int = 0, modes: Sequence[int] | None = None, max_iter: int = 5, sweeps: int = 20, eps: float = 5e-5, dual: bool = False, models: Mapping[int, Tucker] | None = None) -> Clusterwise:
    """Alternate between giving slices to models and fitting the models, until no slice moves or max_iter rounds are done."""
    modes = list(modes) if modes is not None else list(range(t.meta.ndim))
    t = type(t)(materialise(t.df, "clusterwise"), t.meta)
    members = materialise(members.select("slice", F.col("cluster").cast("int").alias("cluster")), "members")
    models = dict(models) if models else fit_models(t, members, k, mode, modes, ranks, sweeps, eps)
    done = 0
    for done in range(1, max_iter + 1):
        found = reassign(score_table(t, models, mode, dual))
        # a slice of zeros has no score anywhere and stays where it is
        new = members.join(found.withColumnRenamed("cluster", "to"), "slice", "left").select("slice", F.coalesce("to", "cluster").alias("cluster"))
        new = materialise(new, "members")
        moved = new.join(members.withColumnRenamed("cluster", "was"), "slice").where("cluster <> was").count()
        if not moved:
            break
        members = new
        models = fit_models(t, members, k, mode, modes, ranks, sweeps, eps, models)
    return Clusterwise(members, models, done)

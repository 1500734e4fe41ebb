"""Tucker decomposition: HOSVD and alternating iteration (HOOI), reconstruction, and the convergence test.

A mode's basis comes from its Gram matrix while that has at most GRAM_CELLS cells. A longer mode's basis comes from a tall QR of the slices where they
are short (as they are once the tensor is projected on the other bases), or else from block subspace iteration; it stays on the driver
as an array up to FACTOR_VALUES values, and beyond that it is a table (subspace.Wide) from start to end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import BlockFrame, TensorFrame
from ..storage import materialise
from . import blocks, relational, subspace
from .subspace import Wide

#: Cells of the largest Gram matrix that is fetched for its eigenvectors (128 MB, three times that on the way), and of the largest factor that is fetched.
GRAM_CELLS, FACTOR_VALUES = 16_000_000, 16_000_000
#: Projections of at most so many cells (24 MB) are fetched whole, and their Gram matrix is made locally.
LOCAL_CELLS = 1_000_000


@dataclass(frozen=True)
class Tucker:
    """core: cells (or blocks) of the core; factors: mode to an orthonormal extent x rank matrix (an array, or Wide beyond FACTOR_VALUES); sweeps: 0 if it didn't converge."""

    core: TensorFrame | BlockFrame
    factors: dict[int, np.ndarray | Wide]
    sweeps: int


def _cells(b: np.ndarray | Wide, spark, transpose: bool = False) -> DataFrame:
    cells = b.table() if isinstance(b, Wide) else relational.factor_table(spark, b)
    return relational.transposed(cells) if transpose else cells


def _products(t: TensorFrame | BlockFrame, factors: Mapping[int, np.ndarray | Wide], transpose: bool = False) -> TensorFrame | BlockFrame:
    """Products with the factors, or with transpose with what turns a core back."""
    rank = {m: b.shape[0 if transpose else 1] for m, b in factors.items()}
    if isinstance(t, BlockFrame):
        if not any(isinstance(b, Wide) for b in factors.values()) and sum(b.size for b in factors.values()) <= relational.BROADCAST_CELLS:
            return blocks.mode_n_products(t, {m: np.ascontiguousarray(b.T) if transpose else b for m, b in factors.items()})
        # factors too large for each task meet the blocks by tiles
        for m in relational.by_shrinkage(t.meta, rank):
            t = blocks.tiled_product(t, m, _cells(factors[m], t.df.sparkSession, transpose), rank[m])
        return t
    for m in relational.by_shrinkage(t.meta, rank):
        if isinstance(factors[m], Wide):
            t = (subspace.expanded if transpose else subspace.projected)(t, m, factors[m])
        else:
            t = relational.mode_n_product(t, m, _cells(factors[m], t.spark, transpose), rank[m])
    return t


def gram_matrix(t: TensorFrame | BlockFrame, mode: int, local: int = 0) -> np.ndarray:
    """The mode-n Gram matrix as a local array: extent squared values, whatever the tensor's size.

    local: a tensor of at most so many cells (by its extents) is fetched instead, which saves the join.
    """
    n = t.meta.shape[mode]
    if t.meta.size <= local:
        m = blocks.unfold_local((t.to_cells() if isinstance(t, BlockFrame) else t).to_numpy(), mode)
        return m @ m.T
    if n * n > GRAM_CELLS:
        raise ValueError(f"the Gram matrix of mode {mode} has {n} x {n} cells; over {GRAM_CELLS} are not fetched")
    cells = (blocks.gram if isinstance(t, BlockFrame) else relational.gram)(t, mode)
    return relational.factor_matrix(cells.select(F.col("r").alias("i"), F.col("c").alias("r"), "v"), n, n)


def leading(gram: np.ndarray, rank: int, pad: bool = False) -> np.ndarray:
    """Eigenvectors of the largest eigenvalues, descending, each with its largest entry positive.

    A rank above the extent is cut to it, or with pad filled up with zero columns.
    """
    _, vectors = np.linalg.eigh(gram)
    out = vectors[:, ::-1][:, :rank].copy()
    picked = out[np.argmax(np.abs(out), axis=0), np.arange(out.shape[1])]
    out *= np.where(picked < 0, -1.0, 1.0)
    return np.hstack([out, np.zeros((len(out), rank - out.shape[1]))]) if pad and rank > out.shape[1] else out


def extract_basis(t: TensorFrame | BlockFrame, mode: int, rank: int, pad: bool = False, local: int = 0) -> np.ndarray | Wide:
    """The leading left singular vectors of the mode-n matricization, of a mode of any extent."""
    n = t.meta.shape[mode]
    if n * n <= GRAM_CELLS:
        return leading(gram_matrix(t, mode, local), rank, pad)
    width = t.meta.size // n
    if width <= subspace.NARROW:
        if isinstance(t, BlockFrame):
            rows = blocks.row_vectors(t, mode).select(F.col("row").alias("k"), F.col("vec").alias("x"))
        else:
            rows = subspace.dense_rows(relational.unfold(t, mode), width)
        found = subspace.by_columns(rows, n, rank, width)
    else:
        found = subspace.by_iteration(relational.unfold(t.to_cells() if isinstance(t, BlockFrame) else t, mode), n, rank)
    return found.local() if found.size <= FACTOR_VALUES else found


def converged(a: np.ndarray | Wide, b: np.ndarray | Wide, eps: float) -> bool:
    """Whether every column of a is that of b up to sign: |1 - |<a, b>|| < eps. Not a number is not converged."""
    if isinstance(a, Wide) or isinstance(b, Wide):
        return not convergence_table(_cells(a, a.rows.sparkSession), _cells(b, b.rows.sparkSession), eps).where("NOT converged OR isnan(cosine)").limit(1).count()
    return bool(np.all(np.abs(1 - np.abs((a * b).sum(axis=0))) < eps))


def _checked(t, modes: Sequence[int], ranks: Sequence[int]) -> dict[int, int]:
    if len(modes) != len(ranks) or len(set(modes)) != len(modes) or not all(0 <= m < t.meta.ndim for m in modes):
        raise ValueError("modes must be different modes of the tensor, with a rank each")
    if min(ranks, default=1) < 1:
        raise ValueError("ranks are 1 at least")
    return {m: min(r, t.meta.shape[m]) for m, r in zip(modes, ranks, strict=True)}


def hosvd(t: TensorFrame | BlockFrame, ranks: Sequence[int], modes: Sequence[int] | None = None) -> dict[int, np.ndarray | Wide]:
    """The leading eigenvectors of each mode's Gram matrix."""
    wanted = _checked(t, modes if modes is not None else range(t.meta.ndim), ranks)
    return {m: extract_basis(t, m, r) for m, r in wanted.items()}


def random_bases(t: TensorFrame | BlockFrame, ranks: Mapping[int, int], seed: int) -> dict[int, np.ndarray | Wide]:
    """Seeded orthonormal columns; those beyond FACTOR_VALUES values are made where they are stored."""
    rng, out = np.random.default_rng(seed), {}
    for m, r in ranks.items():
        n = t.meta.shape[m]
        if n * r <= FACTOR_VALUES:
            out[m] = np.linalg.qr(rng.random((n, r)))[0]
        else:
            noise = [(F.xxhash64("id", F.lit(j), F.lit(seed)) / float(1 << 63)).alias(f"s{j}") for j in range(r)]
            out[m] = subspace.by_columns(t.df.sparkSession.range(n).select(F.col("id").alias("k"), F.array(*noise).alias("x")), n, r, r)
    return out


def hooi(t: TensorFrame | BlockFrame, ranks: Sequence[int], modes: Sequence[int] | None = None, max_iter: int = 20, eps: float = 5e-5, init: str = "hosvd", seed: int = 0, keep: bool = True) -> Tucker:
    """Tucker decomposition by alternating iteration.

    Per sweep and mode, the tensor is projected on all other bases and the basis becomes the leading eigenvectors of what
    remains; it ends when every mode's basis has converged in a sweep. What reaches the driver per mode and sweep is one Gram
    matrix or triangle, or a projection of at most LOCAL_CELLS cells, and factors of at most FACTOR_VALUES values. keep: write the input to shared storage first, since every sweep reads it once per mode.
    """
    modes = list(modes) if modes is not None else list(range(t.meta.ndim))
    wanted = _checked(t, modes, ranks)
    if keep:
        t = type(t)(materialise(t.df, "hooi"), t.meta)
    if init not in ("hosvd", "random"):
        raise ValueError("init is hosvd or random")
    factors = hosvd(t, [wanted[m] for m in modes], modes) if init == "hosvd" else random_bases(t, wanted, seed)
    sweeps, projected = 0, t
    for sweep in range(1, max_iter + 1):
        done = True
        for m in modes:
            projected = _products(t, {o: factors[o] for o in modes if o != m})
            new = extract_basis(projected, m, wanted[m], local=LOCAL_CELLS)
            done &= converged(new, factors[m], eps)
            factors[m] = new
        if done:
            sweeps = sweep
            break
    last = modes[-1]
    core = _products(projected if max_iter else _products(t, {o: factors[o] for o in modes if o != last}), {last: factors[last]})
    return Tucker(core, factors, sweeps)


def reconstruct(core: TensorFrame | BlockFrame, factors: Mapping[int, np.ndarray | Wide]) -> TensorFrame | BlockFrame:
    """Core times every factor: the approximation of the tensor.

    A core in blocks that is small, with factors that are, is sent to the tasks, and each target block is made whole where it belongs: nothing is shuffled or
    summed. Otherwise contributions of the core's cells or blocks are summed by target. Lazy, but for such a core, and for a small one in cells that meets a factor in rows, which are fetched.
    """
    if isinstance(core, BlockFrame) and core.meta.size <= relational.BROADCAST_CELLS and not any(isinstance(b, Wide) for b in factors.values()) and sum(b.size for b in factors.values()) <= relational.BROADCAST_CELLS:
        return blocks.spread(core.df.sparkSession, core.to_numpy(), core.meta, factors)
    return _products(core, factors, transpose=True)


def convergence_table(a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    """r, cosine, converged for each column of two factor tables (i, r, v)."""
    other = b.select("i", "r", F.col("v").alias("w"))
    dots = a.join(other, ["i", "r"]).groupBy("r").agg(F.sum(F.col("v") * F.col("w")).alias("cosine"))
    return dots.withColumn("converged", F.abs(1 - F.abs("cosine")) < eps)

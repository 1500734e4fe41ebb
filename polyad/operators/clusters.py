"""The sub-tensors of all clusters of slices in one table, as cells or as dense blocks, and what is computed for all of them at once.

Both forms have the same methods, each one plan whatever the number of clusters: gather, products with each cluster's own factors, Gram matrices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import BlockFrame, TensorFrame, block_schema
from ..functions.index import block_modes, modes
from ..meta import TensorMeta
from ..storage import materialise
from . import blocks, relational
from .tucker import GRAM_CELLS, extract_basis, leading


def factor_tables(spark: SparkSession, factors: Mapping[int, np.ndarray]) -> DataFrame:
    """cluster, i, r, v of a factor matrix for each cluster."""
    parts = []
    for c, b in factors.items():
        i, r = np.divmod(np.arange(b.size), b.shape[1])
        parts.append(pd.DataFrame({"cluster": np.full(b.size, c, np.int32), "i": i, "r": r, "v": b.reshape(-1)}))
    return spark.createDataFrame(pd.concat(parts), "cluster int, i long, r long, v double")


def products_by_cluster(cells: DataFrame, names: Sequence[str], factors: Mapping[int, Mapping[int, np.ndarray]]) -> DataFrame:
    """Products of all clusters' cells (cluster, i.., v) with their own factors (cluster to mode to matrix), a join per mode for all of them.

    Cells without a cluster column meet every cluster's factors.
    """
    spark = cells.sparkSession
    by_cost = sorted({m for f in factors.values() for m in f}, key=lambda m: (sum(f[m].shape[1] / f[m].shape[0] for f in factors.values()), m))
    for m in by_cost:
        table = factor_tables(spark, {c: f[m] for c, f in factors.items()})
        b = relational.small(table, sum(f[m].size for f in factors.values())).select(F.col("cluster").alias("bc"), F.col("i").alias("bi"), F.col("r").alias("br"), F.col("v").alias("bv"))
        own = "cluster" in cells.columns
        on = (F.col(names[m]) == F.col("bi")) & (F.col("cluster") == F.col("bc")) if own else F.col(names[m]) == F.col("bi")
        kept = [F.col("br").alias(c) if j == m else F.col(c) for j, c in enumerate(names)]
        cells = cells.join(b, on).groupBy(F.col("bc").alias("cluster"), *kept).agg(F.sum(F.col("v") * F.col("bv")).alias("v"))
    return cells


def _checked(extents: Mapping[int, int], mode: int) -> None:
    if sum(n * n for n in extents.values()) > GRAM_CELLS:
        raise ValueError(f"the Gram matrices of mode {mode} of all clusters hold over {GRAM_CELLS} cells and are not fetched")


def _matrices(entries: DataFrame, extents: Mapping[int, int]) -> dict[int, np.ndarray]:
    """Square matrices from their cells (cluster, r, c, v)."""
    found = entries.toArrow()
    cluster_no, r, c, v = (np.asarray(found[k]) for k in ("cluster", "r", "c", "v"))
    out = {k: np.zeros((n, n)) for k, n in extents.items()}
    for k, g in out.items():
        own = cluster_no == k
        g[r[own], c[own]] = v[own]
    return out


@dataclass(frozen=True)
class ClusterCells:
    """cluster, i0.., v; metas: each cluster's metadata."""

    df: DataFrame
    metas: dict[int, TensorMeta]

    @property
    def names(self) -> list[str]:
        return modes(next(iter(self.metas.values())).ndim)

    @classmethod
    def gather(cls, t: TensorFrame, members: DataFrame, mode: int, metas: dict[int, TensorMeta]) -> ClusterCells:
        return cls(relational.gather(t, members, mode), metas)

    def _with(self, df: DataFrame, metas: dict[int, TensorMeta] | None = None):
        return type(self)(df, metas or self.metas)

    def stored(self, name: str):
        return self._with(materialise(self.df, name))

    def only(self, clusters: Sequence[int]):
        return self._with(self.df.where(F.col("cluster").isin(sorted(clusters))), {c: self.metas[c] for c in clusters})

    @property
    def size(self) -> int:
        return sum(prod(m.shape) for m in self.metas.values())

    def products(self, factors: Mapping[int, Mapping[int, np.ndarray]]) -> ClusterCells:
        metas = {}
        for c, own in factors.items():
            metas[c] = self.metas[c]
            for m, b in own.items():
                metas[c] = metas[c].replace(m, b.shape[1])
        return self._with(products_by_cluster(self.df, self.names, factors), metas)

    def grams(self, mode: int) -> dict[int, np.ndarray]:
        """The mode's Gram matrix of every cluster: extent squared values each, together at most GRAM_CELLS."""
        extents = {c: m.shape[mode] for c, m in self.metas.items()}
        _checked(extents, mode)
        return _matrices(self._entries(mode), extents)

    def bases(self, mode: int, ranks: Mapping[int, int]) -> dict[int, np.ndarray]:
        """The leading vectors of every cluster: by one aggregate while the Gram matrices are few cells, else as for any long mode, a cluster at a time."""
        if sum(m.shape[mode] ** 2 for m in self.metas.values()) <= GRAM_CELLS:
            return {c: leading(g, ranks[c]) for c, g in self.grams(mode).items()}
        return {c: extract_basis(self.cluster(c), mode, ranks[c]) for c in self.metas}

    def _entries(self, mode: int) -> DataFrame:
        meta = max(self.metas.values(), key=lambda m: m.shape[mode])
        return relational.gram(TensorFrame(self.df, meta), mode, ("cluster",))

    def arrays(self) -> dict[int, np.ndarray]:
        """For small ones: all clusters' tensors as arrays."""
        rows = self.df.toArrow()
        owner, at, v = np.asarray(rows["cluster"]), [np.asarray(rows[c]) for c in self.names], np.asarray(rows["v"])
        out = {}
        for c, meta in self.metas.items():
            out[c], own = np.zeros(meta.shape), owner == c
            out[c][tuple(a[own] for a in at)] = v[own]
        return out

    def norms(self, mode: int) -> DataFrame:
        """row, cluster, score: the norm of each slice that has a cell."""
        return self.df.groupBy(F.col(f"i{mode}").alias("row"), "cluster").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("score"))

    def cluster(self, c: int) -> TensorFrame:
        return relational.cluster(self.df, c, self.metas[c])

    def cells(self) -> DataFrame:
        return self.df


@dataclass(frozen=True)
class ClusterBlocks(ClusterCells):
    """cluster, b0.., data: each cluster's blocks on its own grid; missing ones are zero."""

    @property
    def keys(self) -> list[str]:
        return block_modes(len(self.names))

    @classmethod
    def gather(cls, t: BlockFrame, members: DataFrame, mode: int, metas: dict[int, TensorMeta]) -> ClusterBlocks:
        """Pieces of the blocks go to the (ragged) grid of each cluster: one shuffle of values.

        Members meet the blocks by their block index along the mode, a row with the members of each.
        """
        meta, keys = t.meta, t.keys
        k, place = meta.block_shape[mode], block_modes(meta.ndim)[mode]
        placed = relational.membership(members).groupBy(F.floor(F.col("slice") / k).cast("int").alias("_at")).agg(*[F.collect_list(c).alias(f"_{c}") for c in ("slice", "cluster", "pos")])
        met = t.df.join(placed, F.col(place) == F.col("_at"))

        def cut(frames):
            for pdf in frames:
                for *key, data, slices, owners, pos in zip(*(pdf[c] for c in [*keys, "data", "_slice", "_cluster", "_pos"]), strict=True):
                    x = blocks.local(meta, key, data)
                    slices, owners, pos = (np.asarray(a, np.int64) for a in (slices, owners, pos))
                    extent = np.array([metas[c].block_shape[mode] for c in owners.tolist()])
                    groups = np.unique(np.stack([owners, pos // extent]), axis=1, return_inverse=True)
                    for g, (c, to) in enumerate(groups[0].T.tolist()):
                        own = groups[1].reshape(-1) == g
                        piece = np.take(x, slices[own] - meta.block_range(mode, key[mode])[0], axis=mode)
                        at = [to if m == mode else int(b) for m, b in enumerate(key)]
                        yield pd.DataFrame([[c, *at, pos[own] - to * extent[own], piece.reshape(-1, order="F")]], columns=["cluster", *keys, "at", "data"])

        def fill(frames):
            key, x = None, None
            for pdf in frames:
                for *now, at, data in zip(*(pdf[c] for c in ["cluster", *keys, "at", "data"]), strict=True):
                    if now != key:
                        if key is not None:
                            yield pd.DataFrame([[*key, x.reshape(-1, order="F")]], columns=["cluster", *keys, "data"])
                        key, x = now, np.zeros(metas[now[0]].local_shape(now[1:]))
                    at = np.asarray(at, np.int64)
                    x[tuple(at if m == mode else slice(None) for m in range(meta.ndim))] = np.asarray(data).reshape([len(at) if m == mode else e for m, e in enumerate(x.shape)], order="F")
            if key is not None:
                yield pd.DataFrame([[*key, x.reshape(-1, order="F")]], columns=["cluster", *keys, "data"])

        schema, by = "cluster int, " + block_schema(meta.ndim), ["cluster", *keys]
        pieces = met.mapInPandas(cut, schema.replace("data array", "at array<long>, data array"))
        return cls(pieces.repartition(*by).sortWithinPartitions(*by).mapInPandas(fill, schema), metas)

    def products(self, factors: Mapping[int, Mapping[int, np.ndarray]]) -> ClusterBlocks:
        return self._with(*blocks.products_of(self.df, self.metas, factors))

    def _entries(self, mode: int) -> DataFrame:
        return blocks.gram_of(self.df, self.metas, mode)

    def arrays(self) -> dict[int, np.ndarray]:
        found = self.df.toArrow()
        out = {c: np.zeros(m.shape) for c, m in self.metas.items()}
        for i in range(len(found)):
            c, key = found.column("cluster")[i].as_py(), [found.column(k)[i].as_py() for k in self.keys]
            meta = self.metas[c]
            out[c][tuple(slice(*meta.block_range(m, b)) for m, b in enumerate(key))] = blocks.local(meta, key, found.column("data")[i].values.to_numpy())
        return out

    def norms(self, mode: int) -> DataFrame:
        metas, columns = self.metas, ["cluster", *self.keys]

        def squares(frames):
            for pdf in frames:
                for *key, data in zip(*(pdf[c] for c in [*columns, "data"]), strict=True):
                    x = blocks.unfold_local(blocks.local(metas[key[0]], key[1:], data), mode)
                    start = metas[key[0]].block_range(mode, key[1 + mode])[0]
                    yield pd.DataFrame({"row": np.arange(start, start + len(x)), "cluster": np.int32(key[0]), "v": (x * x).sum(axis=1)})

        parts = self.df.mapInPandas(squares, "row long, cluster int, v double")
        return parts.groupBy("row", "cluster").agg(F.sqrt(F.sum("v")).alias("score")).where("score > 0")

    def cluster(self, c: int) -> BlockFrame:
        return BlockFrame(self.df.where(F.col("cluster") == c).drop("cluster"), self.metas[c])

    def cells(self) -> DataFrame:
        """cluster, i.., v of all cells but zeros."""
        metas, columns, names = self.metas, ["cluster", *self.keys], self.names

        def spread(frames):
            for pdf in frames:
                for *key, data in zip(*(pdf[c] for c in [*columns, "data"]), strict=True):
                    x = blocks.local(metas[key[0]], key[1:], data)
                    at = np.nonzero(x)
                    found = {n: a + metas[key[0]].block_range(m, key[1 + m])[0] for m, (n, a) in enumerate(zip(names, at, strict=True))}
                    yield pd.DataFrame({"cluster": np.full(len(at[0]), key[0], np.int32)} | found | {"v": x[at]})

        return self.df.mapInPandas(spread, "cluster int, " + ", ".join(f"{n} long" for n in names) + ", v double")


def gathered(t: TensorFrame | BlockFrame, members: DataFrame, mode: int, sizes: Mapping[int, int]) -> ClusterCells:
    """The sub-tensors of all clusters with members; sizes: the members of each."""
    metas = {c: relational.cluster_meta(t.meta, mode, n) for c, n in sizes.items() if n}
    return (ClusterBlocks if isinstance(t, BlockFrame) else ClusterCells).gather(t, members, mode, metas)


def projected(t: TensorFrame | BlockFrame, factors: Mapping[int, Mapping[int, np.ndarray]]) -> ClusterCells:
    """One tensor times every cluster's factors, from one scan of it."""
    metas = dict.fromkeys(factors, t.meta)
    if isinstance(t, BlockFrame):
        return ClusterBlocks(*blocks.products_of(t.df, metas, factors))
    return ClusterCells(t.df, metas).products(factors)

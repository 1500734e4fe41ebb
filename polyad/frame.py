"""TensorFrame: a DataFrame of cells or of blocks with the metadata of the array."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.index import block_modes, div, linear, modes, sub_indices
from .meta import TensorMeta


@dataclass(frozen=True)
class TensorFrame:
    """Cells: i0..i{N-1} BIGINT, v DOUBLE; a cell that is not there is 0, and a cell is there once."""

    df: DataFrame
    meta: TensorMeta

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def index(self) -> list[str]:
        return modes(self.meta.ndim)

    def others(self, mode: int) -> list[str]:
        return [c for m, c in enumerate(self.index) if m != mode]

    @classmethod
    def build(cls, source: DataFrame, index: Sequence, value, meta: TensorMeta) -> TensorFrame:
        """Cells by summing `value` over the rows of source that share the index expressions."""
        names = modes(meta.ndim)
        keyed = source.select(*[F.expr(x).cast("long").alias(n) if isinstance(x, str) else x.cast("long").alias(n) for x, n in zip(index, names, strict=True)], (F.expr(value) if isinstance(value, str) else value).cast("double").alias("v"))
        return cls(keyed.groupBy(*names).agg(F.sum("v").alias("v")), meta)

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray, block_shape: Sequence[int] | None = None, dense: bool = False) -> TensorFrame:
        """A small array. Zero cells are left out unless dense."""
        at = np.argwhere(np.ones_like(array, bool) if dense else array != 0)
        data = {n: at[:, m].astype("int64") for m, n in enumerate(modes(array.ndim))} | {"v": array[tuple(at.T)].astype("float64")}
        schema = ", ".join(f"{n} long" for n in modes(array.ndim)) + ", v double"
        df = spark.createDataFrame(pd.DataFrame(data), schema)
        return cls(df, TensorMeta(array.shape, tuple(block_shape or array.shape)))

    def to_numpy(self) -> np.ndarray:
        """For small tensors: fetches all cells."""
        out = np.zeros(self.meta.shape)
        rows = self.df.toArrow()
        out[tuple(np.asarray(rows[c]) for c in self.index)] = np.asarray(rows["v"])
        return out

    def zero_filled(self) -> TensorFrame:
        """With a row for every cell."""
        grid = self.spark.range(self.meta.size).select(*[c.alias(n) for c, n in zip(sub_indices(F.col("id"), self.meta.shape), self.index, strict=True)])
        return TensorFrame(grid.join(self.df, self.index, "left").select(*self.index, F.coalesce("v", F.lit(0.0)).alias("v")), self.meta)

    def rebased(self, meta: TensorMeta) -> TensorFrame:
        return TensorFrame(self.df, meta)

    # blocks

    def with_blocks(self) -> DataFrame:
        """Cells with their block indices b*, linear block number, and place in the block (first mode fastest)."""
        at = [div(F.col(c), k) for c, k in zip(self.index, self.meta.block_shape, strict=True)]
        df = self.df.select("*", *[a.cast("int").alias(b) for a, b in zip(at, block_modes(self.meta.ndim), strict=True)])
        local, stride = F.lit(0).cast("long"), F.lit(1).cast("long")
        for c, b, k, e in zip(self.index, block_modes(self.meta.ndim), self.meta.block_shape, self.meta.shape, strict=True):
            local = local + (F.col(c) - F.col(b) * k) * stride
            stride = stride * F.least(F.lit(k), F.lit(e) - F.col(b) * k)
        return df.select("*", linear(block_modes(self.meta.ndim), self.meta.block_num).alias("block"), local.alias("local"))

    def to_blocks(self) -> BlockFrame:
        """Dense blocks: cells are gathered per block and scattered into place; cells that are missing become 0."""
        meta, keys = self.meta, block_modes(self.meta.ndim)
        gathered = self.with_blocks().groupBy(*keys).agg(F.collect_list("local").alias("at"), F.collect_list("v").alias("v"))

        def scatter(frames):
            for pdf in frames:
                out = []
                for row in pdf.itertuples(index=False):
                    data = np.zeros(int(np.prod(meta.local_shape([getattr(row, k) for k in keys]))))
                    data[np.asarray(row.at, np.int64)] = row.v
                    out.append(data)
                yield pdf[keys].assign(data=out)

        return BlockFrame(gathered.mapInPandas(scatter, block_schema(meta.ndim)), meta)


def block_schema(n: int) -> str:
    return ", ".join(f"{b} int" for b in block_modes(n)) + ", data array<double>"


@dataclass(frozen=True)
class BlockFrame:
    """Blocks: b0..b{N-1} INT, data ARRAY<DOUBLE> with the block's cells, the first mode fastest. A missing block is zero."""

    df: DataFrame
    meta: TensorMeta

    @property
    def keys(self) -> list[str]:
        return block_modes(self.meta.ndim)

    def to_cells(self, zeros: bool = False) -> TensorFrame:
        """Cells of the blocks, in column expressions alone."""
        spread = self.df.select(*self.keys, F.posexplode("data").alias("at", "v"))
        if not zeros:
            spread = spread.where("v <> 0")
        out, stride = [], F.lit(1).cast("long")
        for m, (b, k, e) in enumerate(zip(self.keys, self.meta.block_shape, self.meta.shape, strict=True)):
            extent = F.least(F.lit(k), F.lit(e) - F.col(b) * k).cast("long")
            out.append((F.pmod(F.floor(F.col("at") / stride).cast("long"), extent) + F.col(b) * k).cast("long").alias(f"i{m}"))
            stride = stride * extent
        return TensorFrame(spread.select(*out, "v"), self.meta)

    def to_numpy(self) -> np.ndarray:
        """For small tensors: fetches all blocks."""
        out, found = np.zeros(self.meta.shape), self.df.select(*self.keys, "data").toArrow()
        for i in range(len(found)):
            key = [found.column(k)[i].as_py() for k in self.keys]
            at = tuple(slice(*self.meta.block_range(m, b)) for m, b in enumerate(key))
            out[at] = found.column("data")[i].values.to_numpy().reshape(self.meta.local_shape(key), order="F")
        return out

    def lookup(self, block: Sequence[int]) -> DataFrame:
        """One block by its key: a filter that reaches a Parquet scan, and the files and records of a tensor directory."""
        df = self.df
        for k, b in zip(self.keys, block, strict=True):
            df = df.where(F.col(k) == b)
        return df

    def stripe(self, mode: int, b: int) -> DataFrame:
        """The blocks with index b along a mode."""
        return self.df.where(F.col(self.keys[mode]) == b)

    def edge(self, mode: int, last: bool = True) -> DataFrame:
        """The last stripe of a mode, or all others."""
        final = F.col(self.keys[mode]) == self.meta.block_num[mode] - 1
        return self.df.where(final if last else ~final)

    def ordered(self, mode: int) -> DataFrame:
        """Blocks in the order of the mode-n matricization: mode n first, then n-1, ..., with n+1 fastest."""
        n = self.meta.ndim
        return self.df.orderBy(self.keys[mode], *[self.keys[(mode - j) % n] for j in range(1, n)])

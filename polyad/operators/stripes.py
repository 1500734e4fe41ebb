"""k-means of the slices of a tensor in dense blocks, stripe by stripe.

A stripe is all blocks that share their indices in the other modes: they hold the same columns of the matricization. Centroids are kept by
stripe, a k x columns matrix each, and meet the blocks by stripe. A block adds x.x - 2 x.c to the squared distances of its slices, by one matrix product, and
what is exchanged is k numbers for each slice and task; c.c is added once for each centroid. Means are made the same way, one matrix product for
each block and sums by stripe. Neither slices nor centroids are ever cells or whole rows, and blocks that are missing count as zero without being made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import BlockFrame
from ..functions.index import linear
from ..meta import TensorMeta
from ..storage import Rounds, materialise
from . import blocks
from .relational import cyclic

PIECES = "stripe int, cluster int, data array<double>"
STRIPES = "stripe int, data array<double>"


class Grid:
    """Slices along a mode: row blocks, stripes and the columns of each."""

    def __init__(self, meta: TensorMeta, mode: int):
        self.meta, self.mode = meta, mode
        self.rest = cyclic(meta, mode)
        self.counts = [meta.block_num[m] for m in self.rest]
        self.rows, self.stripes = meta.block_num[mode], int(np.prod(self.counts))

    def key(self, row: int, stripe: int) -> tuple[int, ...]:
        out = [0] * self.meta.ndim
        out[self.mode] = row
        for m, n in zip(self.rest, self.counts, strict=True):
            stripe, out[m] = divmod(stripe, n)
        return tuple(out)

    def matrix(self, row: int, stripe: int, data) -> np.ndarray:
        """Slices x columns of a block."""
        return blocks.unfold_local(blocks.local(self.meta, self.key(row, stripe), data), self.mode)

    def width(self, stripe: int) -> int:
        shape = self.meta.local_shape(self.key(0, stripe))
        return int(np.prod([e for m, e in enumerate(shape) if m != self.mode]))

    def slices(self, row: int) -> tuple[int, int]:
        return self.meta.block_range(self.mode, row)

    def placed(self, t: BlockFrame) -> DataFrame:
        """row, stripe, data."""
        stripe = linear([t.keys[m] for m in self.rest], self.counts) if self.rest else F.lit(0)
        return t.df.select(F.col(t.keys[self.mode]).alias("row"), stripe.cast("int").alias("stripe"), "data")


def _frame(**columns) -> pd.DataFrame:
    return pd.DataFrame(columns)


def _gathered(pieces: DataFrame, grid: Grid, k: int) -> DataFrame:
    """stripe, data (k x columns) of every stripe, from the rows of centroids (stripe, cluster, data); what is missing is zero."""
    every = pieces.sparkSession.range(grid.stripes).select(F.col("id").cast("int").alias("stripe"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("array<double>").alias("data"))

    def place(frames: Iterator[pd.DataFrame]):
        stripe, x = None, None
        for pdf in frames:
            for s, c, data in zip(pdf["stripe"], pdf["cluster"], pdf["data"], strict=True):
                if s != stripe:
                    if stripe is not None:
                        yield _frame(stripe=[stripe], data=[x.reshape(-1)])
                    stripe, x = int(s), np.zeros((k, grid.width(int(s))))
                if data is not None:
                    x[int(c)] += data
        if stripe is not None:
            yield _frame(stripe=[stripe], data=[x.reshape(-1)])

    return pieces.unionByName(every).repartition("stripe").sortWithinPartitions("stripe").mapInPandas(place, STRIPES)


def from_slices(t: BlockFrame, mode: int, chosen: list[int]) -> DataFrame:
    """Centroids by stripe that are slices of the tensor; chosen: a slice for each."""
    grid = Grid(t.meta, mode)
    rows = sorted({c // t.meta.block_shape[mode] for c in chosen})

    def cut(frames):
        for pdf in frames:
            for row, stripe, data in zip(pdf["row"], pdf["stripe"], pdf["data"], strict=True):
                start, stop = grid.slices(row)
                x = grid.matrix(row, stripe, data)
                own = [(c, i - start) for c, i in enumerate(chosen) if start <= i < stop]
                yield _frame(stripe=np.full(len(own), stripe, np.int32), cluster=np.array([c for c, _ in own], np.int32), data=[x[i] for _, i in own])

    return _gathered(grid.placed(t).where(F.col("row").isin(rows)).mapInPandas(cut, PIECES), grid, len(chosen))


def from_vectors(meta: TensorMeta, mode: int, centroids: DataFrame, k: int) -> DataFrame:
    """Centroids by stripe from whole vectors (cluster, vec) in matricization order."""
    grid = Grid(meta, mode)

    def cut(frames):
        for pdf in frames:
            for c, vec in zip(pdf["cluster"], pdf["vec"], strict=True):
                vec = np.asarray(vec, float)
                for s in range(grid.stripes):
                    yield _frame(stripe=np.array([s], np.int32), cluster=np.array([c], np.int32), data=[vec[blocks.columns(meta, mode, s)]])

    return _gathered(centroids.select("cluster", "vec").mapInPandas(cut, PIECES), grid, k)


def to_vectors(meta: TensorMeta, mode: int, stripes: DataFrame, k: int) -> DataFrame:
    """cluster, vec: whole centroids, each an array as long as a slice, for those who want them so."""
    grid, width = Grid(meta, mode), meta.size // meta.shape[mode]

    def rows(frames):
        for pdf in frames:
            for s, data in zip(pdf["stripe"], pdf["data"], strict=True):
                yield _frame(stripe=np.full(k, s, np.int32), cluster=np.arange(k, dtype=np.int32), data=list(np.asarray(data).reshape(k, -1)))

    def join(frames):
        cluster, vec = None, None
        for pdf in frames:
            for s, c, data in zip(pdf["stripe"], pdf["cluster"], pdf["data"], strict=True):
                if c != cluster:
                    if cluster is not None:
                        yield _frame(cluster=np.array([cluster], np.int32), vec=[vec])
                    cluster, vec = int(c), np.zeros(width)
                vec[blocks.columns(meta, mode, int(s)) if grid.rest else slice(None)] = data
        if cluster is not None:
            yield _frame(cluster=np.array([cluster], np.int32), vec=[vec])

    parts = stripes.mapInPandas(rows, PIECES).repartition("cluster").sortWithinPartitions("cluster")
    return parts.mapInPandas(join, "cluster int, vec array<double>")


def lengths(stripes: DataFrame, k: int) -> np.ndarray:
    """c.c of every centroid: k numbers."""

    def squares(frames):
        total = np.zeros(k)
        for pdf in frames:
            for data in pdf["data"]:
                x = np.asarray(data).reshape(k, -1)
                total += (x * x).sum(axis=1)
        yield _frame(cluster=np.arange(k), v=total)

    found = stripes.mapInPandas(squares, "cluster long, v double").groupBy("cluster").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k)
    for r in found:
        out[r["cluster"]] = r["v"]
    return out


def assigned(t: BlockFrame, mode: int, stripes: DataFrame, k: int) -> DataFrame:
    """row, members: the nearest centroid of each slice of a row block, ties to the lowest."""
    grid, cc = Grid(t.meta, mode), lengths(stripes, k)
    met = grid.placed(t).join(stripes.select("stripe", F.col("data").alias("c")), "stripe").select("row", "stripe", "data", "c")

    def distances(frames):
        sums = blocks._Sums(["row"])
        for pdf in frames:
            for row, stripe, data, c in zip(pdf["row"], pdf["stripe"], pdf["data"], pdf["c"], strict=True):
                x, c = grid.matrix(row, stripe, data), np.asarray(c).reshape(k, -1)
                part = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T)
                if (full := sums.add((int(row),), part.reshape(-1))) is not None:
                    yield full
        if sums.held:
            yield sums.flush()

    def nearest(frames):
        for pdf in frames:
            yield _frame(row=pdf["row"], members=[(np.asarray(d).reshape(-1, k) + cc).argmin(axis=1).astype(np.int32) for d in pdf["data"]])

    found = blocks.sum_by(met.mapInPandas(distances, "row int, data array<double>"), ["row"])
    # row blocks without any block are slices of zeros
    every = t.df.sparkSession.range(grid.rows).select(F.col("id").cast("int").alias("row"))
    size, last = t.meta.block_shape[mode], t.meta.block_final[mode]
    zeros = F.array_repeat(F.lit(0.0), F.when(F.col("row") == grid.rows - 1, last * k).otherwise(size * k))
    whole = every.join(found, "row", "left").select("row", F.coalesce("data", zeros).alias("data"))
    return whole.mapInPandas(nearest, "row int, members array<int>")


def moved(t: BlockFrame, mode: int, stripes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The means of each cluster's slices, by stripe; an empty cluster keeps its centroid."""
    grid = Grid(t.meta, mode)
    sizes = np.zeros(k)
    for r in members.select(F.explode("members").alias("c")).groupBy("c").count().collect():  # k rows
        sizes[r["c"]] = r["count"]
    met = grid.placed(t).join(members, "row").select("row", "stripe", "data", "members")

    def sums_of(frames):
        sums = blocks._Sums(["stripe"])
        for pdf in frames:
            for row, stripe, data, own in zip(pdf["row"], pdf["stripe"], pdf["data"], pdf["members"], strict=True):
                x, own = grid.matrix(row, stripe, data), np.asarray(own)
                part = (own[None, :] == np.arange(k)[:, None]).astype(float) @ x
                if (full := sums.add((int(stripe),), part.reshape(-1))) is not None:
                    yield full
        if sums.held:
            yield sums.flush()

    def means(frames):
        for pdf in frames:
            out = []
            for old, new in zip(pdf["data"], pdf["new"], strict=True):
                old = np.asarray(old).reshape(k, -1)
                new = np.zeros_like(old) if new is None else np.asarray(new).reshape(k, -1)
                out.append(np.where(sizes[:, None] > 0, new / np.maximum(sizes, 1)[:, None], old).reshape(-1))
            yield _frame(stripe=pdf["stripe"], data=out)

    found = blocks.sum_by(met.mapInPandas(sums_of, STRIPES), ["stripe"]).withColumnRenamed("data", "new")
    return stripes.join(found, "stripe", "left").select("stripe", "data", "new").mapInPandas(means, STRIPES)


def slices(meta: TensorMeta, mode: int, members: DataFrame) -> DataFrame:
    """slice, cluster."""
    grid = Grid(meta, mode)

    def spread(frames):
        for pdf in frames:
            for row, own in zip(pdf["row"], pdf["members"], strict=True):
                yield _frame(slice=np.arange(*grid.slices(row)), cluster=np.asarray(own, np.int32))

    return members.mapInPandas(spread, "slice long, cluster int")


def run(t: BlockFrame, mode: int, stripes: DataFrame, k: int, max_iter: int, early_stop: bool) -> tuple[DataFrame, DataFrame]:
    """(slice, cluster), and the centroids (cluster, vec), after at most max_iter rounds. A round's tables go when two newer ones exist."""
    t = BlockFrame(materialise(t.df, "kmeans-blocks"), t.meta)
    rounds, before, members = Rounds(t.df.sparkSession), None, None
    stripes = rounds.store(stripes, "stripes")
    for _ in range(max_iter):
        members = rounds.store(assigned(t, mode, stripes, k), "members")
        now = members.agg(F.sum(F.xxhash64("row", "members").cast("decimal(38,0)"))).first()[0]
        stripes = rounds.store(moved(t, mode, stripes, members, k), "stripes")
        if early_stop and now == before:
            break
        before = now
    if members is None:
        members = assigned(t, mode, stripes, k)
    out = materialise(slices(t.meta, mode, members), "members"), materialise(to_vectors(t.meta, mode, stripes, k), "centroids")
    rounds.free()
    return out

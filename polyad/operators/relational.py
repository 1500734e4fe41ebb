"""Tensor algebra over cells, as joins and aggregations that Catalyst plans.

A factor table has columns i, r, v. A factor is broadcast when its cells are fewer than BROADCAST_CELLS (24 bytes each); a larger
one is joined by shuffle on the index.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..functions.index import l2_norm, linear, modes, sub_indices
from ..meta import TensorMeta

BROADCAST_CELLS = 2_000_000
#: Cells of a fibre whose products with each other one row of a Gram matrix's plan makes.
TILE = 1024


def factor_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """Cells (i, r, v) of a local matrix."""
    rows, cols = matrix.shape
    i, r = np.divmod(np.arange(rows * cols), cols)
    return spark.createDataFrame(pd.DataFrame({"i": i, "r": r, "v": np.asarray(matrix, float).reshape(-1)}), "i long, r long, v double")


def factor_matrix(table: DataFrame, rows: int, cols: int) -> np.ndarray:
    out, cells = np.zeros((rows, cols)), table.select("i", "r", "v").toArrow()
    out[np.asarray(cells["i"]), np.asarray(cells["r"])] = np.asarray(cells["v"])
    return out


def transposed(factor: DataFrame) -> DataFrame:
    return factor.select(F.col("r").alias("i"), F.col("i").alias("r"), "v")


def small(df: DataFrame, cells: int) -> DataFrame:
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


# reshapes


def cyclic(meta: TensorMeta, mode: int) -> list[int]:
    """Modes that make up the columns of the mode-n matricization, the fastest first: n+1, ..., N-1, 0, ..., n-1."""
    return [(mode + j) % meta.ndim for j in range(1, meta.ndim)]


def unfold(t: TensorFrame, mode: int) -> DataFrame:
    """row, col, v of the mode-n matricization. A projection: no shuffle."""
    rest = cyclic(t.meta, mode)
    return t.df.select(F.col(f"i{mode}").alias("row"), linear([f"i{m}" for m in rest], [t.meta.shape[m] for m in rest]).alias("col"), "v")


def refold(cells: DataFrame, mode: int, meta: TensorMeta) -> TensorFrame:
    """The tensor of which `cells` (row, col, v) is the mode-n matricization."""
    rest = cyclic(meta, mode)
    at = dict(zip(rest, sub_indices(F.col("col"), [meta.shape[m] for m in rest]), strict=True)) | {mode: F.col("row").cast("long")}
    return TensorFrame(cells.select(*[at[m].alias(f"i{m}") for m in range(meta.ndim)], "v"), meta)


def row_vectors(t: TensorFrame, mode: int) -> DataFrame:
    """row, vec: each slice as a dense array, columns in matricization order."""
    width = t.meta.size // t.meta.shape[mode]
    cells = F.array_sort(F.collect_list(F.struct("col", "v")))
    got = unfold(t.zero_filled(), mode).groupBy("row").agg(cells.alias("cells"))
    assert width
    return got.select("row", F.transform("cells", lambda c: c["v"]).alias("vec"))


def slice_row(t: TensorFrame, mode: int, k: int) -> DataFrame:
    return unfold(t, mode).where(F.col("row") == k)


def row_norms(t: TensorFrame, mode: int) -> DataFrame:
    """row, norm of every slice that has a cell."""
    return t.df.groupBy(F.col(f"i{mode}").alias("row")).agg(l2_norm(F.col("v")).alias("norm"))


def norm_squared(t: TensorFrame) -> float:
    return float(t.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)


# products


def mode_n_product(t: TensorFrame, mode: int, factor: DataFrame, rank: int) -> TensorFrame:
    """Y[.., r, ..] = sum over i of T[.., i, ..] * B[i, r], for the factor's cells (i, r, v)."""
    names, b = t.index, small(factor, t.meta.shape[mode] * rank).select(F.col("i").alias("bi"), F.col("r").alias("br"), F.col("v").alias("bv"))
    joined = t.df.join(b, F.col(names[mode]) == F.col("bi"))
    kept = [F.col("br").alias(c) if m == mode else F.col(c) for m, c in enumerate(names)]
    summed = joined.groupBy(*kept).agg(F.sum(F.col("v") * F.col("bv")).alias("v"))
    return TensorFrame(summed, t.meta.replace(mode, rank))


def by_shrinkage(t: TensorMeta, ranks: Mapping[int, int]) -> list[int]:
    """Modes in the order in which products are cheapest: those that shrink the tensor most come first."""
    return sorted(ranks, key=lambda m: (ranks[m] / t.shape[m], m))


def mode_n_products(t: TensorFrame, factors: Mapping[int, tuple[DataFrame, int]], order: Sequence[int] | None = None) -> TensorFrame:
    """Products in several modes one after the other; factors: mode to (cells, rank). No factor: the tensor itself."""
    for m in order if order is not None else by_shrinkage(t.meta, {m: r for m, (_, r) in factors.items()}):
        t = mode_n_product(t, m, *factors[m])
    return t


def mode_n_products_fused(t: TensorFrame, factors: Mapping[int, tuple[DataFrame, int]]) -> TensorFrame:
    """All products in one aggregation: each cell meets all factors first. One shuffle, but a row for each cell and combination of ranks."""
    df, meta, value = t.df, t.meta, F.col("v")
    for m, (factor, rank) in factors.items():
        b = small(factor, meta.shape[m] * rank).select(F.col("i").alias(f"fi{m}"), F.col("r").alias(f"fr{m}"), F.col("v").alias(f"fv{m}"))
        df = df.join(b, F.col(f"i{m}") == F.col(f"fi{m}"))
        value = value * F.col(f"fv{m}")
        meta = meta.replace(m, rank)
    kept = [F.col(f"fr{m}").alias(f"i{m}") if m in factors else F.col(f"i{m}") for m in range(meta.ndim)]
    return TensorFrame(df.groupBy(*kept).agg(F.sum(value).alias("v")), meta)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells (i, r, v) of the product of two matrices given by their cells (i, r, v)."""
    right = b.select(F.col("i").alias("k"), F.col("r").alias("c"), F.col("v").alias("w"))
    return a.join(right, F.col("r") == F.col("k")).groupBy("i", F.col("c").alias("r")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def project_onto(a: DataFrame, b: DataFrame, transpose: bool = False) -> DataFrame:
    """B A, or B A^T."""
    return matmul(b, transposed(a) if transpose else a)


def tile_pairs(cells: DataFrame, others: Sequence[str], mode_col: str, extent: int) -> DataFrame:
    """others, xs, ys, one of pairs of tiles of a fibre: arrays of (i, v) of which all products are wanted, or with `one` (a tile with itself) those of xs <= ys.

    A fibre (the cells that agree in `others`) of at most TILE cells is one tile. A longer one is dealt to tiles of about TILE cells, and each
    pair of its tiles is a row with a key of its own, so a fibre that holds most of the tensor spreads over many tasks.
    """
    others = list(others)
    cell = F.struct(F.col(mode_col).alias("i"), "v")
    # the work is the square of the bytes, so partitions must not be put together by their bytes, as adaptive plans do unless told a number
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_by = lambda df, *keys: df.repartition(tasks, *keys) if keys else df
    if extent <= TILE:
        packs = dealt_by(cells, *others).groupBy(*others).agg(F.collect_list(cell).alias("xs"))
        return packs.select(*others, "xs", F.col("xs").alias("ys"), F.lit(True).alias("one"))
    if others:
        long = cells.groupBy(*others).count().where(F.col("count") > TILE).select(*others, F.ceil(F.col("count") / TILE).cast("int").alias("_tiles"))
        dealt = cells.join(long, others, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    else:
        dealt = cells.withColumn("_tiles", F.lit(-(-extent // TILE)))
    packs = dealt.groupBy(*others, "_tiles", F.pmod(F.xxhash64(mode_col), F.col("_tiles")).cast("int").alias("_own")).agg(F.collect_list(cell).alias("xs"))
    sent = packs.select("*", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"))
    keyed = sent.select(*others, F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"), "_own", "xs")
    met = dealt_by(keyed, *others, "_p", "_q").groupBy(*others, "_p", "_q").agg(F.max_by("xs", -F.col("_own")).alias("xs"), F.max_by("xs", "_own").alias("ys"), F.count("*").alias("_n"))  # two rows at most
    return met.where("_p = _q OR _n = 2").select(*others, "xs", "ys", (F.col("_p") == F.col("_q")).alias("one"))


def gram(t: TensorFrame, mode: int, by: Sequence[str] = ()) -> DataFrame:
    """r, c, v of the uncentred Gram matrix of the mode-n matricization, from the pairs r <= c of each fibre and their mirror.

    by: columns that keep apart several tensors in one table; a matrix for each. No join of the cells: fibres are packed, and products
    are summed by task before they are shuffled.
    """
    pairs = tile_pairs(t.df, [*by, *t.others(mode)], f"i{mode}", t.meta.shape[mode])
    spread = pairs.select(*by, "ys", "one", F.explode("xs").alias("x")).select(*by, "one", "x", F.explode("ys").alias("y")).where("NOT one OR x.i <= y.i")
    half = spread.groupBy(*by, F.least("x.i", "y.i").alias("r"), F.greatest("x.i", "y.i").alias("c")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("v"))
    both = F.when(F.col("r") == F.col("c"), F.array(F.struct("r", "c"))).otherwise(F.array(F.struct("r", "c"), F.struct(F.col("c").alias("r"), F.col("r").alias("c"))))
    return half.select(*by, F.explode(both).alias("e"), "v").select(*by, "e.r", "e.c", "v")


def gram_of_groups(t: TensorFrame, mode: int, group: Column, extent: int) -> DataFrame:
    """r, c, v: the entries of the mode-n Gram matrix, summed by groups of its rows and columns. group: the group (below extent) of a slice.

    With S the matrix of ones where a slice belongs to a group, S (X X^T) S^T = (S X) (S X)^T: the slices of a group are added up first, so what is
    shuffled is the cells once, and the square is that of the groups alone.
    """
    kept = [group.cast("long").alias(c) if m == mode else F.col(c) for m, c in enumerate(t.index)]
    return gram(TensorFrame(t.df.groupBy(*kept).agg(F.sum("v").alias("v")), t.meta.replace(mode, extent)), mode)


# slices and clusters


def membership(df: DataFrame, slice_col: str = "slice", cluster_col: str = "cluster") -> DataFrame:
    """slice, cluster, pos: the place of each slice within its cluster, by slice number."""
    w = Window.partitionBy(cluster_col).orderBy(slice_col)
    return df.select(F.col(slice_col).alias("slice"), F.col(cluster_col).cast("int").alias("cluster"), (F.row_number().over(w) - 1).cast("long").alias("pos"))


def gather(t: TensorFrame, members: DataFrame, mode: int) -> DataFrame:
    """cluster and the cells of each cluster's sub-tensor: its member slices along a mode, numbered densely in order."""
    names = t.index
    placed = small(membership(members), 3 * t.meta.shape[mode])
    kept = [F.col("pos").alias(c) if m == mode else F.col(c) for m, c in enumerate(names)]
    return t.df.join(placed, F.col(names[mode]) == F.col("slice")).select("cluster", *kept, "v")


def cluster_sizes(members: DataFrame, k: int) -> DataFrame:
    """cluster, size for all k clusters; an empty one has 0."""
    found = members.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("size"))
    ids = members.sparkSession.range(k).select(F.col("id").alias("cluster"))
    return ids.join(F.broadcast(found), "cluster", "left").select(F.col("cluster").cast("int").alias("cluster"), F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def members_of(members: DataFrame) -> DataFrame:
    """cluster, slices (sorted)."""
    return members.groupBy("cluster").agg(F.array_sort(F.collect_list("slice")).alias("slices"))


def cluster_meta(meta: TensorMeta, mode: int, size: int) -> TensorMeta:
    """Metadata of a cluster's sub-tensor: the block extent of the mode is at most the cluster's size."""
    return meta.replace(mode, size, min(size, meta.block_shape[mode]))


def cluster(gathered: DataFrame, c: int, meta: TensorMeta) -> TensorFrame:
    return TensorFrame(gathered.where(F.col("cluster") == c).drop("cluster"), meta)


def union_clusters(parts: Mapping[int, TensorFrame]) -> DataFrame:
    """The cells of several tensors with their cluster number."""
    out = None
    for c, t in parts.items():
        part = t.df.select(F.lit(c).cast("int").alias("cluster"), *modes(t.meta.ndim), "v")
        out = part if out is None else out.unionByName(part)
    return out


def best(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")

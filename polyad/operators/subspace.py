"""Leading singular vectors of matrices of which neither the Gram matrix nor a factor fits the driver.

A matrix is a table of cells (row, col, v) or of dense rows (k, x). tree_r() is a tall QR: every task reduces its rows to a triangle, and
triangles are stacked and reduced again in a tree, so what a task or the driver holds is width squared, whatever the number of rows. With few columns
that gives the left vectors at once; else block subspace iteration does, whose blocks are tables of rows as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..storage import Rounds, materialise
from . import relational

#: Triangles that are stacked by one task; columns up to which a matrix is reduced to one triangle; extra columns of the iteration's block.
FAN, NARROW, EXTRA = 16, 1024, 8
#: Values of a product that a task makes at once.
HELD = 1_000_000
TRIANGLES = "cluster int, part long, width int, r array<double>"
ROWS = "k long, x array<double>"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, float).reshape(-1)))


def _triangle(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x if held is None else np.vstack([held, x]), mode="r")


def tree_r(rows: DataFrame) -> dict[int, np.ndarray]:
    """R with R^T R = X^T X, of the rows x of each cluster in (cluster, x); x is as long in all rows of a cluster. Without rows: none."""

    def local(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                held[c] = _triangle(held.get(c), matrix(batch.column("x").filter(pa.array(cluster == c))))
        context = TaskContext.get()
        for c, r in held.items():
            yield _triangle_row(c, context.partitionId() if context else 0, r)

    def merge(key, table):
        held = None
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            held = _triangle(held, np.asarray(r["r"]).reshape(-1, r["width"]))
        return pa.Table.from_batches([_triangle_row(key[0].as_py(), key[1].as_py(), held)])

    level = materialise(rows.select(F.col("cluster").cast("int").alias("cluster"), "x").mapInArrow(local, TRIANGLES), "triangles")
    while level.agg(F.max("part")).first()[0]:
        level = materialise(level.withColumn("part", F.expr(f"part div {FAN}")).groupBy("cluster", "part").applyInArrow(merge, TRIANGLES), "triangles")
    return {r["cluster"]: np.asarray(r["r"]).reshape(-1, r["width"]) for r in level.collect()}  # a triangle for each cluster


def _triangle_row(cluster: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"cluster": pa.array([cluster], pa.int32()), "part": [part], "width": pa.array([r.shape[1]], pa.int32()), "r": pa.array([r.reshape(-1)])})


def right_vectors(r: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, descending and above rounding, and right vectors (columns) of the rows behind a triangle."""
    if r is None:
        return np.empty(0), np.empty((width, 0))
    _, s, v = np.linalg.svd(r, full_matrices=False)
    kept = s > s.max(initial=0) * max(width, 8) * np.finfo(float).eps
    return s[kept], v[kept].T


def turned(rows: DataFrame, by: np.ndarray) -> DataFrame:
    """k, x times a local matrix: map-only."""

    def turn(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), lists(matrix(b.column("x")) @ by) if len(b) else b.column("x")], ["k", "x"])

    return rows.select("k", "x").mapInArrow(turn, ROWS)


@dataclass(frozen=True)
class Wide:
    """A factor matrix as stored rows (k, x); rows that are not there are zero."""

    rows: DataFrame
    shape: tuple[int, int]

    @property
    def size(self) -> int:
        return self.shape[0] * self.shape[1]

    def table(self) -> DataFrame:
        """i, r, v."""
        return self.rows.select(F.col("k").alias("i"), F.posexplode("x").alias("r", "v")).select("i", F.col("r").cast("long").alias("r"), "v")

    def local(self) -> np.ndarray:
        """For small ones."""
        out, found = np.zeros(self.shape), self.rows.toArrow()
        if len(found):
            out[found.column("k").to_numpy()] = matrix(found.column("x"))
        return out


def _finished(rows: DataFrame, n: int, rank: int) -> Wide:
    """Columns with their largest entry positive; columns beyond the matrix's own rank are zero."""
    picked = rows.agg(*[F.max_by(F.col("x")[j], F.abs(F.col("x")[j])).alias(f"p{j}") for j in range(rank)]).first()  # rank values
    signs = np.diag([-1.0 if p is not None and p < 0 else 1.0 for p in picked])
    return Wide(materialise(turned(rows, signs), "basis"), (n, rank))


def _padded(v: np.ndarray, rank: int) -> np.ndarray:
    return np.hstack([v, np.zeros((len(v), rank - v.shape[1]))]) if v.shape[1] < rank else v[:, :rank]


def dense_rows(cells: DataFrame, width: int) -> DataFrame:
    """k, x of every row that has a cell, from (row, col, v)."""

    def fill(batches):
        for b in batches:
            x = np.zeros((len(b), width))
            at = b.column("at")
            places = np.repeat(np.arange(len(b)), np.diff(np.asarray(at.offsets)))
            x[places, at.flatten().to_numpy()] = b.column("v").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("k"), lists(x)], ["k", "x"])

    return cells.groupBy(F.col("row").alias("k")).agg(F.collect_list("col").alias("at"), F.collect_list("v").alias("v")).mapInArrow(fill, ROWS)


def by_columns(rows: DataFrame, n: int, rank: int, width: int) -> Wide:
    """Leading left vectors of a matrix of few columns, from its dense rows (k, x): one triangle, then a map."""
    rows = materialise(rows, "rows")
    s, v = right_vectors(tree_r(rows.select(F.lit(0).alias("cluster"), "x")).get(0), width)
    return _finished(turned(rows, _padded(v / s, rank)), n, rank)


def _times(cells: DataFrame, block: DataFrame, on: str, to: str, width: int) -> DataFrame:
    """k, x: the matrix, or its transpose, times a block of `width` columns given by its rows. Sums are made by task before they are shuffled."""
    joined = cells.join(block, F.col(on) == F.col("k"))
    sums = joined.groupBy(F.col(to).alias("t")).agg(*[F.sum(F.col("v") * F.col("x")[j]).alias(f"s{j}") for j in range(width)])
    return sums.select(F.col("t").alias("k"), F.array(*[f"s{j}" for j in range(width)]).alias("x"))


def projected(t: TensorFrame, mode: int, basis: Wide) -> TensorFrame:
    """The product in a mode with a factor in rows: a cell meets its slice's whole row, and sums are made by task before they are shuffled."""
    sums = _times(relational.unfold(t, mode), relational.small(basis.rows, basis.size), "row", "col", basis.shape[1])
    cells = sums.select(F.col("k").alias("col"), F.posexplode("x").alias("row", "v")).where("v IS NOT NULL")
    return relational.refold(cells, mode, t.meta.replace(mode, basis.shape[1]))


def expanded(core: TensorFrame, mode: int, basis: Wide) -> TensorFrame:
    """The product in a mode with a factor in rows, transposed: from a core, the tensor of as many slices as the factor has rows.

    A core of at most relational.BROADCAST_CELLS cells (by its extents) is fetched and goes with the function: every row of the factor makes its slice, in the columns where the
    core has cells, without an exchange or a sum. A larger one is joined.
    """
    meta = core.meta.replace(mode, basis.shape[0])
    if core.meta.size > relational.BROADCAST_CELLS:
        return relational.mode_n_product(core, mode, relational.transposed(basis.table()), basis.shape[0])
    found = relational.unfold(core, mode).toArrow()
    col, place = np.unique(found.column("col").to_numpy(), return_inverse=True)
    by = np.zeros((basis.shape[1], len(col)))
    by[found.column("row").to_numpy(), place] = found.column("v").to_numpy()
    step = max(1, HELD // max(1, len(col)))

    def spread(batches):
        for batch in batches:
            for b in (batch.slice(start, step) for start in range(0, len(batch) if len(col) else 0, step)):
                y = matrix(b.column("x")) @ by
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("k").to_numpy(), len(col))), pa.array(np.tile(col, len(b))), pa.array(y.reshape(-1))], ["row", "col", "v"])

    return relational.refold(basis.rows.select("k", "x").mapInArrow(spread, "row long, col long, v double"), mode, meta)


def _residuals(q: DataFrame, y: DataFrame, v: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Norms of G u - value u for the columns u of q v, where y = G q. Formed row by row, so that small ones are exact."""

    def squares(batches):
        total = np.zeros(v.shape[1])
        for b in batches:
            if len(b):
                total += ((matrix(b.column("y")) @ v - (matrix(b.column("x")) @ v) * values) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(total)), "v": total})

    joined = q.join(y.select("k", F.col("x").alias("y")), "k").select("x", "y")
    sums = joined.mapInArrow(squares, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(v.shape[1])
    for r in sums:
        out[r["at"]] = np.sqrt(r["v"])
    return out


def by_iteration(cells: DataFrame, n: int, rank: int, eps: float = 1e-10, max_iter: int = 200, seed: int = 0) -> Wide:
    """Leading left vectors of a matrix (row, col, v) of any extents, by block subspace iteration on the Gram matrix, which is never formed.

    Per step: the transposed matrix and then the matrix times the block, each a join and a summed exchange, and a tall QR of the result. It ends
    when every wanted vector is an eigenvector up to eps times the largest eigenvalue, or after max_iter steps.
    """
    cells, width = materialise(cells.select("row", "col", "v"), "matrix"), rank + EXTRA
    noise = [(F.xxhash64("k", F.lit(j), F.lit(seed)) / float(1 << 63)).alias(f"s{j}") for j in range(width)]
    q = cells.select(F.col("row").alias("k")).distinct().select("k", F.array(*noise).alias("x"))
    rounds, turn = Rounds(q.sparkSession), None
    q, width = _orthonormal(rounds.store(q, "start"), rounds)
    for _ in range(max_iter if width else 0):
        z = rounds.store(_times(cells, q, "row", "col", width), "z")
        y = rounds.store(_times(cells, z, "col", "row", width), "y")
        s, v = right_vectors(tree_r(z.select(F.lit(0).alias("cluster"), "x")).get(0), width)
        now, turn, values = q, v[:, :rank], s[:rank] ** 2
        if not len(values) or (_residuals(q, y, turn, values) <= eps * values[0]).all():
            break
        q, width = _orthonormal(y, rounds)
    if turn is None:
        return Wide(q.select("k", F.array(*[F.lit(0.0)] * rank).alias("x")), (n, rank))
    out = _finished(turned(now, _padded(turn, rank)), n, rank)
    rounds.free()
    return out


def _orthonormal(rows: DataFrame, rounds: Rounds) -> tuple[DataFrame, int]:
    """Stored rows of an orthonormal basis of the same column space, and its dimension."""
    r = tree_r(rows.select(F.lit(0).alias("cluster"), "x")).get(0)
    s, v = right_vectors(r, r.shape[1] if r is not None else 0)
    return (rounds.store(turned(rows, v / s), "q") if len(s) else rows), len(s)

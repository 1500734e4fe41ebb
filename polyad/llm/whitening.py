"""Embedding whitening by hierarchical SVD merging.

Each vector becomes whole numbers x = floor(256 c). Each distinct x counts once in the fit. A task keeps, of the vectors it has seen, their number,
exact sums, and the full-rank singular values and vectors of the centred matrix; a batch of rows is taken in by an SVD of the
scaled vectors so far, the batch less its own mean, and one mean-correction row. Summaries of tasks are merged in a tree of FAN the same way:
both sides' scaled singular vectors and the row sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2) are stacked and decomposed anew. The stacked matrix
has the Gram matrix of all centred rows, and no dimension is cut off, so the merge loses nothing.

Defined cases: a vector that is null, empty, or holds a null, NaN or infinite entry gives no row; entries beyond 64 bits are the largest or smallest
long; vectors of another length than the most frequent one (the longer of equally frequent ones) give no row; a null id keeps its rows; repeated rows each report
and count once in the fit; a direction without variance is no component, so one distinct vector, or none, gives no rows; a deviation beyond
64 bits is null; an empty table gives an empty result; other columns are not read.

Scale: one scan for the usual length, one exchange of distinct vectors (repeats are taken out before it, so a frequent one is no hot key), then stored
summaries of at most (dimensions + 1) x dimensions values for each task, in log(tasks) small steps. Only the last summary and the covariance of the
components reach the driver: their size depends on the dimensions alone. Scoring is map-only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, task_id

#: Components that are returned, rows taken in by one SVD, and summaries that are merged by one task.
COMPONENTS, BATCH, FAN = 4, 4096, 16
SUMMARY = "part long, n long, total array<decimal(38,0)>, s array<double>, v array<double>"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LONG = 2**63 - 1


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of whole numbers."""
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) * len(x) > LONG:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)]


@dataclass(frozen=True)
class Summary:
    """n rows, the exact sums of their columns, and the full-rank singular values and right vectors of the centred matrix."""

    n: int
    total: list[int]
    s: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of rows of whole numbers."""
        total = column_sums(x)
        centred = x - np.array([t / len(x) for t in total])
        return cls(len(x), total, *np.linalg.svd(centred, full_matrices=False)[1:])

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.total, other.total, strict=True)])
        stacked = np.vstack([self.s[:, None] * self.v, other.s[:, None] * other.v, sqrt(self.n * other.n / n) * apart])
        return Summary(n, [a + b for a, b in zip(self.total, other.total, strict=True)], *np.linalg.svd(stacked, full_matrices=False)[1:])

    def row(self, part: int) -> pa.RecordBatch:
        total = pa.array([[Decimal(t) for t in self.total]], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([self.n]), total, pa.array([self.s]), pa.array([self.v.reshape(-1)])], ["part", "n", "total", "s", "v"])

    @classmethod
    def from_row(cls, r) -> Summary:
        return cls(int(r["n"]), [int(t) for t in r["total"]], np.asarray(r["s"], float), np.asarray(r["v"], float).reshape(len(r["s"]), -1))

    # the components

    @property
    def rank(self) -> int:
        """Directions with variance: singular values above what rounding leaves of a zero."""
        return int((self.s > self.s.max(initial=0) * len(self.total) * 16 * np.finfo(float).eps).sum())

    def components(self, k: int) -> np.ndarray:
        """The first k unit eigenvectors of the covariance as rows, each with its largest entry positive."""
        v = self.v[: min(k, self.rank)].copy()
        v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        return v

    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.total])

    def variances(self) -> np.ndarray:
        return self.s**2 / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the columns of (n x - total)^2, exact; None beyond 64 bits."""
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.total))
        kind = np.int64 if most * most * x.shape[1] <= LONG else object
        apart = self.n * x.astype(kind) - np.array(self.total, kind)
        return [v if v <= LONG else None for v in map(int, (apart * apart).sum(axis=1))]


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x of vectors without null or non-finite entries."""
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return given.where(F.col("c").isNotNull() & (F.size("c") > 0) & ~bad).select("vec_id", F.transform("c", lambda c: F.floor(256 * c).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, len(b), BATCH):
            yield _matrix(b.column(name).slice(at, BATCH))


def summarise(fit: DataFrame) -> Summary | None:
    """The summary of all rows of a stored table with a column x of whole numbers; None if it is empty."""

    def of_task(batches):
        held = None
        for x in _batches(batches, "x"):
            new = Summary.of(x)
            held = held.merge(new) if held else new
        if held:
            yield held.row(task_id())

    def merged(key, table):
        held = None
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            held = held.merge(Summary.from_row(r)) if held else Summary.from_row(r)
        return pa.Table.from_batches([held.row(key[0].as_py())])

    level = materialise(fit.select("x").mapInArrow(of_task, SUMMARY), "svd")
    while level.agg(F.max("part")).first()[0]:
        level = materialise(level.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(merged, SUMMARY), "svd")
    top = level.first()
    return Summary.from_row(top) if top else None


def fit(rows: DataFrame) -> tuple[DataFrame, Summary] | None:
    """Of vec_id, x: the stored distinct vectors of the usual length, and their summary. None without a vector."""
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return None
    distinct = materialise(rows.where(F.size("x") == usual["d"]).select("x").distinct(), "distinct-vectors")
    return distinct, summarise(distinct)


def project(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes.T


def identity_error(distinct: DataFrame, mean: np.ndarray, axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity; axes: components over the square roots of their variances."""
    k = len(axes)

    def moments(batches):
        n, first, second = 0, np.zeros(k), np.zeros((k, k))
        for x in _batches(batches, "x"):
            w = project(x, mean, axes)
            n, first, second = n + len(w), first + w.sum(axis=0), second + w.T @ w
        values = np.concatenate([[n], first, second.reshape(-1)])
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(values)), "v": values})

    sums = {r["at"]: r["v"] for r in distinct.select("x").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}  # 1 + k + k * k rows
    values = np.array([sums[i] for i in range(1 + k + k * k)])
    n, first, second = values[0], values[1 : 1 + k], values[1 + k :].reshape(k, k)
    return float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error of every vector."""
    rows = whole(vectors, id_col, vector_col)
    found = fit(rows)
    k = min(components, found[1].rank) if found else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    distinct, model = found
    mean, variances = model.mean(), model.variances()
    axes = model.components(k) / np.sqrt(variances[:k])[:, None]
    explained, error = variances[:k] / variances.sum(), identity_error(distinct, mean, axes)
    d = len(mean)

    def score(batches):
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.slice(at, BATCH)
                x = _matrix(part.column("x"))
                ids = np.repeat(np.arange(len(x)), k)
                columns = [part.column("vec_id").take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(ids), model.n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(ids)), pa.array(project(x, mean, axes).reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(ids), error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(score, WHITENED)

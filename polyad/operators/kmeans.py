"""k-means of a tensor's slices along a mode.

Slices are dense rows while the k centroids hold at most CENTROID_VALUES values: the centroids are broadcast, and a round is one pass over
the rows that shuffles only the tasks' sums by cluster and column. Tensors in dense blocks, and those of longer centroids, go by stripes of
columns (stripes.py), with centroids of any length. Rows (run_rows) of which the centroids are too long are cells, joined by column, whose distances are summed
by task before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import BlockFrame, TensorFrame
from ..functions.index import squared_distance
from ..storage import materialise
from . import stripes
from .relational import BROADCAST_CELLS, best, row_vectors, unfold

#: All centroids together are broadcast up to so many values (16 MB).
CENTROID_VALUES = BROADCAST_CELLS


@dataclass(frozen=True)
class KMeans:
    """k clusters; init: "first" rows, "random" rows by a seed, or "given" centroids; stops early when no slice moves."""

    k: int
    max_iter: int = 20
    init: str = "first"
    seed: int = 0
    early_stop: bool = True

    def __post_init__(self):
        if self.k < 1 or self.max_iter < 0:
            raise ValueError("k is 1 at least, max_iter 0 at least")
        if self.init not in ("first", "random", "given"):
            raise ValueError("init is first, random or given")

    def start(self, rows: DataFrame, given: DataFrame | None = None) -> DataFrame:
        """cluster, vec of the first centroids, from rows (row, vec)."""
        if self.init == "given":
            if given is None:
                raise ValueError("no centroids given")
            return given.select(F.col("cluster").cast("int").alias("cluster"), "vec")
        order = F.col("row") if self.init == "first" else F.xxhash64(F.col("row"), F.lit(self.seed))
        found = rows.orderBy(order, "row").limit(self.k).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "row", "vec"))).alias("c"))
        return found.select(F.posexplode("c").alias("cluster", "c")).select("cluster", "c.vec")

    def run(self, t: TensorFrame | BlockFrame, mode: int = 0, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(slice, cluster) of every slice along the mode, and the centroids (cluster, vec)."""
        if isinstance(t, BlockFrame):
            return self.run_blocks(t, mode, given)
        if self.k * (t.meta.size // t.meta.shape[mode]) <= CENTROID_VALUES:
            return self.run_rows(row_vectors(t, mode), given)
        return self.run_blocks(t.to_blocks(), mode, given)

    def run_blocks(self, t: BlockFrame, mode: int = 0, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The same for dense blocks, with centroids of any length: by stripes of columns."""
        spark, k = t.df.sparkSession, min(self.k, t.meta.shape[mode])
        if self.init == "given":
            if given is None:
                raise ValueError("no centroids given")
            k = self.k
            start = stripes.from_vectors(t.meta, mode, given.select(F.col("cluster").cast("int").alias("cluster"), "vec"), k)
        else:
            order = F.col("id") if self.init == "first" else F.xxhash64(F.col("id"), F.lit(self.seed))
            chosen = [r["id"] for r in spark.range(t.meta.shape[mode]).orderBy(order, "id").limit(k).collect()]  # k numbers
            start = stripes.from_slices(t, mode, chosen)
        return stripes.run(t, mode, start, k, self.max_iter, self.early_stop)

    def run_rows(self, rows: DataFrame, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The same for rows (row, vec) of equal length. The centroids are broadcast, rows never move; centroids that are too long go by cells."""
        rows = materialise(rows, "kmeans-rows")
        centroids, before = materialise(self.start(rows, given), "centroids"), None
        if (centroids.agg(F.sum(F.size("vec"))).first()[0] or 0) > CENTROID_VALUES:
            return self.run_cells(rows.select("row", F.posexplode("vec").alias("col", "v")), centroids)
        last = centroids
        for _ in range(self.max_iter):
            sums = materialise(_sums(assigned(rows, centroids)), "sums")
            last, centroids = centroids, materialise(_moved(sums, centroids), "centroids")
            now = sums.agg(F.sum("who")).first()[0]
            if self.early_stop and now == before:
                break
            before = now
        return materialise(assign(rows, last), "members"), centroids

    def run_cells(self, cells: DataFrame, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The same for rows as cells (row, col, v) with no cell left out, without a hint to broadcast centroids; only the returned centroids are arrays as long as a row."""
        cells = materialise(cells.select("row", F.col("col").cast("long").alias("col"), "v"), "kmeans-cells")
        if self.init == "given" or given is not None:
            if given is None:
                raise ValueError("no centroids given")
            first = given.select(F.col("cluster").cast("int").alias("cluster"), F.posexplode("vec").alias("col", "v"))
        else:
            order = F.col("row") if self.init == "first" else F.xxhash64(F.col("row"), F.lit(self.seed))
            found = cells.select("row").distinct().orderBy(order, "row").limit(self.k).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "row"))).alias("c"))
            chosen = found.select(F.posexplode("c").alias("cluster", "c")).select("cluster", "c.row")  # k rows
            first = cells.join(F.broadcast(chosen), "row").select("cluster", "col", "v")
        centroids = materialise(first.select("cluster", F.col("col").cast("long").alias("col"), "v"), "centroids")
        members, before = None, None
        for _ in range(max(1, self.max_iter)):
            members = materialise(nearest(_distances(cells, centroids, [])), "members")
            if self.max_iter == 0:
                break
            means = cells.join(members, cells["row"] == members["slice"]).groupBy("cluster", "col").agg(F.avg("v").alias("mean"))
            moved = centroids.join(means, ["cluster", "col"], "left").select("cluster", "col", F.coalesce("mean", "v").alias("v"))
            centroids = materialise(moved, "centroids")
            now = members.agg(F.sum(_who("slice"))).first()[0]
            if self.early_stop and now == before:
                break
            before = now
        packed = centroids.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda c: c["v"]).alias("vec"))
        return members, packed


def _who(row: str) -> Column:
    """A number for a row and its cluster; sums of them differ when a row moves."""
    return F.xxhash64(row, "cluster").cast("decimal(38,0)")


def _distances(cells: DataFrame, centroids: DataFrame, more: list[Column]) -> DataFrame:
    """row, cluster, ..., d from cells (row, col, v) and centroid cells (cluster, col, v). Centroids are broadcast only if Catalyst finds them small."""
    joined = cells.join(centroids.select("cluster", "col", F.col("v").alias("w")), "col")
    return joined.groupBy("row", "cluster", *more).agg(F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("d"))


def partial_distances(t: TensorFrame, centroids: DataFrame, mode: int, chunk: int) -> DataFrame:
    """row, cluster, chunk, d: squared distances over chunks of columns, from cells and centroid cells (cluster, col, v)."""
    return _distances(unfold(t.zero_filled(), mode), centroids, [F.floor(F.col("col") / chunk).alias("chunk")])


def full_distances(partial: DataFrame) -> DataFrame:
    return partial.groupBy("row", "cluster").agg(F.sum("d").alias("d"))


def distances(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """row, cluster, d: squared distances of all rows to all k centroids, which are one array (of at most CENTROID_VALUES values in run_rows)."""
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "vec"))).alias("cs"))
    return rows.join(F.broadcast(packed)).select("row", F.explode("cs").alias("c"), "vec").select("row", "c.cluster", squared_distance(F.col("vec"), F.col("c.vec")).alias("d"))


def assigned(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """row, vec, cluster of least distance, ties to the lowest cluster. Map-only: every row scans the broadcast array of centroids."""
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "vec"))).alias("cs"))
    ranked = F.array_min(F.transform("cs", lambda c: F.struct(squared_distance(F.col("vec"), c["vec"]).alias("d"), c["cluster"].alias("cluster"))))
    return rows.join(F.broadcast(packed)).select("row", "vec", ranked["cluster"].cast("int").alias("cluster"))


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """slice, cluster of least distance."""
    return assigned(rows, centroids).select(F.col("row").alias("slice"), "cluster")


def nearest(d: DataFrame) -> DataFrame:
    """slice, cluster from a distance table (row, cluster, d)."""
    return best(d, "row", [F.col("d"), F.col("cluster")]).select(F.col("row").alias("slice"), F.col("cluster").cast("int").alias("cluster"))


def _sums(placed: DataFrame) -> DataFrame:
    """cluster, col, mean, who of rows (row, vec, cluster): one shuffle, of the tasks' sums; who is set at the first column."""
    spread = placed.select("row", "cluster", F.posexplode("vec").alias("col", "v"))
    return spread.groupBy("cluster", "col").agg(F.avg("v").alias("mean"), F.sum(F.when(F.col("col") == 0, _who("row"))).alias("who"))


def _moved(sums: DataFrame, centroids: DataFrame) -> DataFrame:
    """The new centroids; an empty cluster keeps its own."""
    new = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "mean"))), lambda c: c["mean"]).alias("new"))
    return centroids.join(new, "cluster", "left").select(F.col("cluster").cast("int").alias("cluster"), F.coalesce("new", "vec").alias("vec"))


def update(rows: DataFrame, members: DataFrame, centroids: DataFrame) -> DataFrame:
    """Means of each cluster's rows; an empty cluster keeps its centroid."""
    return _moved(_sums(rows.join(members, rows["row"] == members["slice"])), centroids)


def inertia(rows: DataFrame, members: DataFrame, centroids: DataFrame) -> float:
    """Sum of the squared distances of rows to their centroids."""
    packed = centroids.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "vec"))).alias("cs"))
    joined = rows.join(members, rows["row"] == members["slice"]).join(F.broadcast(packed))
    return float(joined.agg(F.sum(squared_distance(F.col("vec"), F.col("cs")[F.col("cluster")]))).first()[0] or 0.0)

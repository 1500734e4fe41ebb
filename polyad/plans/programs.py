"""Command-line programs: decomposition, slice clustering, and clusterwise approximation of stored tensors.

    python -m polyad.plans.programs tucker --TensorPath P [--DeCompSeq 0,1,2 --CoreRank 5,4,3 ...]
    python -m polyad.plans.programs kmeans --TensorPath P --CluNum 3 [...]
    python -m polyad.plans.programs clusterwise --TensorPath P --CluNum 3 --CoreRank 5,4,3 [...]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import BlockFrame
from ..operators import clusterwise as cw
from ..operators.clusters import gathered
from ..operators.kmeans import KMeans
from ..operators.relational import cluster_sizes
from ..operators.subspace import Wide
from ..operators.tucker import Tucker, hooi, reconstruct
from ..sources import tensor_dir as td
from ..storage import materialise


def numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="polyad")
    sub = p.add_subparsers(dest="program", required=True)
    for name in ("tucker", "kmeans", "clusterwise"):
        s = sub.add_parser(name)
        s.add_argument("--TensorPath", required=True)
        s.add_argument("--DeCompSeq", type=numbers, help="modes to decompose; all by default")
        s.add_argument("--CoreRank", type=numbers, help="rank for each of those modes")
        s.add_argument("--MaxIter", type=int, default=20)
        s.add_argument("--Epsilon", type=float, default=5e-5)
        s.add_argument("--RDDPartitionSize", default="", help="largest bytes of input per task")
        s.add_argument("--OutputPath", default="data")
        s.add_argument("--ApproxPath", default="")
        s.add_argument("--DoReconst", type=int, default=0)
        s.add_argument("--ReconstPath", default="")
        if name != "tucker":
            s.add_argument("--CluNum", type=int, default=1)
            s.add_argument("--UnfoldDim", type=int, default=0)
            s.add_argument("--CentroidsInit", default="first", choices=["first", "random", "sample"])
            s.add_argument("--CentroidsPath", default="", help="comma-separated text files, for sample")
        if name == "clusterwise":
            s.add_argument("--ClustersPath", default="")
            s.add_argument("--CorePath", default="")
            s.add_argument("--BasisPath", default="")
            s.add_argument("--FinalPath", default="")
            s.add_argument("--KMeansIter", type=int, default=20)
            s.add_argument("--Dual", type=int, default=0, help="score slices by the row spaces of the cores too")
    return p


def _load(spark: SparkSession, a) -> BlockFrame:
    """Stored tensors are dense blocks, and stay blocks wherever an operator has kernels for them."""
    if a.RDDPartitionSize:
        spark.conf.set("spark.sql.files.maxPartitionBytes", a.RDDPartitionSize)
    return td.read_blocks(spark, a.TensorPath)


def _modes(a, t: BlockFrame) -> tuple[list[int], list[int]]:
    modes = a.DeCompSeq or list(range(t.meta.ndim))
    if not a.CoreRank or len(a.CoreRank) != len(modes):
        raise SystemExit("--CoreRank needs a rank for each mode of --DeCompSeq")
    return modes, a.CoreRank


def run_tucker(spark: SparkSession, a) -> Tucker:
    t = _load(spark, a)
    modes, ranks = _modes(a, t)
    model = hooi(t, ranks, modes, a.MaxIter, a.Epsilon)
    out = a.ApproxPath or a.OutputPath
    core = BlockFrame(materialise(model.core.df, "core"), model.core.meta)
    td.write_blocks(core, f"{out}/core")
    td.write_bases(spark, f"{out}/basis", {m: b for m, b in model.factors.items() if not isinstance(b, Wide)}, t.meta.ndim)
    for m, b in model.factors.items():
        if isinstance(b, Wide):  # too large for one file
            b.table().write.mode("overwrite").parquet(f"{out}/basis-{m}")
    if a.DoReconst:
        td.write_blocks(reconstruct(core, model.factors), a.ReconstPath or f"{out}/reconstruction")
    return Tucker(core, model.factors, model.sweeps)


def run_kmeans(spark: SparkSession, a, t: BlockFrame | None = None, max_iter: int | None = None):
    """Returns the tensor, the members, and the clusters' blocks; saves each cluster as a tensor directory."""
    t = t or _load(spark, a)
    given = td.read_centroids(spark, a.CentroidsPath.split(",")) if a.CentroidsInit == "sample" else None
    job = KMeans(a.CluNum, a.MaxIter if max_iter is None else max_iter, "given" if given is not None else a.CentroidsInit)
    members, _ = job.run(t, a.UnfoldDim, given)
    sizes = {r["cluster"]: r["size"] for r in cluster_sizes(members, a.CluNum).collect()}
    held = gathered(t, members, a.UnfoldDim, sizes).stored("clusters")
    td.write_clusters({c: held.cluster(c) for c in held.metas}, f"{a.OutputPath}/clusters")
    td.write_cluster_cells(members, f"{a.OutputPath}/members")
    return t, members, held


def run_clusterwise(spark: SparkSession, a) -> cw.Clusterwise:
    t = _load(spark, a)
    modes, ranks = _modes(a, t)
    if a.ClustersPath:
        members = spark.read.parquet(a.ClustersPath).select("slice", F.col("cluster").cast("int").alias("cluster"))
    else:
        _, members, _ = run_kmeans(spark, a, t, a.KMeansIter)
    models = None
    if a.CorePath and a.BasisPath:
        factors = td.factors_from_parquet(spark, a.BasisPath)
        models = {c: Tucker(td.read_blocks(spark, f"{a.CorePath}/{c}"), factors[c], 0) for c in factors}
    done = cw.refine(t, members, a.CluNum, ranks, a.UnfoldDim, modes, a.MaxIter, eps=a.Epsilon, dual=bool(a.Dual), models=models)
    out = a.FinalPath or f"{a.OutputPath}/final"
    td.factors_to_parquet(spark, f"{out}/basis", {c: m.factors for c, m in done.models.items()})
    td.write_clusters({c: m.core for c, m in done.models.items()}, f"{out}/core")
    td.write_cluster_cells(done.members, f"{out}/members")
    if a.DoReconst:
        td.write_clusters({c: reconstruct(m.core, m.factors) for c, m in done.models.items()}, a.ReconstPath or f"{out}/reconstruction")
    return done


def main(args: Sequence[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"polyad {a.program}").getOrCreate()
    {"tucker": run_tucker, "kmeans": run_kmeans, "clusterwise": run_clusterwise}[a.program](spark, a)


if __name__ == "__main__":
    main()

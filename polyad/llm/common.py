"""Helpers shared by the training-data operators: shared storage, text columns, Arrow iteration."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, qualified, shared_dir, store  # noqa: F401


#: A key that holds over one in HOT of all rows is hot; so there are fewer than HOT such keys, however large the input.
HOT = 1000


def join_skewed(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """left joined with right, which has one row for each key and the number of left's rows with it in `weight`.

    Rows of hot keys meet their few (under HOT) rows of right by a broadcast, so none of those keys is gathered in a
    task; all other rows are joined by shuffle. left is read twice: give a stored table.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT > total
    met = left.join(F.broadcast(right.where(hot).withColumn("__hot", F.lit(True))), key, "left")
    cold = met.where("__hot IS NULL").select(*left.columns).join(right.where(~hot), key)
    names = [key, *(c for c in left.columns if c != key), *(c for c in right.columns if c != key)]
    return cold.select(*names).unionByName(met.where("__hot").select(*names))


def join_few(left: DataFrame, right: DataFrame, key: str, most: int = 50_000) -> DataFrame:
    """left joined with a stored table right of one row for each key: by a broadcast where it has at most `most` rows, else by shuffle."""
    return left.join(F.broadcast(right) if right.count() <= most else right, key)


def partitions(df: DataFrame, each: int = 64 << 20) -> int:
    """Shuffle partitions for df's rows: as configured, or more if the plan's estimated size gives over `each` bytes to one."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), 1 << 20) if size < 1 << 60 else 1)


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column; null is the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with its scheme (file:, hdfs://, s3://, gs://); qualified() gives paths theirs."""
    if ":/" not in path:
        raise ValueError(f"no scheme in {path}: Spark would look for it on its default file system")
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def put(fs: pafs.FileSystem, name: str, data: bytes) -> None:
    """Write a file whole: under a name of this attempt, then renamed. A file that is there already holds the same bytes and stays."""
    mine = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(mine) as sink:
        sink.write(data)
    try:
        fs.move(mine, name)
    except OSError:
        if fs.get_file_info(name).type != pafs.FileType.File:
            raise
        fs.delete_file(mine)


def small_batches(column: pa.Array, most_bytes: int):
    """(start, stop) row ranges of a binary or string column that hold about most_bytes each; a longer row stands alone."""
    import numpy as np

    n = len(column)
    if not n:
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, held = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if held and held + s > most_bytes:
            yield start, i
            start, held = i, 0
        held += s
    yield start, n


def task_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0

"""Tensors from a stream (an extension): cells are running sums that a streaming aggregation keeps up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..functions.index import modes
from ..meta import TensorMeta
from ..storage import shared_dir


def stream_cells(source: DataFrame, index: Sequence[str], value: str, meta: TensorMeta, name: str = "cells", time_col: str | None = None, delay: str = "1 day") -> TensorFrame:
    """Consume what a streaming DataFrame has now, and return the tensor of its cells.

    The state is a row per cell, bounded by the tensor's size; each trigger writes the changed cells (update mode) with
    the batch number, and a cell's value is that of its last batch. With time_col, rows later than `delay` are dropped.
    """
    spark, keys = source.sparkSession, modes(meta.ndim)
    if time_col:
        source = source.withWatermark(time_col, delay)
    cells = source.select(*[F.expr(x).cast("long").alias(k) for x, k in zip(index, keys, strict=True)], F.expr(value).cast("double").alias("v")).groupBy(*keys).agg(F.sum("v").alias("v"))
    out = shared_dir(spark, name)
    query = (
        cells.writeStream.outputMode("update")
        .option("checkpointLocation", f"{out}/state")
        # a repeated batch replaces its own folder, so nothing is counted twice
        .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/cells/batch={batch}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = ", ".join(f"{k} long" for k in keys) + ", v double, batch int"
    latest = spark.read.schema(schema).parquet(f"{out}/cells").groupBy(*keys).agg(F.max_by("v", "batch").alias("v"))
    return TensorFrame(latest, meta)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files, with its own schema."""
    # as a pattern, since a streaming source takes a folder or a pattern but not a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")

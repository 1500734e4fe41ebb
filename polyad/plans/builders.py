"""Tensors from the tables of a data folder, and fixed integer factors whose products are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..meta import TensorMeta

#: Order lines that a task sums to the cells of a long mode.
DEALT = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qty3(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """Part group x supplier group x line number; ordered quantity."""
    return TensorFrame.build(table(spark, sf_dir, "lineitem"), ["l_partkey % 20", "l_suppkey % 10", "l_linenumber - 1"], "l_quantity", TensorMeta((20, 10, 7), (8, 4, 3)))


def qty4(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """qty3 by line status."""
    return TensorFrame.build(table(spark, sf_dir, "lineitem"), ["l_partkey % 20", "l_suppkey % 10", "l_linenumber - 1", "CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END"], "l_quantity", TensorMeta((20, 10, 7, 2), (8, 4, 3, 1)))


def mat2(spark: SparkSession, sf_dir: str) -> TensorFrame:
    return TensorFrame.build(table(spark, sf_dir, "lineitem"), ["l_partkey % 20", "l_suppkey % 10"], "l_quantity", TensorMeta((20, 10), (8, 4)))


def _dealt(spark: SparkSession, sf_dir: str, key: str) -> tuple[DataFrame, int]:
    """The order lines dealt by a key of which each value has few of them, and one more than its largest value.

    Where the cells are about as many as the lines, sums made before the exchange save nothing and hold a table of a whole split; here a task sums about DEALT lines at any size.
    """
    lines = table(spark, sf_dir, "lineitem")
    largest, count = lines.agg(F.max(key), F.count("*")).first()
    return lines.repartition(max(spark.sparkContext.defaultParallelism, -(-count // DEALT)), key), (largest or 0) + 1


def by_order(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """Order x line number; ordered quantity. As many slices as the table's largest order number says."""
    lines, n = _dealt(spark, sf_dir, "l_orderkey")
    return TensorFrame.build(lines, ["l_orderkey", "l_linenumber - 1"], "l_quantity", TensorMeta((n, 7), (4096, 7)))


def by_part(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """Part x supplier group; ordered quantity."""
    lines, n = _dealt(spark, sf_dir, "l_partkey")
    return TensorFrame.build(lines, ["l_partkey", "l_suppkey % 10"], "l_quantity", TensorMeta((n, 10), (4096, 4)))


def evt3(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """Day of month x event type x user group; events. Event types are numbered in alphabetical order."""
    events = table(spark, sf_dir, "events")
    types = events.select("event_type").distinct().agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    found = events.join(F.broadcast(types))
    return TensorFrame.build(found, ["day(ts) - 1", "array_position(types, event_type) - 1", "user_id % 10"], "1", TensorMeta((31, 5, 10), (7, 2, 4)))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, vec of the embeddings: the slices of a two-way tensor, as arrays from the start."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vec"))


def integer_factor(spark: SparkSession, extent: int, rank: int) -> DataFrame:
    """B[i, r] = (i + 2 r) % 5 - 2."""
    at = spark.range(extent * rank).select(F.floor(F.col("id") / rank).cast("long").alias("i"), F.pmod("id", F.lit(rank)).cast("long").alias("r"))
    return at.select("i", "r", ((F.col("i") + 2 * F.col("r")) % 5 - 2).cast("double").alias("v"))

"""Token counts of flat, unindexed token files: a vectorised search for the end-of-document id, stitched by a prefix scan.

A file is nothing but ids (little-endian uint16 or uint32). It is cut into byte ranges; each range is searched alone, whatever
documents cross its edges. Per range one row comes back: its number of ids and the places of its separators. Two running
values over a file's ranges - ids before the range, and the last separator before it - place each separator and give the
length of each document, also of one that spans many ranges.

Defined cases: a null or empty text is a document of 0 tokens; ids behind the last separator are a last document with
`terminated` false; an empty file gives no row; an empty table gives none; equal doc_ids keep the scan's order; an id
that the file's width can't hold raises.

Scale: files are named by their attempt and the manifest says which count, so repeated tasks do no harm. Ranges are independent, of a fixed
size, with a task for every four; the scan's window runs over a row per range within each file. The
separator must be an id that no text yields: special tokens in texts are encoded as ordinary text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, open_fs, qualified, shared_dir, small_batches, task_id
from .tokens import BATCH, default_tokenizer, encoder

END_ID, RANGE = 50256, 8 << 20


def write_flat(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, dtype: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """Write documents as flat token files, one for each scan task, in the order of the scan: texts are not shuffled.

    Returns (files: file, n_bytes) and (order: file, ordinal, doc_id).
    """
    tokenizer, path, most = tokenizer or default_tokenizer(), qualified(docs.sparkSession, path), np.iinfo(dtype).max
    if end_id > most:
        raise ValueError(f"end id {end_id} doesn't fit into {dtype}")

    def write(batches):
        fs, root = open_fs(path)
        name, sink, ordinal, size = f"tokens-{task_id():06d}-{uuid.uuid4().hex[:12]}.bin", None, 0, 0
        for batch in batches:
            for a, b in small_batches(batch.column("text"), BATCH):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}")
                ids, offsets = encoder(tokenizer, True).encode(batch.column("text").slice(a, b - a))
                if len(ids) and ids.max() > most:
                    raise ValueError(f"id {ids.max()} doesn't fit into {dtype}")
                data = np.insert(ids, offsets[1:], np.uint32(end_id)).astype(dtype).tobytes()
                sink.write(data)
                size += len(data)
                n = b - a
                yield pa.RecordBatch.from_pydict({"file": [name] * n, "ordinal": pa.array(range(ordinal, ordinal + n), pa.int64()), "doc_id": batch.column("doc_id").slice(a, n), "n_bytes": pa.array([None] * n, pa.int64())})
                ordinal += n
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "ordinal": pa.array([None], pa.int64()), "doc_id": pa.array([None], pa.int64()), "n_bytes": [size]})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialise(texts.mapInArrow(write, "file string, ordinal long, doc_id long, n_bytes long"), "flat-order")
    return rows.where("n_bytes IS NOT NULL").select("file", "n_bytes"), rows.where("ordinal IS NOT NULL").select("file", "ordinal", "doc_id")


def scan_flat(files: DataFrame, path: str, end_id: int = END_ID, dtype: str = "<u2", range_bytes: int = RANGE) -> DataFrame:
    """file, ordinal, start, n_tokens (without the end id), terminated for each document in the files (file, n_bytes)."""
    width = np.dtype(dtype).itemsize
    step, path = range_bytes // width * width, qualified(files.sparkSession, path)
    ranges = files.where("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(step).cast("long"))).alias("at"))

    def search(batches):
        fs, root = open_fs(path)
        for batch in batches:
            for name, total, at in zip(*(batch.column(c).to_pylist() for c in ("file", "n_bytes", "at")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    source.seek(at)
                    ids = np.frombuffer(source.read(min(step, total - at)), dtype)
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_pydict({"file": [name], "at": [at], "n_ids": [len(ids)], "ends": pa.array([ends.tolist()], pa.list_(pa.int64()))})

    n_ranges = files.agg(F.sum(F.ceil(F.col("n_bytes") / step))).first()[0] or 0
    n = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(n_ranges) // 4))
    # kept, so that the window's two uses and a lost executor don't read the files again
    found = materialise(ranges.repartition(n, "file", "at").mapInArrow(search, "file string, at long, n_ids long, ends array<long>"), "separators")
    w = Window.partitionBy("file").orderBy("at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.expr(f"at div {width}")
    last = F.when(F.size("ends") > 0, start + F.element_at("ends", -1))
    # a row per range, with the one number that stands for its separators
    carried = found.select("file", "at", F.size("ends").alias("n_ends"), F.coalesce(F.max(last).over(before), F.lit(-1).cast("long")).alias("previous"), F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("earlier"), F.lead("at").over(w).isNull().alias("final"))
    placed = found.join(carried, ["file", "at"])
    bounds = F.concat(F.array("previous"), F.transform("ends", lambda e: e + start))
    docs = placed.select("file", "earlier", bounds.alias("bounds"), (F.col("final") & (F.element_at(bounds, -1) < start + F.col("n_ids") - 1)).alias("open"), (start + F.col("n_ids")).alias("stop"))
    pairs = F.transform(F.slice("bounds", F.lit(2), F.size("bounds") - 1), lambda e, i: F.struct((F.col("earlier") + i).alias("ordinal"), (F.get("bounds", i) + 1).alias("start"), (e - F.get("bounds", i) - 1).alias("n_tokens"), F.lit(True).alias("terminated")))
    tail = F.when(F.col("open"), F.array(F.struct((F.col("earlier") + F.size("bounds") - 1).alias("ordinal"), (F.element_at("bounds", -1) + 1).alias("start"), (F.col("stop") - F.element_at("bounds", -1) - 1).alias("n_tokens"), F.lit(False).alias("terminated"))))
    return docs.select("file", F.inline(F.when(F.col("open"), F.concat(pairs, tail)).otherwise(pairs)))


def separator_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens of each document, from flat files."""
    path = shared_dir(spark, "flat")
    files, order = write_flat(docs, path)
    return order.join(scan_flat(files, path), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")

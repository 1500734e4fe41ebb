"""Tensor directories: a text header and binary blocks.

    <path>/header/   text, four lines (TensorMeta.to_header)
    <path>/block/    binary files of one or more records; a record is N big-endian int32 block indices, then the block's
                     cells as big-endian float64, the first mode fastest; blocks at an edge are shorter

Format "tensor" is a Python data source for reading and writing such a directory; read_tensor and write_tensor wrap it. What it writes has, under names
that other readers pass over, two additions:

    <path>/block/_manifest   the tensor's sizes and a line of JSON for each data file: name, bytes, records, the least and the largest block
                             index of each mode, and the block numbers of a file of few records
    <path>/block/_at-<file>  for each record of a data file its block number and where it begins, as big-endian int64

A write puts its files beside those that are there and then swaps the manifest, in one step where the file system renames over a file; old files go afterwards, so a write that fails
leaves the old tensor as it was. Filters on block indices reach the files by the manifest and records by the index; a directory without them is read by walking the records.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..frame import BlockFrame, TensorFrame, block_schema
from ..functions.index import block_modes, modes
from ..meta import TensorMeta
from ..storage import qualified


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with its scheme, and the path there."""
    if ":/" not in path:
        raise ValueError(f"no scheme in {path}: Spark would look for it on its default file system")
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs, inner.rstrip("/")


#: Bytes of records that a writing task puts into a file; what a reading task takes is set by spark.sql.files.maxPartitionBytes.
FILE_BYTES = 128 << 20
#: A file of at most so many records has their block numbers in the manifest.
LISTED = 64
#: Python data sources may take filters while this is set; read_blocks sets it.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _sizes(path: str) -> list[tuple[str, int]]:
    fs, root = open_fs(path)
    found = fs.get_file_info(pafs.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[:1] not in "._" and f.size)


def _files(path: str) -> list[str]:
    return [f for f, _ in _sizes(path)]


# manifest


def read_manifest(path: str) -> tuple[TensorMeta, list[dict]] | None:
    """The sizes and the data files of a directory that has a manifest."""
    fs, root = open_fs(path)
    name = f"{root}/block/_manifest"
    if fs.get_file_info(name).type != pafs.FileType.File:
        return None
    with fs.open_input_file(name) as source:
        first, *files = (json.loads(line) for line in source.read().decode().splitlines())
    return TensorMeta(tuple(first["shape"]), tuple(first["block_shape"])), files


def _swap_manifest(path: str, meta: TensorMeta, files: list[dict]) -> None:
    fs, root = open_fs(path)
    lines = [{"shape": meta.shape, "block_shape": meta.block_shape}, *files]
    mine = f"{root}/block/_manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(mine) as sink:
        sink.write("\n".join(map(json.dumps, lines)).encode())
    try:
        fs.move(mine, f"{root}/block/_manifest")
    except OSError:  # a file system that doesn't rename over a file
        fs.delete_file(f"{root}/block/_manifest")
        fs.move(mine, f"{root}/block/_manifest")


class Wanted:
    """Block indices that filters ask for: an interval for each mode, and where told a set."""

    def __init__(self, meta: TensorMeta):
        self.low, self.high, self.sets = [0] * meta.ndim, [n - 1 for n in meta.block_num], [None] * meta.ndim

    def take(self, f) -> bool:
        """Narrow by a filter on one block index; whether it is wholly taken."""
        column = getattr(f, "attribute", ("",))
        if len(column) != 1 or column[0][:1] != "b" or not column[0][1:].isdigit() or int(column[0][1:]) >= len(self.low):
            return False
        m, kind = int(column[0][1:]), type(f)
        values = list(f.value) if kind is In else [getattr(f, "value", None)]
        if not values or not all(isinstance(v, int) for v in values):
            return False
        if kind in (EqualTo, In):
            self.sets[m] = set(values) & (self.sets[m] if self.sets[m] is not None else set(values))
            self.low[m], self.high[m] = max(self.low[m], min(values)), min(self.high[m], max(values))
        elif kind in (GreaterThan, GreaterThanOrEqual):
            self.low[m] = max(self.low[m], values[0] + (kind is GreaterThan))
        elif kind in (LessThan, LessThanOrEqual):
            self.high[m] = min(self.high[m], values[0] - (kind is LessThan))
        else:
            return False
        return True

    def block(self, key: Sequence[int]) -> bool:
        return all(lo <= b <= hi and (s is None or b in s) for b, lo, hi, s in zip(key, self.low, self.high, self.sets, strict=True))

    def file(self, entry: dict, meta: TensorMeta) -> bool:
        if entry["ids"] is not None:
            return any(self.block(meta.block_at(i)) for i in entry["ids"])
        apart = any(hi < a or b < lo for a, b, lo, hi in zip(entry["low"], entry["high"], self.low, self.high, strict=True))
        return not apart and all(s is None or any(a <= v <= b for v in s) for a, b, s in zip(entry["low"], entry["high"], self.sets, strict=True))


# codecs


def encode_block(key: Sequence[int], data: np.ndarray) -> bytes:
    return np.asarray(key, ">i4").tobytes() + np.asarray(data, ">f8").tobytes()


def _key(raw: bytes, meta: TensorMeta) -> tuple[int, ...]:
    if len(raw) < 4 * meta.ndim:
        raise ValueError("a record ends within its block indices")
    key = tuple(int(b) for b in np.frombuffer(raw, ">i4", meta.ndim))
    if any(not 0 <= b < n for b, n in zip(key, meta.block_num, strict=True)):
        raise ValueError(f"block {key} is outside the grid {meta.block_num}")
    return key


def read_records(source, size: int, meta: TensorMeta, start: int = 0, stop: int | None = None, wanted: Wanted | None = None, index: np.ndarray | None = None) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Records of a file (seekable, of size bytes) that begin in [start, stop), one at a time; wanted: only those.

    index (block number, offset) leads to the records that are wanted and to no others. Without it each record's length follows from its own block
    indices, so edge blocks may stand anywhere, and records that are not wanted or stand before `start`
    are skipped by reading their indices only. A file of a single record may also hold the block in its nominal size: it is
    then cut to the block's extent.
    """
    head, at, nominal = 4 * meta.ndim, 0, prod(meta.block_shape)
    stop = size if stop is None else min(size, stop)
    if index is not None:
        for number, begin in index.tolist():
            key = meta.block_at(number)
            if start <= begin < stop and (wanted is None or wanted.block(key)):
                source.seek(begin)
                raw = source.read(head + 8 * prod(meta.local_shape(key)))
                if _key(raw[:head], meta) != key or len(raw) < head + 8 * prod(meta.local_shape(key)):
                    raise ValueError(f"the record of block {key} is not where the index says")
                yield key, np.frombuffer(raw, ">f8", offset=head).astype(float)
        return
    while at < stop:
        source.seek(at)
        key = _key(source.read(head), meta)
        shape = meta.local_shape(key)
        cells = prod(shape)
        whole = at == 0 and size == head + 8 * nominal and cells < nominal
        width = 8 * (nominal if whole else cells)
        if at >= start and (wanted is None or wanted.block(key)):
            raw = source.read(width)
            if len(raw) < width:
                raise ValueError(f"the record of block {key} is cut off")
            data = np.frombuffer(raw, ">f8").astype(float)
            yield key, data.reshape(meta.block_shape, order="F")[tuple(slice(0, e) for e in shape)].reshape(-1, order="F") if whole else data
        at += head + width


def decode_blocks(raw: bytes, meta: TensorMeta) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Records of a file's bytes."""
    return read_records(io.BytesIO(raw), len(raw), meta)


def encode_matrix(mode: int, matrix: np.ndarray) -> bytes:
    return np.asarray([mode, *matrix.shape], ">i4").tobytes() + np.asarray(matrix, ">f8").reshape(-1, order="F").tobytes()


def decode_matrix(raw: bytes) -> tuple[int, np.ndarray]:
    """Mode slot and matrix: three int32 (mode, rows, columns), then the columns one after the other."""
    mode, rows, cols = (int(x) for x in np.frombuffer(raw, ">i4", 3))
    if len(raw) != 12 + 8 * rows * cols:
        raise ValueError("a matrix file's length contradicts its size")
    return mode, np.frombuffer(raw, ">f8", rows * cols, 12).reshape(rows, cols, order="F").astype(float)


# header


def read_header(spark: SparkSession, path: str) -> TensorMeta:
    """From <path>/header."""
    return TensorMeta.from_header([r["value"] for r in spark.read.text(f"{path}/header").limit(100).collect()])


def header_table(spark: SparkSession, path: str) -> DataFrame:
    """mode, extent, block_extent, block_num, block_final of a written header."""
    lines = spark.read.text(f"{path}/header").select(F.split(F.trim("value"), r"\s+").alias("w")).select(F.col("w")[0].alias("name"), F.posexplode(F.split(F.col("w")[1], ",")).alias("mode", "n"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("n").cast("long")))
    found = lines.where("name <> 'TensorDims'").groupBy("mode").agg(of("TensorRank").alias("extent"), of("BlockRank").alias("block_extent"), of("BlockNumber").alias("block_num"))
    return found.withColumn("block_final", (F.col("extent") - 1) % F.col("block_extent") + 1)


def write_lines(spark: SparkSession, path: str, lines: Sequence[str]) -> None:
    """A folder with one text file, in place of what was there."""
    fs, root = open_fs(qualified(spark, path))
    fs.create_dir(root, recursive=True)
    mine, old = f"{root}/_{uuid.uuid4().hex}", [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File]
    with fs.open_output_stream(mine) as sink:
        sink.write(("\n".join(lines) + "\n").encode())
    for name in old:
        fs.delete_file(name)
    fs.move(mine, f"{root}/part-00000")


def write_header(spark: SparkSession, path: str, meta: TensorMeta) -> None:
    write_lines(spark, f"{path}/header", meta.to_header())


# data source


@dataclass
class Ranges(InputPartition):
    """Byte ranges (file, file size, start, stop): the records that begin there."""

    parts: list[tuple[str, int, int, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TensorSource(DataSource):
    """Options: path; shape and block_shape (comma-separated). Rows: b0..b{N-1} INT, data ARRAY<DOUBLE>."""

    @classmethod
    def name(cls) -> str:
        return "tensor"

    def meta(self) -> TensorMeta:
        numbers = lambda k: tuple(int(x) for x in self.options[k].split(","))
        return TensorMeta(numbers("shape"), numbers("block_shape"))

    def schema(self) -> str:
        return block_schema(self.meta().ndim)

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringReader if self.options.get("filters") == "true" else TensorReader
        return kind(self.meta(), self.options["path"], int(self.options["task_bytes"]))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TensorWriter(self.meta(), self.options["path"], overwrite)


class TensorReader(DataSourceReader):
    """Tasks of about task_bytes: small files go together, large ones are split; a record is what a task holds at a time."""

    def __init__(self, meta: TensorMeta, path: str, task_bytes: int):
        self.meta, self.path, self.task_bytes, self.wanted = meta, path, max(1, task_bytes), Wanted(meta)

    def partitions(self) -> list[Ranges]:
        out, held, found = [], self.task_bytes, read_manifest(self.path)
        if found:
            root = open_fs(self.path)[1]
            files = [(f"{root}/block/{e['file']}", e["bytes"]) for e in found[1] if self.wanted.file(e, self.meta)]
        else:
            files = _sizes(f"{self.path}/block")
        for file, size in files:
            for start in range(0, size, self.task_bytes):
                stop = min(size, start + self.task_bytes)
                if held + stop - start > self.task_bytes:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append((file, size, start, stop))
                held += stop - start
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        names = [*block_modes(self.meta.ndim), "data"]
        for file, size, start, stop in partition.parts:
            with fs.open_input_file(file) as source:
                for key, data in read_records(source, size, self.meta, start, stop, self.wanted, _index(fs, file)):
                    yield pa.RecordBatch.from_arrays([*(pa.array([b], pa.int32()) for b in key), pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))], names)


class FilteringReader(TensorReader):
    """Takes filters on block indices. Spark hands them over only while PUSHDOWN is set."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if not self.wanted.take(f):
                yield f


def _index(fs: pafs.FileSystem, file: str) -> np.ndarray | None:
    folder, _, base = file.rpartition("/")
    name = f"{folder}/_at-{base}"
    if fs.get_file_info(name).type != pafs.FileType.File:
        return None
    with fs.open_input_file(name) as source:
        return np.frombuffer(source.read(), ">i8").reshape(-1, 2)


class TensorWriter(DataSourceArrowWriter):
    """Files of several records, about FILE_BYTES each, with their index, under names of the attempt; the manifest makes them the tensor."""

    def __init__(self, meta: TensorMeta, path: str, overwrite: bool):
        self.meta, self.path, self.overwrite = meta, path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(f"{root}/block", recursive=True)
        out, sink, index, size = [], None, [], 0
        name = ""

        def close() -> None:
            sink.close()
            with fs.open_output_stream(f"{root}/block/_at-{name}") as side:
                side.write(np.array(index, ">i8").tobytes())
            keys = np.array([self.meta.block_at(i) for i, _ in index])
            ids = [i for i, _ in index] if len(index) <= LISTED else None
            out.append(json.dumps({"file": name, "bytes": size, "records": len(index), "low": keys.min(axis=0).tolist(), "high": keys.max(axis=0).tolist(), "ids": ids}))

        for batch in iterator:
            keys = np.stack([np.asarray(batch.column(b)) for b in block_modes(self.meta.ndim)], 1).reshape(-1, self.meta.ndim)
            data = batch.column("data")
            ends, values = np.asarray(data.offsets), np.asarray(data.values, float)
            for key, a, b in zip(keys.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if b - a != prod(self.meta.local_shape(key)):
                    raise ValueError(f"block {tuple(key)} has {b - a} cells")
                if sink is None or size >= FILE_BYTES:
                    if sink is not None:
                        close()
                    name, index, size = f"part-{self.meta.block_id(key):08d}-{uuid.uuid4().hex}", [], 0
                    sink = fs.open_output_stream(f"{root}/block/{name}")
                record = encode_block(key, values[a:b])
                sink.write(record)
                index.append((self.meta.block_id(key), size))
                size += len(record)
        if sink is not None:
            close()
        return Written(out)

    def commit(self, messages) -> None:
        fs, root = open_fs(self.path)
        new, old = [json.loads(line) for m in messages if m for line in m.files], read_manifest(self.path)
        before = [f.rpartition("/")[2] for f in _files(f"{self.path}/block")] if fs.get_file_info(f"{root}/block").type == pafs.FileType.Directory else []
        if not self.overwrite and old:
            new = old[1] + new
        fs.create_dir(f"{root}/block", recursive=True)
        _swap_manifest(self.path, self.meta, new)
        if self.overwrite:
            kept = {e["file"] for e in new}
            for file in before:  # also what attempts that failed have left
                if file not in kept:
                    self._delete(fs, root, file)

    def abort(self, messages) -> None:
        fs, root = open_fs(self.path)
        for entry in (json.loads(line) for m in messages if m for line in m.files):
            self._delete(fs, root, entry["file"])

    @staticmethod
    def _delete(fs: pafs.FileSystem, root: str, file: str) -> None:
        for name in (f"{root}/block/{file}", f"{root}/block/_at-{file}"):
            if fs.get_file_info(name).type == pafs.FileType.File:
                fs.delete_file(name)


def _options(spark: SparkSession, meta: TensorMeta, path: str) -> dict[str, str]:
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return {"path": qualified(spark, path), "shape": ",".join(map(str, meta.shape)), "block_shape": ",".join(map(str, meta.block_shape)), "task_bytes": str(size)}


def read_blocks(spark: SparkSession, path: str, meta: TensorMeta | None = None) -> BlockFrame:
    """Tasks read about spark.sql.files.maxPartitionBytes each. Filters on block indices (lookup, stripe, edge) reach files and records."""
    spark.dataSource.register(TensorSource)
    if meta is None:
        found = read_manifest(qualified(spark, path))
        meta = found[0] if found else read_header(spark, path)
    spark.conf.set(PUSHDOWN, "true")
    return BlockFrame(spark.read.format("tensor").options(**_options(spark, meta, path), filters="true").load(), meta)


def read_tensor(spark: SparkSession, path: str) -> TensorFrame:
    return read_blocks(spark, path).to_cells()


def write_blocks(t: BlockFrame, path: str) -> None:
    """Blocks and header; an existing directory's blocks are replaced, and stay whole if the write fails. A tensor without blocks is one of zeros."""
    spark = t.df.sparkSession
    spark.dataSource.register(TensorSource)
    t.df.select(*t.keys, "data").write.format("tensor").options(**_options(spark, t.meta, path)).mode("overwrite").save()
    write_header(spark, path, t.meta)


def write_tensor(t: TensorFrame, path: str) -> None:
    write_blocks(t.to_blocks(), path)


# factor matrices


def write_bases(spark: SparkSession, path: str, factors: Mapping[int, np.ndarray], ndim: int | None = None) -> None:
    """A file for each mode; with ndim, modes without a factor get a 1 x 1 zero. Also a text header of the sizes."""
    fs, root = open_fs(qualified(spark, path))
    fs.create_dir(root, recursive=True)
    for m in range(ndim) if ndim is not None else factors:
        with fs.open_output_stream(f"{root}/part-{m:05d}") as sink:
            sink.write(encode_matrix(m, factors[m] if m in factors else np.zeros((1, 1))))
    used = sorted(factors)
    write_lines(spark, f"{path}/header", ["NbRows " + ",".join(str(factors[m].shape[0]) for m in used), "NbCols " + ",".join(str(factors[m].shape[1]) for m in used)])


def read_bases(spark: SparkSession, path: str) -> dict[int, np.ndarray]:
    """Matrices by mode, from the order of the files (some writers put the row count into the mode slot)."""
    path = qualified(spark, path)
    files = _files(path)
    fs, _ = open_fs(path)
    return {m: decode_matrix(fs.open_input_file(f).read())[1] for m, f in enumerate(files)}


def read_bases_header(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Rows and columns of each matrix."""
    found = dict(r["value"].split(" ", 1) for r in spark.read.text(f"{path}/header").collect())
    return tuple([int(x) for x in found[k].split(",")] for k in ("NbRows", "NbCols"))


def factors_to_parquet(spark: SparkSession, path: str, models: Mapping[int, Mapping[int, np.ndarray]]) -> None:
    """Factor matrices of several clusters: cluster (partition), mode, i, r, v."""
    from ..operators.relational import factor_table

    out = None
    for c, factors in models.items():
        for m, b in factors.items():
            part = factor_table(spark, b).select(F.lit(c).alias("cluster"), F.lit(m).alias("mode"), "i", "r", "v")
            out = part if out is None else out.unionByName(part)
    out.write.mode("overwrite").partitionBy("cluster").parquet(path)


def factors_from_parquet(spark: SparkSession, path: str) -> dict[int, dict[int, np.ndarray]]:
    cells = spark.read.parquet(path).toPandas()
    out: dict[int, dict[int, np.ndarray]] = {}
    for (c, m), part in cells.groupby(["cluster", "mode"]):
        matrix = np.zeros((part["i"].max() + 1, part["r"].max() + 1))
        matrix[part["i"], part["r"]] = part["v"]
        out.setdefault(int(c), {})[int(m)] = matrix
    return out


# clusters


def write_clusters(parts: Mapping[int, TensorFrame | BlockFrame], path: str) -> None:
    """A tensor directory for each cluster: <path>/<cluster>/."""
    for c, t in parts.items():
        write_blocks(t if isinstance(t, BlockFrame) else t.to_blocks(), f"{path}/{c}")


def read_clusters(spark: SparkSession, path: str, k: int, mode: int, block: int | None = None) -> tuple[DataFrame, dict[int, TensorMeta]]:
    """Cells with a cluster column, and each cluster's metadata with the mode's block extent widened to `block`."""
    out, metas = None, {}
    for c in range(k):
        t = read_tensor(spark, f"{path}/{c}")
        metas[c] = t.meta.replace(mode, t.meta.shape[mode], max(block or 0, t.meta.block_shape[mode]))
        part = t.df.select(F.lit(c).cast("int").alias("cluster"), *modes(t.meta.ndim), "v")
        out = part if out is None else out.unionByName(part)
    return out, metas


def write_cluster_cells(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").partitionBy("cluster").parquet(path)


def read_centroids(spark: SparkSession, paths: Sequence[str], chunk: int | None = None) -> DataFrame:
    """cluster, vec from text files of comma-separated numbers, a file for each centroid; with chunk: cluster, chunk, vec."""
    out = None
    for c, p in enumerate(paths):
        numbers = F.split(F.regexp_replace(F.trim("value"), r"\s+", ""), ",")
        part = spark.read.text(p, wholetext=True).select(F.lit(c).cast("int").alias("cluster"), F.transform(F.filter(numbers, lambda x: x != ""), lambda x: x.cast("double")).alias("vec"))
        out = part if out is None else out.unionByName(part)
    if not chunk:
        return out
    starts = F.sequence(F.lit(0), F.greatest(F.size("vec") - 1, F.lit(0)), F.lit(chunk))
    return out.select("cluster", F.posexplode(F.transform(starts, lambda s: F.slice("vec", s + 1, F.lit(chunk)))).alias("chunk", "vec"))

"""Token ids on disk as compressed bit planes.

File (one for each shard, ids of its documents in ascending doc_id order):

    magic b"BPT1"
    blocks: fixed-size id blocks (the last may be shorter), each the zstd frames of its planes one after the other
    chunk index (zstd): per block its offset, ids, mode, and the size of each plane (0: the plane is all zero)
    document index (zstd): doc_id, null flag and n_tokens of each document
    footer: sizes of both indexes, block size (little-endian) and the magic again

A block of n ids is a matrix of n rows and 32 bit columns (or 4 byte columns), written transposed: bit i of all ids lies
together, where neighbours are alike and high planes vanish. Any block can be decoded alone through the chunk index.

Defined cases: a null text is empty and still has its end id; a null doc_id sorts first; equal doc_ids are ordered by
a hash of their text, equal rows as they were scanned; an empty table gives no shard; a text longer than a block spans several.

Scale: one range shuffle of the texts by doc_id, hash and place, so that rows of one id, or one row repeated, spread over shards; a shard is
what one task encodes, streamed in blocks, so memory is bound by the batch and block size. Shards are written under a name of their own attempt,
and the manifest, which Spark commits, names those that count; so a repeated task does no harm on any file system. Only one row per
shard (file, counts) is gathered for the running starts, and shards are read back by a task each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, open_fs, qualified, shared_dir, small_batches, task_id
from .common import partitions as enough
from .tokens import BATCH, default_tokenizer, encoder

MAGIC, BLOCK = b"BPT1", 1 << 16
FOOTER = struct.Struct("<QQII4s")


def to_planes(ids: np.ndarray, mode: str = "bit") -> list[bytes]:
    """32 bit planes or 4 byte planes of uint32 ids, the lowest first; an all-zero plane is empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if mode == "byte":
        return [raw[:, j].tobytes() if 8 * j < top else b"" for j in range(4)]
    out = []
    for j in range(4):
        column = np.ascontiguousarray(raw[:, j])
        for bit in range(8):
            out.append(np.packbits((column >> bit) & 1, bitorder="little").tobytes() if 8 * j + bit < top else b"")
    return out


def from_planes(planes: list[bytes], n: int, mode: str = "bit") -> np.ndarray:
    raw = np.zeros((4, n), np.uint8)
    for k, plane in enumerate(planes):
        if plane and mode == "byte":
            raw[k] = np.frombuffer(plane, np.uint8)
        elif plane:
            raw[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << (k % 8)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


class Writer:
    """Streams ids of documents into a shard file."""

    def __init__(self, sink, mode: str = "bit", block: int = BLOCK, level: int = 3):
        import zstandard

        self.sink, self.mode, self.block = sink, mode, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held, self.held_n, self.at = [], 0, len(MAGIC)
        self.index, self.docs = [], []
        sink.write(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append((doc_ids, np.asarray(lengths, np.int64)))
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) // self.block * self.block
            for a in range(0, full, self.block):
                self._put(flat[a : a + self.block])
            self.held, self.held_n = [flat[full:].copy()], len(flat) - full

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) if p else b"" for p in to_planes(ids, self.mode)]
        self.index.append([self.at, len(ids), *map(len, planes)])
        self.sink.write(b"".join(planes))
        self.at += sum(map(len, planes))

    def close(self) -> tuple[int, int]:
        """Writes what is left and the indexes; returns (documents, ids)."""
        if self.held_n:
            self._put(np.concatenate(self.held))
        chunks = self.zip.compress(np.asarray(self.index, "<i8").tobytes())
        names = [d for ids, _ in self.docs for d in ids]
        lengths = np.concatenate([n for _, n in self.docs]) if self.docs else np.zeros(0, np.int64)
        table = np.stack([np.asarray([d or 0 for d in names], np.int64), np.asarray([d is None for d in names], np.int64), lengths]).astype("<i8")
        docs = self.zip.compress(table.tobytes())
        self.sink.write(chunks + docs + FOOTER.pack(len(chunks), len(docs), self.block, 1 if self.mode == "bit" else 0, MAGIC))
        return len(names), int(lengths.sum())


class Reader:
    """Random access to a shard: the document index, and any block through the chunk index."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - FOOTER.size)
        n_chunks, n_docs, self.block, bit, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane token file")
        self.mode = "bit" if bit else "byte"
        source.seek(size - FOOTER.size - n_chunks - n_docs)
        width = 2 + (32 if bit else 4)
        self.index = np.frombuffer(self.unzip.decompress(source.read(n_chunks)), "<i8").reshape(-1, width)
        table = np.frombuffer(self.unzip.decompress(source.read(n_docs)), "<i8").reshape(3, -1)
        self.doc_ids = [None if null else d for d, null in zip(table[0].tolist(), table[1].tolist(), strict=True)]
        self.lengths = table[2]

    def read_block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        self.source.seek(at)
        data, planes, p = self.source.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unzip.decompress(data[p : p + s]) if s else b"")
            p += s
        return from_planes(planes, n, self.mode)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only the blocks in between are read."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        flat = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return flat[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the shard, n_tokens, crc32 of the ids as little-endian uint32) of each document, block by block."""
        flat, base, k, start = np.empty(0, np.uint32), 0, 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            crc, at, stop = 0, start, start + n
            while at < stop:
                if at >= base + len(flat):
                    base += len(flat)
                    flat, k = self.read_block(k), k + 1
                part = flat[at - base : stop - base]
                crc, at = zlib.crc32(part.astype("<u4", copy=False).tobytes(), crc), at + len(part)
            yield doc_id, start, n, crc
            start = stop


def sorted_by_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(doc_id, text) in global doc_id order over the partitions; ties by the text's hash, then by the scan."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows of one id, even equal ones, can be dealt to several partitions
    keyed = rows.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    keys = ["doc_id", "tie", "place"]
    return keyed.repartitionByRange(partitions or enough(rows), *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, mode: str = "bit", block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """Encode and write documents; returns the manifest (shard, file, n_docs, n_ids), itself stored below path."""
    tokenizer, path = tokenizer or default_tokenizer(), qualified(docs.sparkSession, path)

    def write(batches):
        shard, encode = task_id(), encoder(tokenizer).encode
        fs, root = open_fs(path)
        name, writer, sink = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.bpt", None, None
        for batch in batches:
            for a, b in small_batches(batch.column("text"), BATCH):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer = Writer(sink, mode, block)
                ids, offsets = encode(batch.column("text").slice(a, b - a))
                ends = offsets[1:]
                writer.add(batch.column("doc_id").slice(a, b - a).to_pylist(), np.insert(ids, ends, np.uint32(end_id)), np.diff(offsets) + 1)
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = sorted_by_id(docs, partitions=partitions)
    return materialise(rows.mapInArrow(write, "shard int, file string, n_docs long, n_ids long"), "bitplane-manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    base = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # a row per shard file: the only thing that passes through one task
    shards = manifest.select("shard", "file", F.coalesce(base, F.lit(0)).alias("base"))
    path = qualified(manifest.sparkSession, path)

    def read(batches):
        fs, root = open_fs(path)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    rows = list(Reader(source).documents())
                ids, start, n, crc = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array([first + s for s in start], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return shards.repartitionByRange(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def bitplane_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = shared_dir(spark, "bitplane")
    return read_shards(write_shards(docs, path), path)

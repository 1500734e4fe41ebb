"""Dense kernels over blocks: NumPy in Arrow batches, with the local sums of a task made before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import BlockFrame, block_schema
from ..functions.index import block_modes
from ..meta import TensorMeta

#: Values that a task holds back to add up before it passes them on.
HELD = 4_000_000


def unfold_local(x: np.ndarray, mode: int) -> np.ndarray:
    """Cyclic mode-n matricization of a block with its local shape."""
    order = [(mode + j) % x.ndim for j in range(x.ndim)]
    return np.transpose(x, order).reshape(x.shape[mode], -1, order="F")


def refold_local(m: np.ndarray, mode: int, shape: tuple[int, ...]) -> np.ndarray:
    order = [(mode + j) % len(shape) for j in range(len(shape))]
    return np.transpose(m.reshape([shape[o] for o in order], order="F"), np.argsort(order))


def local(meta: TensorMeta, key: tuple[int, ...], data) -> np.ndarray:
    return np.asarray(data, float).reshape(meta.local_shape(key), order="F")


def _rows(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    for row in zip(*(pdf[k] for k in keys), pdf["data"], strict=True):
        yield tuple(int(b) for b in row[:-1]), row[-1]


class _Sums:
    """Running sums by key, passed on when they hold too much."""

    def __init__(self, keys: list[str]):
        self.keys, self.held, self.size = keys, {}, 0

    def add(self, key: tuple[int, ...], values: np.ndarray) -> pd.DataFrame | None:
        if key in self.held:
            self.held[key] += values
            return None
        self.held[key], self.size = values.copy(), self.size + values.size
        return self.flush() if self.size > HELD else None

    def flush(self) -> pd.DataFrame:
        out = pd.DataFrame({k: [key[i] for key in self.held] for i, k in enumerate(self.keys)}, dtype="int32")
        out["data"] = list(self.held.values())
        self.held, self.size = {}, 0
        return out


def sum_by(parts: DataFrame, keys: list[str]) -> DataFrame:
    """data of rows with the same keys (int) added up: rows of a key come one after the other, so one sum is held at a time."""

    def add(frames):
        key, total = None, None
        for pdf in frames:
            for k, data in _rows(pdf, keys):
                if k == key:
                    total = total + data
                else:
                    if key is not None:
                        yield pd.DataFrame([[*key, total]], columns=[*keys, "data"])
                    key, total = k, np.asarray(data)
        if key is not None:
            yield pd.DataFrame([[*key, total]], columns=[*keys, "data"])

    schema = ", ".join(f"{k} int" for k in keys) + ", data array<double>"
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, schema)


def sum_blocks(parts: DataFrame, n: int) -> DataFrame:
    return sum_by(parts, block_modes(n))


def mode_n_products(t: BlockFrame, factors: Mapping[int, np.ndarray]) -> BlockFrame:
    """Products with local factor matrices (extent x rank) in all given modes at once: one pass, one shuffle of summed results.

    A block meets, for each mode, the rows of the factor that its index range needs; its whole contribution is computed and cut into
    target blocks. Factors go with the function: extent times rank values each, which the caller bounds.
    """
    if not factors:
        return t
    df, metas = products_of(t.df.select(F.lit(0).alias("cluster"), *t.keys, "data"), {0: t.meta}, {0: factors})
    return BlockFrame(df.drop("cluster"), metas[0])


def products_of(df: DataFrame, metas: Mapping[int, TensorMeta], factors: Mapping[int, Mapping[int, np.ndarray]]) -> tuple[DataFrame, dict[int, TensorMeta]]:
    """cluster and blocks of the products of every cluster's blocks (cluster, b.., data) with its own factors (cluster to mode to matrix), and their metadata.

    Blocks without a cluster column meet every cluster's factors; metas then has the one tensor's metadata for each cluster.
    """
    ndim, targets = next(iter(metas.values())).ndim, {}
    for c, own in factors.items():
        targets[c] = metas[c]
        for m, b in own.items():
            if b.shape[0] != metas[c].shape[m]:
                raise ValueError(f"factor {m} has {b.shape[0]} rows, the mode has {metas[c].shape[m]}")
            targets[c] = targets[c].replace(m, b.shape[1])
    keys, shared = block_modes(ndim), "cluster" not in df.columns
    columns = ["cluster", *keys]

    def contributions(c: int, key: tuple[int, ...], data):
        meta, target, own = metas[c], targets[c], factors[c]
        x = local(meta, key, data)
        for m, b in own.items():
            x = np.moveaxis(np.tensordot(x, b[slice(*meta.block_range(m, key[m]))], axes=(m, 0)), -1, m)
        for to in np.ndindex(*[target.block_num[m] if m in own else 1 for m in range(ndim)]):
            at = tuple(to[m] if m in own else key[m] for m in range(ndim))
            yield (c, *at), x[tuple(slice(*target.block_range(m, at[m])) if m in own else slice(None) for m in range(ndim))].reshape(-1, order="F")

    def multiply(frames):
        sums = _Sums(columns)
        for pdf in frames:
            for key, data in _rows(pdf, keys if shared else columns):
                for c in factors if shared else key[:1]:
                    for at, part in contributions(c, key if shared else key[1:], data):
                        if (full := sums.add(at, part)) is not None:
                            yield full
        if sums.held:
            yield sums.flush()

    given = df.select(*([] if shared else ["cluster"]), *keys, "data")
    return sum_by(given.mapInPandas(multiply, "cluster int, " + block_schema(ndim)), columns), targets


def factor_tiles(factor: DataFrame, here: TensorMeta, to: TensorMeta, mode: int) -> DataFrame:
    """tb, to, tile: a factor's cells (i, r, v) cut by the blocks that its rows and columns belong to; a tile is dense, its first index fastest."""
    h, w = here.block_shape[mode], to.block_shape[mode]
    cut = factor.select(F.floor(F.col("i") / h).cast("int").alias("tb"), F.floor(F.col("r") / w).cast("int").alias("to"), F.pmod("i", F.lit(h)).alias("y"), F.pmod("r", F.lit(w)).alias("x"), "v")

    def fill(frames):
        for pdf in frames:
            tiles = []
            for tb, at, y, x, v in zip(pdf["tb"], pdf["to"], pdf["y"], pdf["x"], pdf["v"], strict=True):
                tile = np.zeros([stop - start for start, stop in (here.block_range(mode, tb), to.block_range(mode, at))])
                tile[np.asarray(y, np.int64), np.asarray(x, np.int64)] = v
                tiles.append(tile.reshape(-1, order="F"))
            yield pdf[["tb", "to"]].assign(tile=tiles)

    lists = [F.collect_list(c).alias(c) for c in ("y", "x", "v")]
    return cut.groupBy("tb", "to").agg(*lists).mapInPandas(fill, "tb int, to int, tile array<double>")


def tiled_product(t: BlockFrame, mode: int, factor: DataFrame, rank: int) -> BlockFrame:
    """The product in one mode with a factor of any size, given by its cells (i, r, v): blocks meet the factor's tiles by their index along the mode.

    No task holds more of the factor than a tile; Spark broadcasts the tiles or shuffles both sides by what their sizes are.
    """
    meta, keys = t.meta, t.keys
    target = meta.replace(mode, rank)
    met = t.df.join(factor_tiles(factor, meta, target, mode), F.col(keys[mode]) == F.col("tb"))

    def multiply(frames):
        sums = _Sums(keys)
        for pdf in frames:
            for (key, data), to, tile in zip(_rows(pdf, keys), pdf["to"], pdf["tile"], strict=True):
                x = local(meta, key, data)
                y = np.tensordot(x, np.asarray(tile).reshape(x.shape[mode], -1, order="F"), axes=(mode, 0))
                at = tuple(int(to) if m == mode else b for m, b in enumerate(key))
                if (full := sums.add(at, np.moveaxis(y, -1, mode).reshape(-1, order="F"))) is not None:
                    yield full
        if sums.held:
            yield sums.flush()

    return BlockFrame(sum_blocks(met.select(*keys, "data", "to", "tile").mapInPandas(multiply, block_schema(meta.ndim)), meta.ndim), target)


def spread(spark: SparkSession, core: np.ndarray, meta: TensorMeta, factors: Mapping[int, np.ndarray]) -> BlockFrame:
    """A local core times local factors (extent x rank), a target block at a time: a row for each block number, no exchange of values."""
    target = meta
    for m, b in factors.items():
        if b.shape[1] != meta.shape[m]:
            raise ValueError(f"factor {m} has {b.shape[1]} columns, the core {meta.shape[m]}")
        target = target.replace(m, b.shape[0])
    keys, count = block_modes(target.ndim), prod(target.block_num)
    sent = spark.sparkContext.broadcast((core, dict(factors)))

    def make(frames):
        core, factors = sent.value
        for pdf in frames:
            for number in pdf["id"]:
                key = target.block_at(int(number))
                # a core of all modes shrinks to the block's rows of each factor, those that grow it least first
                x = core[tuple(slice(None) if m in factors else slice(*target.block_range(m, key[m])) for m in range(target.ndim))]
                for m in sorted(factors, key=lambda m: target.local_shape(key)[m] / core.shape[m]):
                    x = np.moveaxis(np.tensordot(x, factors[m][slice(*target.block_range(m, key[m]))], axes=(m, 1)), -1, m)
                yield pd.DataFrame({k: [b] for k, b in zip(keys, key, strict=True)}, dtype="int32").assign(data=[x.reshape(-1, order="F")])

    return BlockFrame(spark.range(count).mapInPandas(make, block_schema(target.ndim)), target)


def gram(t: BlockFrame, mode: int) -> DataFrame:
    """r, c, v of the mode-n Gram matrix."""
    return gram_of(t.df.select(F.lit(0).alias("cluster"), *t.keys, "data"), {0: t.meta}, mode).drop("cluster")


def gram_of(df: DataFrame, metas: Mapping[int, TensorMeta], mode: int) -> DataFrame:
    """cluster, r, c, v of the mode-n Gram matrix of every cluster's blocks (cluster, b.., data), in one aggregate.

    Pairs of blocks that differ in mode n only are multiplied, partial matrices summed per task. The blocks along a fibre are cut into groups of at
    most HELD values, and each pair of groups is a key of its own: a fibre, however long, spreads over many tasks. A block is sent once for each
    group of its fibre.
    """
    keys = block_modes(next(iter(metas.values())).ndim)
    others = [k for m, k in enumerate(keys) if m != mode]
    per = max(1, HELD // max(prod(m.block_shape) for m in metas.values()))
    groups = F.create_map(*[F.lit(x) for c, m in metas.items() for x in (int(c), -(-m.block_num[mode] // per))])[F.col("cluster")]
    own = F.floor(F.col(keys[mode]) / per).cast("int")
    sent = df.select("cluster", *keys, "data", own.alias("own"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("other"))
    sent = sent.select("cluster", *keys, "data", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def multiply(frames):
        fibre, near, held, size = None, [], {}, 0
        for pdf in frames:
            for (c, *key), data, p, q in ((k, d, p, q) for (k, d), p, q in zip(_rows(pdf, ["cluster", *keys]), pdf["p"], pdf["q"], strict=True)):
                now = (c, *(b for m, b in enumerate(key) if m != mode), p, q)
                if now != fibre:
                    fibre, near = now, []
                near.append((key[mode], unfold_local(local(metas[c], key, data), mode)))
                for b, x in near:  # the new block with all before it and with itself
                    if p != q and b // per == key[mode] // per:
                        continue  # a pair within one group belongs to the key of that group alone
                    (i, x), (j, y) = sorted([(b, x), near[-1]], key=lambda e: e[0])
                    part = x @ y.T
                    size += 0 if (c, i, j) in held else part.size
                    held[c, i, j] = held[c, i, j] + part if (c, i, j) in held else part
                    if size > HELD:
                        yield from entries(held)
                        held, size = {}, 0
        yield from entries(held)

    def entries(held):
        for (cluster, p, q), m in held.items():
            r0, c0 = metas[cluster].block_range(mode, p)[0], metas[cluster].block_range(mode, q)[0]
            r, c = np.divmod(np.arange(m.size), m.shape[1])
            yield pd.DataFrame({"cluster": np.int32(cluster), "r": r + r0, "c": c + c0, "v": m.reshape(-1)})
            if p != q:
                yield pd.DataFrame({"cluster": np.int32(cluster), "r": c + c0, "c": r + r0, "v": m.reshape(-1)})

    by = ["cluster", *others, "p", "q"]
    parts = sent.repartition(*by).sortWithinPartitions(*by).mapInPandas(multiply, "cluster int, r long, c long, v double")
    return parts.groupBy("cluster", "r", "c").agg(F.sum("v").alias("v"))


def unfold(t: BlockFrame, mode: int) -> DataFrame:
    """row, col0, vec: for each row of each block's matricization, its values; col0 numbers the block among those of its stripe."""
    meta, keys = t.meta, t.keys
    rest = [(mode + j) % meta.ndim for j in range(1, meta.ndim)]

    def cut(frames):
        for pdf in frames:
            rows, cols, vecs = [], [], []
            for key, data in _rows(pdf, keys):
                m = unfold_local(local(meta, key, data), mode)
                number, stride = 0, 1
                for o in rest:
                    number, stride = number + key[o] * stride, stride * meta.block_num[o]
                rows += range(meta.block_range(mode, key[mode])[0], meta.block_range(mode, key[mode])[0] + len(m))
                cols += [number] * len(m)
                vecs += list(m)
            yield pd.DataFrame({"row": rows, "col0": cols, "vec": vecs})

    return t.df.mapInPandas(cut, "row long, col0 long, vec array<double>")


def columns(meta: TensorMeta, mode: int, number: int) -> np.ndarray:
    """Columns in the mode-n matricization of the whole tensor that a row of block `number` of a stripe holds, in the row's order."""
    out, stride = np.zeros(1, np.int64), 1
    for o in [(mode + j) % meta.ndim for j in range(1, meta.ndim)]:
        number, b = divmod(number, meta.block_num[o])
        out = np.add.outer(out, np.arange(*meta.block_range(o, b)) * stride).reshape(-1, order="F")
        stride *= meta.shape[o]
    return out


def row_vectors(t: BlockFrame, mode: int) -> DataFrame:
    """row, vec: each slice as a dense array, columns in matricization order; missing blocks are zero.

    One shuffle, of the pieces of rows; a task holds one row at a time and passes on rows of about HELD values.
    """
    meta = t.meta
    width = meta.size // meta.shape[mode]
    every = t.df.sparkSession.range(meta.shape[mode]).select(F.col("id").alias("row"), F.lit(None).cast("long").alias("col0"), F.lit(None).cast("array<double>").alias("vec"))

    def place(frames):
        row, vec, done, at = None, None, [], {}
        for pdf in frames:
            for r, number, piece in zip(pdf["row"], pdf["col0"], pdf["vec"], strict=True):
                if r != row:
                    if row is not None:
                        done.append((row, vec))
                    if len(done) * width > HELD:
                        yield pd.DataFrame(done, columns=["row", "vec"])
                        done = []
                    row, vec = r, np.zeros(width)
                if piece is not None:
                    number = int(number)
                    if number not in at:
                        at[number] = columns(meta, mode, number)
                    vec[at[number]] += piece
        if row is not None:
            yield pd.DataFrame([*done, (row, vec)], columns=["row", "vec"])

    return unfold(t, mode).unionByName(every).repartition("row").sortWithinPartitions("row").mapInPandas(place, "row long, vec array<double>")

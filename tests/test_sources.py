import numpy as np
import pytest

from polyad.frame import BlockFrame, TensorFrame
from polyad.meta import TensorMeta
from polyad.plans import programs
from polyad.sources import tensor_dir as td


def test_block_codec_with_edges_in_one_file():
    meta = TensorMeta((5, 4), (3, 4))
    a, b = np.arange(12.0), np.arange(8.0) + 100
    raw = td.encode_block((0, 0), a) + td.encode_block((1, 0), b)
    assert [(k, v.tolist()) for k, v in td.decode_blocks(raw, meta)] == [((0, 0), a.tolist()), ((1, 0), b.tolist())]
    full = np.zeros((3, 4), order="F")
    full[:2] = b.reshape(2, 4, order="F")
    padded = td.encode_block((1, 0), full.reshape(-1, order="F"))
    assert next(td.decode_blocks(padded, meta))[1].tolist() == b.tolist()
    for bad in (raw[:-1], raw[:3], td.encode_block((7, 0), a)):
        with pytest.raises(ValueError):
            list(td.decode_blocks(bad, meta))


def test_matrix_codec():
    m = np.arange(6.0).reshape(2, 3)
    assert td.encode_matrix(4, m)[:12] == bytes([0, 0, 0, 4, 0, 0, 0, 2, 0, 0, 0, 3])
    mode, back = td.decode_matrix(td.encode_matrix(4, m))
    assert mode == 4 and np.array_equal(back, m)
    with pytest.raises(ValueError):
        td.decode_matrix(td.encode_matrix(4, m)[:-8])


@pytest.mark.parametrize(("shape", "block"), [((5, 7), (2, 3)), ((4, 3, 5, 2), (3, 3, 2, 2))], ids=str)
def test_tensor_directory(spark, tmp_path, shape, block):
    x = np.random.default_rng(0).normal(size=shape)
    path = f"{tmp_path}/t"
    for scale in (1, 2):  # the second write replaces the first
        td.write_tensor(TensorFrame.from_numpy(spark, scale * x, block), path)
    t = td.read_tensor(spark, path)
    assert t.meta == TensorMeta(shape, block) and np.array_equal(t.to_numpy(), 2 * x)
    assert 1 <= len(list((tmp_path / "t/block").glob("part-*"))) < t.meta.blocks  # several records in a file
    assert np.array_equal(td.read_blocks(spark, f"file://{path}").to_cells().to_numpy(), 2 * x)


class Counted:
    """A file that counts what is read."""

    def __init__(self, source):
        self.source, self.reads = source, []

    def seek(self, at):
        self.source.seek(at)

    def read(self, n):
        self.reads.append(n)
        return self.source.read(n)


def test_a_lookup_opens_one_file_and_reads_one_record(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    x = np.random.default_rng(0).normal(size=(12, 10))
    path = f"{tmp_path}/t"
    t = TensorFrame.from_numpy(spark, x, (2, 5)).to_blocks()
    td.write_blocks(BlockFrame(t.df.repartition(6, "b0"), t.meta), path)
    assert len(td.read_manifest(f"file://{path}")[1]) > 1

    def reader(*filters):
        out = td.FilteringReader(t.meta, f"file://{path}", 1 << 20)
        return out, list(out.pushFilters(list(filters)))

    one, left = reader(EqualTo(("b0",), 4), EqualTo(("b1",), 1), EqualTo(("data",), 1))
    parts = one.partitions()
    assert len(left) == 1 and len(parts) == 1 and len(parts[0].parts) == 1
    file, size, start, stop = parts[0].parts[0]
    fs, _ = td.open_fs(f"file://{path}")
    with fs.open_input_file(file) as source:
        counted = Counted(source)
        got = list(td.read_records(counted, size, t.meta, start, stop, one.wanted, td._index(fs, file)))
        assert counted.reads == [8 + 8 * 10] and np.array_equal(got[0][1].reshape(2, 5, order="F"), x[8:10, 5:])
        # without the index, the indices of records before are read, and no cells but those wanted
        counted = Counted(source)
        assert len(list(td.read_records(counted, size, t.meta, wanted=one.wanted))) == 1 and sum(n > 8 for n in counted.reads) == 1
    for filters, want in (((In(("b0",), (1, 3, 99)),), 4), ((GreaterThan(("b0",), 3), LessThan(("b1",), 1)), 2), ((EqualTo(("b0",), 77),), 0)):
        some, _ = reader(*filters)
        assert sum(b.num_rows for p in some.partitions() for b in some.read(p)) == want
    back = td.read_blocks(spark, path)
    assert [tuple(r)[:2] for r in back.lookup((4, 1)).collect()] == [(4, 1)] and back.stripe(0, 2).count() == 2 and back.edge(1).count() == 6


def test_files_of_many_records_are_pruned_by_their_range(spark, tmp_path, monkeypatch):
    meta, path = TensorMeta((400,), (1,)), f"{tmp_path}/t"
    t = BlockFrame(spark.range(400).selectExpr("cast(id as int) as b0", "array(cast(id as double)) as data").repartitionByRange(2, "b0"), meta)
    td.write_blocks(t, path)
    assert all(e["ids"] is None for e in td.read_manifest(f"file://{path}")[1])
    reader = td.FilteringReader(meta, f"file://{path}", 1 << 20)
    assert reader.wanted.take(td.EqualTo(("b0",), 399)) and sum(len(p.parts) for p in reader.partitions()) == 1
    assert td.read_blocks(spark, path).lookup((399,)).collect()[0]["data"] == [399.0]


def test_a_failed_overwrite_leaves_the_old_tensor(spark, tmp_path):
    x, path = np.arange(12.0).reshape(4, 3) + 1, f"{tmp_path}/t"
    td.write_tensor(TensorFrame.from_numpy(spark, x, (2, 2)), path)
    bad = TensorFrame.from_numpy(spark, -np.ones((6, 6)), (3, 3)).to_blocks()
    broken = BlockFrame(bad.df.selectExpr("b0", "b1", "if(b0 = 1, array(1.0D), data) as data"), bad.meta)
    with pytest.raises(Exception, match="cells"):
        td.write_blocks(broken, path)
    t = td.read_tensor(spark, path)
    assert t.meta.shape == (4, 3) and np.array_equal(t.to_numpy(), x)
    td.write_tensor(TensorFrame.from_numpy(spark, 3 * np.ones((6, 6)), (3, 3)), path)
    assert np.array_equal(td.read_tensor(spark, path).to_numpy(), 3 * np.ones((6, 6)))
    listed = {e["file"] for e in td.read_manifest(f"file://{path}")[1]}
    assert {p.name for p in (tmp_path / "t/block").iterdir() if p.name.startswith("part-")} == listed


def test_a_directory_without_a_manifest(spark, tmp_path):
    x, path = np.arange(20.0).reshape(5, 4), tmp_path / "t"
    td.write_tensor(TensorFrame.from_numpy(spark, x, (2, 4), dense=True), str(path))
    for p in (path / "block").iterdir():
        if p.name.startswith(("_", ".")):
            p.unlink()
    back = td.read_blocks(spark, str(path))
    assert np.array_equal(back.to_cells().to_numpy(), x) and back.lookup((2, 0)).collect()[0]["data"] == x[4].tolist()


def test_bases(spark, tmp_path):
    factors = {0: np.random.default_rng(0).random((4, 2)), 2: np.random.default_rng(1).random((3, 3))}
    td.write_bases(spark, f"{tmp_path}/b", factors, 3)
    back = td.read_bases(spark, f"{tmp_path}/b")
    assert np.array_equal(back[0], factors[0]) and np.array_equal(back[1], [[0]]) and np.array_equal(back[2], factors[2])
    assert td.read_bases_header(spark, f"{tmp_path}/b") == ([4, 3], [2, 3])
    td.factors_to_parquet(spark, f"{tmp_path}/p", {0: factors, 1: {0: factors[0] + 1}})
    got = td.factors_from_parquet(spark, f"{tmp_path}/p")
    assert np.array_equal(got[0][2], factors[2]) and np.array_equal(got[1][0], factors[0] + 1)


def test_clusters_and_centroids(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(5, 3))
    td.write_clusters({0: TensorFrame.from_numpy(spark, x[:2], (2, 3)), 1: TensorFrame.from_numpy(spark, x[2:], (3, 2))}, f"{tmp_path}/c")
    cells, metas = td.read_clusters(spark, f"{tmp_path}/c", 2, 0, 4)
    assert metas[0].block_shape == (4, 3) and metas[1].shape == (3, 3)
    assert np.array_equal(TensorFrame(cells.where("cluster = 1").drop("cluster"), metas[1]).to_numpy(), x[2:])
    td.write_cluster_cells(cells, f"{tmp_path}/q")
    assert spark.read.parquet(f"{tmp_path}/q").where("cluster = 0").count() == 6
    (tmp_path / "one").write_text("1.5, 2,\n3,-4e-1,5\n")
    (tmp_path / "two").write_text("6,7,8,9,10")
    paths = [f"{tmp_path}/one", f"{tmp_path}/two"]
    assert [(r["cluster"], r["vec"]) for r in td.read_centroids(spark, paths).orderBy("cluster").collect()] == [(0, [1.5, 2, 3, -0.4, 5]), (1, [6, 7, 8, 9, 10])]
    assert [(r["chunk"], r["vec"]) for r in td.read_centroids(spark, paths, 2).where("cluster = 1").orderBy("chunk").collect()] == [(0, [6, 7]), (1, [8, 9]), (2, [10])]


def test_programs(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(6, 4, 3))
    td.write_tensor(TensorFrame.from_numpy(spark, x, (4, 3, 2)), f"{tmp_path}/t")
    run = lambda f, *args: f(spark, programs.parser().parse_args([*args, "--TensorPath", f"{tmp_path}/t", "--OutputPath", f"{tmp_path}/out"]))
    model = run(programs.run_tucker, "tucker", "--CoreRank", "6,4,3", "--MaxIter", "2", "--DoReconst", "1")
    assert np.allclose(td.read_tensor(spark, f"{tmp_path}/out/reconstruction").to_numpy(), x)
    assert np.allclose(td.read_bases(spark, f"{tmp_path}/out/basis")[1], model.factors[1])
    _, members, _ = run(programs.run_kmeans, "kmeans", "--CluNum", "2", "--MaxIter", "2")
    own = [r["slice"] for r in members.where("cluster = 0").orderBy("slice").collect()]
    assert np.array_equal(td.read_tensor(spark, f"{tmp_path}/out/clusters/0").to_numpy(), x[own])
    run(programs.run_clusterwise, "clusterwise", "--CluNum", "2", "--CoreRank", "2,2,2", "--MaxIter", "1", "--ClustersPath", f"{tmp_path}/out/members")
    done = run(programs.run_clusterwise, "clusterwise", "--CluNum", "2", "--CoreRank", "2,2,2", "--MaxIter", "1", "--ClustersPath", f"{tmp_path}/out/members", "--CorePath", f"{tmp_path}/out/final/core", "--BasisPath", f"{tmp_path}/out/final/basis", "--FinalPath", f"{tmp_path}/again")
    assert spark.read.parquet(f"{tmp_path}/again/members").count() == 6 and done.rounds == 1
    assert isinstance(done.models[0].core, BlockFrame)  # blocks from end to end
    run(programs.run_clusterwise, "clusterwise", "--CluNum", "2", "--CoreRank", "6,4,3", "--MaxIter", "1", "--ClustersPath", f"{tmp_path}/out/members", "--Dual", "1", "--DoReconst", "1", "--FinalPath", f"{tmp_path}/dual")
    kept = spark.read.parquet(f"{tmp_path}/dual/members")
    own = [r["slice"] for r in kept.where("cluster = 1").orderBy("slice").collect()]
    assert np.allclose(td.read_tensor(spark, f"{tmp_path}/dual/reconstruction/1").to_numpy(), x[own])
    with pytest.raises(SystemExit):
        run(programs.run_tucker, "tucker", "--CoreRank", "2")


def test_files_are_split_by_the_partition_size(spark, tmp_path):
    """A file of many records gives as many tasks as the size asks for; each record is read by one of them."""
    x = np.random.default_rng(2).normal(size=(31, 29))
    path = f"{tmp_path}/t"
    td.write_tensor(TensorFrame(TensorFrame.from_numpy(spark, x, (4, 5)).df.coalesce(1), TensorMeta(x.shape, (4, 5))), path)
    key, tasks = "spark.sql.files.maxPartitionBytes", {}
    before = spark.conf.get(key)
    try:
        for size in ("100", "1000", "3000b", "1g"):
            spark.conf.set(key, size)
            t = td.read_blocks(spark, path)
            tasks[size] = t.df.rdd.getNumPartitions()
            assert np.array_equal(t.to_cells().to_numpy(), x)
    finally:
        spark.conf.set(key, before)
    assert tasks["100"] > tasks["1000"] > tasks["3000b"] > tasks["1g"] == 1

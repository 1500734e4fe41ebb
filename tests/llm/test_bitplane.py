import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from polyad.llm import bitplane as bp
from polyad.llm.tokens import default_tokenizer


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, mode):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(bp.from_planes(bp.to_planes(ids, mode), len(ids), mode), ids)


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_file_round_trip_and_random_access(tmp_path, mode, block):
    rng = np.random.default_rng(3)
    docs = [(i if i != 4 else None, rng.integers(0, 50_000, n).astype(np.uint32)) for i, n in enumerate([1, 50, 0, 7, 1, 300, 2])]
    with pa.OSFile(str(tmp_path / "f"), "wb") as sink:
        w = bp.Writer(sink, mode, block)
        for i, ids in docs:
            w.add([i], ids, np.array([len(ids)]))
        assert w.close() == (len(docs), sum(len(x) for _, x in docs))
    flat = np.concatenate([x for _, x in docs])
    r = bp.Reader(pa.OSFile(str(tmp_path / "f")))
    assert [(d, n, crc) for d, _, n, crc in r.documents()] == [(i, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in docs]
    for a, b in ((0, 1), (3, 40), (0, len(flat)), (5, 5), (len(flat) - 1, len(flat))):
        assert np.array_equal(r.ids(a, b), flat[a:b])


def brute(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(default_tokenizer()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_brute_force(spark):
    rows = [(i * 7 % 50, "word " * (i % 9) + f"text {i} é") for i in range(50)] + [(60, None), (61, ""), (7, "again"), (7, "again"), (None, "no id"), (62, "lengthy words " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, file int")
    got = sorted((tuple(r) for r in bp.bitplane_query(spark, docs).collect()), key=lambda r: r[1])
    assert got == brute(rows)


def test_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in bp.bitplane_query(spark, docs).collect()), key=lambda r: r[1])
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark):
    assert bp.bitplane_query(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_spreads_over_shards_and_repeated_tasks_do_no_harm(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text {i % 50}") for i in range(400)] + [(9, "the same")] * 200 + [(1, "first")], "doc_id long, text string").repartition(6)
    manifest = bp.write_shards(docs, str(tmp_path / "s"), partitions=8)
    assert manifest.count() >= 6 and max(r["n_docs"] for r in manifest.collect()) < 300
    expected = sorted(tuple(r) for r in bp.read_shards(manifest, str(tmp_path / "s")).collect())
    (tmp_path / "s" / "shard-000000-attempt.bpt").write_bytes(b"left by a lost task")
    assert sorted(tuple(r) for r in bp.read_shards(manifest, str(tmp_path / "s")).collect()) == expected
    rows = sorted(expected, key=lambda r: r[1])
    assert len(rows) == 601 and [r[0] for r in rows] == [1] + [7] * 400 + [9] * 200
    assert all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:], strict=False)) and rows[0][1] == 0

import numpy as np
import pytest

from polyad.llm import separator as sp
from polyad.llm.tokens import default_tokenizer


def brute(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
@pytest.mark.parametrize("step", [4, 12, 1 << 20])
def test_ranges_are_stitched(spark, tmp_path, dtype, step):
    rng = np.random.default_rng(1)
    files = {"a": rng.integers(0, 4, 60), "b": [3, 3, 3], "c": [1, 2, 1], "d": [1] * 40 + [3], "e": [3] + [1] * 30}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype).tobytes())
    width = np.dtype(dtype).itemsize
    table = spark.createDataFrame([(n, len(i) * width) for n, i in files.items()] + [("none", 0)], "file string, n_bytes long")
    got = sp.scan_flat(table, str(tmp_path), 3, dtype, step).collect()
    for name, ids in files.items():
        assert sorted((r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in got if r["file"] == name) == brute(list(ids), 3)
    assert not [r for r in got if r["file"] == "none"]


def test_query_counts_all_documents(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (None, "x y"), (902, "same"), (902, "same")], "doc_id long, text string"))
    expected = sorted(((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)
    got = sp.separator_query(spark, docs.withColumn("file", docs.doc_id).withColumn("ordinal", docs.doc_id))
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got.collect()), key=str) == expected


def test_empty_table(spark):
    assert sp.separator_query(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_that_do_not_fit_raise(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    with pytest.raises(ValueError, match="fit"):
        sp.write_flat(docs, str(tmp_path / "a"), end_id=70_000)
    with pytest.raises(Exception, match="fit"):
        sp.write_flat(docs, str(tmp_path / "b"), end_id=3, dtype="u1")
    files, order = sp.write_flat(docs, str(tmp_path / "c"), end_id=70_000, dtype="<u4")
    assert [r["n_tokens"] for r in order.join(sp.scan_flat(files, str(tmp_path / "c"), 70_000, "<u4"), ["file", "ordinal"]).collect()] == [2]

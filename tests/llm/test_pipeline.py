import os

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from polyad.llm import cotrain, perplexity
from polyad.llm.decontam import normal
from polyad.llm.tokens import default_tokenizer

from .test_decontam import brute
from .test_perplexity import brute_stats
from .test_simhash import brute_fp, jaccard, shingles


@pytest.fixture(scope="module")
def stages(spark, sf):
    from polyad.llm.common import materialise

    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in cp.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "decontaminate", "pack"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_classifier_keeps_good_and_drops_bad(spark, stages, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = set(rows(stages[1]))
    ids = lambda model: {r["doc_id"] for r in stages[0].select("doc_id", model.column().alias("s")).where("s.kept").collect()}
    assert kept == ids(cotrain.fit(stages[0], labels))


def test_classifier_on_labels_that_trained_nothing(spark, sf):
    """Each half of the labels against a model of the other half; on the next larger tables, where a half is some two hundred labels."""
    folder = f"{os.path.dirname(sf.rstrip('/'))}/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder if os.path.isdir(folder) else sf}/{t}.parquet") for t in ("documents", "labels"))
    right = []
    for half in (0, 1):
        model = cotrain.fit(docs, labels.where(f"pmod(xxhash64(doc_id), 2) = {half}"))
        scored = docs.select("doc_id", model.column().alias("s")).join(labels, "doc_id").where(f"pmod(xxhash64(doc_id), 2) <> {half}")
        right += [r["kept"] == bool(r["quality"]) for r in scored.select("s.kept", "quality").collect()]
    assert len(right) == labels.count() and np.mean(right) > 0.95


def test_rules_drop_what_fails(spark, stages, sf):
    before, kept = rows(stages[1]), rows(stages[2])
    verdict = {r["doc_id"]: r["kept"] for r in perplexity.quality_query(stages[1], spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    for d, r in before.items():
        n, *_, repeat = brute_stats(r["text"])
        if n < 10 or 100 * repeat > 20 * n:
            assert d not in kept
        assert (d in kept) == verdict[d]


def test_one_of_each_class_stays(stages):
    """No near copies are left, the smallest id of a class stays, and only near copies go."""
    before, kept = rows(stages[2]), rows(stages[3])
    fps = {d: brute_fp(r["text"]) for d, r in before.items()}
    sets = {d: shingles(r["text"]) for d, r in before.items()}
    links = {d: set() for d in before}
    ids = sorted(before)
    for i, a in enumerate(ids):  # all pairs
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3 or jaccard(sets[a], sets[b]) >= 0.8:
                links[a].add(b)
                links[b].add(a)
    assert not [(a, b) for a in kept for b in links[a] if b in kept]
    for d in set(before) - set(kept):
        reached, queue = {d}, [d]
        while queue:
            new = links[queue.pop()] - reached
            reached |= new
            queue += new
        assert min(reached) in kept and min(reached) < d


def test_leaks_go(spark, stages, sf):
    items = [normal(r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, kept = rows(stages[3]), rows(stages[4])
    for d, r in before.items():
        text = normal((r["text"] or "").encode())
        leaked = any(i in text for i in items) or (len(text) < 3000 and any(brute(i, text) is not None for i in items))
        if leaked:
            assert d not in kept
        elif len(text) < 3000:
            assert d in kept


def test_packing_holds_every_token(stages):
    t = Tokenizer.from_file(default_tokenizer())
    total = {}
    for r in stages[5].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {d: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in rows(stages[4]).items()}


def test_run_gives_the_last_stage(spark, stages, sf):
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in cp.run(spark, sf).collect()) == sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in stages[5].collect())


def test_defined_cases(spark, sf, tmp_path):
    """Nulls, empty and long texts, equal rows, ids given twice, columns that clash with names used within, empty tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    one = docs.where("n_chars > 500").limit(1)
    odd = [(None, None, None, None, None), (90001, "", "en", "s", 0), (90002, "few words", "en", "s", 9), (None, "a text without an id " * 3 + "with words of its own that no other has", None, None, 10), (90003, "long " + " ".join(f"word{i}" for i in range(40_000)), "xx", "s", None)]
    given = docs.unionByName(one).unionByName(one).unionByName(spark.createDataFrame(odd, docs.schema))
    names = ["id", "row", "scored", "kept", "mark", "fp", "node", "n", "nll", "__id", "__fp", "chunk"]
    given = given.select("*", *[(given["doc_id"] % 7).alias(c) for c in names])
    for k, (d, fraction) in enumerate([(given, True), (given.limit(0), True), (given, False)]):
        path = f"{tmp_path}/{k}"
        d.write.parquet(f"{path}/documents.parquet")
        for table in ("labels", "benchmark"):
            t = spark.read.parquet(f"{sf}/{table}.parquet")
            (t if fraction else t.limit(0)).write.parquet(f"{path}/{table}.parquet")
        stage = spark.read.parquet(f"{path}/documents.parquet")
        for _, f in cp.STAGES[:-1]:
            stage = f(spark, stage, path)
            assert stage.columns == given.columns
        left = stage.collect()
        assert all(r[c] == (None if r["doc_id"] is None else r["doc_id"] % 7) for r in left for c in names)
        assert len({r["doc_id"] for r in left}) == len(left) and not {90001, 90002} & {r["doc_id"] for r in left}
        packed = {r["doc_id"] for r in cp.run(spark, path).collect()}
        assert packed == {r["doc_id"] for r in left} and bool(left) == (k != 1)

import hashlib
import re

import duckdb
import numpy as np
import pytest

from polyad.llm import rlz

SCHEMA = "doc_id long, text string, b long, row int, word long, source long"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs):
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    for k in order:
        words = split(docs[k][1])
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            key = tuple(words[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((docs[k][0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(n=60, seed=0):
    rng = np.random.default_rng(seed)
    text = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 400, k))
    passages = [text(k) for k in (19, 20, 21, 25, 60, 200)]
    docs = []
    for i in range(n):
        parts = [text(rng.integers(0, 60)) for _ in range(4)]
        for at in rng.integers(0, 4, 2):
            p = passages[rng.integers(len(passages))].split()
            a = rng.integers(0, max(1, len(p) - 20))
            parts[at] += " " + " ".join(p[a : a + rng.integers(15, 80)])
        docs.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    docs += [(n + i, docs[i][1]) for i in range(5)] + [(n + 5 + i, "Hot passage " * 3 + passages[4] + f" end{i}") for i in range(30)]
    # repeats inside a text, one word all over, no-break spaces, texts of 19 and 20 words
    docs += [(200, " ".join([passages[3]] * 4)), (201, "la " * 300), (202, "é à " * 45), (203, passages[0]), (204, passages[1]), (205, None), (206, ""), (207, "\n \t"), (None, passages[5])]
    return docs


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], SCHEMA).repartition(parts)


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000, 1])
def test_equals_brute_force(spark, block_bytes):
    docs = corpus()
    got = rlz.deduplicated(frame(spark, docs), block_bytes=block_bytes, digest=True).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"x{i}" for i in range(30))
    got = rlz.deduplicated(frame(spark, [(1, text), (1, text), (1, "short"), (None, text), (None, text)], 2), block_bytes=1).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 30), (1, 0), (1, 30), (1, 30)]


def test_factors_are_maximal_runs_of_their_source(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = [(1, a), (2, b), (3, f"new {a} mid {b}"), (4, " ".join(a.split()[30:] + b.split()[:30])), (5, " ".join(a.split()[41:] + b.split()[:19]))]
    got = sorted((r["doc_id"], r["start"], r["words"], r["source_word"]) for r in rlz.factors(frame(spark, docs, 1)).collect())
    places = [g[:3] for g in got]
    assert places == [(3, 1, 60), (3, 62, 60), (4, 0, 30), (4, 30, 30), (5, 0, 38)] and got[3][3] - got[2][3] == 30


def test_windows_over_a_factor_boundary(spark):
    # words 10 to 40 of the third text stand in the second, over the boundary of what stands in the first
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    docs = [(1, " ".join(a)), (2, " ".join(a[15:] + b[:15])), (3, " ".join(a + b))]
    got = {(r["start"], r["words"]) for r in rlz.factors(frame(spark, docs, 1)).where("doc_id = 3").collect()}
    assert got == {(0, 30), (15, 30)}


def test_hashes_of_words():
    for text in (b"", b"  ", b"a", b"a b  a\n\x0bb", "é à x".encode()):
        hashes, starts = rlz.word_hashes(np.frombuffer(text, np.uint8))
        words = text.split()
        assert len(hashes) == len(words) and [text[s : s + len(w)] for s, w in zip(starts, words, strict=True)] == words
        assert len(set(hashes.tolist())) == len(set(words))
    assert rlz.word_hashes(np.frombuffer(b"ab a b \x01 \x02", np.uint8))[0][1] == rlz.word_hashes(np.frombuffer(b"zzz a", np.uint8))[0][1]


def test_slices_end_between_words(monkeypatch):
    text = b"abc defgh i " * 50 + b"x" * 500 + b" y"
    want = rlz.word_hashes(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(rlz, "SLICE", 64)
    got = rlz.word_hashes(np.frombuffer(text, np.uint8))
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    one = [b"q%d" % i for i in rng.integers(0, 9, 500)]
    a, b = rlz.Block([b" ".join(one)]), rlz.Block([b"other words", b" ".join([b"z"] * 7 + one[100:300])])
    of = lambda x: dict(zip(zip(*(h.tolist() for h in x.hashes(x.windows())), strict=True), x.anchors(x.windows()).tolist(), strict=True))
    left, right = of(a), of(b)
    common = set(left) & set(right)
    assert len(common) == 181 and all(left[k] == right[k] for k in common)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"n{i % 50_000}" for i in range(120_000))
    got = rlz.deduplicated(frame(spark, [(1, long)], 1), block_bytes=1000).collect()
    assert [(r["n_words"], r["n_removed"]) for r in got] == [(120_000, 70_000)]
    assert rlz.deduplicated(frame(spark, [], 1)).count() == 0 and rlz.factors(frame(spark, [(1, None)], 1)).count() == 0


def test_query_equals_sql(spark, sf):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({entry.oracle_sql()['op11_rlz']})").fetchall()
    assert sorted(want) == sorted(map(tuple, entry.queries()["op11_rlz"](spark, sf).collect()))

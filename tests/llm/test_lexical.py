import re
from collections import Counter
from itertools import combinations
from math import floor, log

import duckdb
import numpy as np
import pytest

from polyad.llm import lexical as lx

SCHEMA = "doc_id long, text string, term string, shard long, n long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df, out = Counter(t for _, c in counts for t in c), []
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    names = np.array([f"w{i}" for i in range(60)] + ["Ünïcode", "日本", "a_b", "X9"])
    p = 1 / np.arange(1, len(names) + 1)
    texts = [" ".join(rng.choice(names, rng.integers(1, 80), p=p / p.sum())) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "-- !"), (None, texts[0]), (3, texts[3]), (n + 3, texts[5]), (n + 4, "w1 " * 5000), (n + 5, "solo")]
    items = [(i, " ".join(rng.choice(names, rng.integers(1, 9)))) for i in range(12)] + [(20, None), (21, ""), (22, "absent"), (23, "SOLO w1, w1"), (0, "w3 w4"), (24, "w0 " + " ".join(names))]
    return docs, [*items, items[1]]


def frames(spark, docs, items, parts=3):
    d = spark.createDataFrame([(*r, "clash", 1, 2) for r in docs], SCHEMA).repartition(parts)
    return d, spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, q string")


@pytest.mark.parametrize(("shard_docs", "k", "block"), [(1 << 16, 50, 1 << 20), (17, 5, 40), (1, 50, 1 << 20)])
def test_equals_brute_force(spark, shard_docs, k, block):
    docs, items = corpus(120 if shard_docs < 100 else 400)
    d, q = frames(spark, docs, items)
    got = lx.LexicalIndex.build(d, shard_docs=shard_docs).search(q, k=k, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, k)


@pytest.mark.parametrize(("width", "cost"), [(64, 5), (3, 2), (64, 0), (64, 10**6)])
def test_blocks_have_the_least_cost(width, cost):
    rng = np.random.default_rng(1)
    lists = [rng.integers(1, 30, n) for n in [1, 2, 9, 9, 5, 7, 1, 10]]
    lengths = np.array([len(x) for x in lists])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    begins = lx.cut(np.concatenate(lists), starts, lengths, cost, width)

    def price(x, cuts):
        parts = np.split(x, cuts)
        return sum(len(p) * max(p) + cost for p in parts) if max(map(len, parts)) <= width else float("inf")

    for x, s in zip(lists, starts, strict=True):
        own = begins[s : s + len(x)]
        assert own[0]
        best = min(price(x, c) for r in range(len(x)) for c in combinations(range(1, len(x)), r))
        assert price(x, np.flatnonzero(own)[1:]) == best


def test_blocks_are_skipped():
    builder = lx.Builder(3000, 60_000)
    for i in range(3000):
        builder.add(i, b"word " * (9 if 1000 <= i < 1064 else 1) + b"x " * (10 if 1000 <= i < 1064 else 18))
    shard = lx.Shard(*next(lx._shards(builder.rows(0))), 3000, 60_000)
    best = lx.Best(10)
    shard.search([("word", 5000)], best)
    assert sorted(best.ids) == list(range(1000, 1010)) and shard.read < len(shard.lists["word"]["docs"]) / 10


def test_counts_of_terms(spark):
    import pyarrow as pa

    texts = [b"", b"a b", b"b", b" c-d ", "é é".encode(), b"", b"x"]
    column = pa.array(texts, pa.binary())
    assert lx.count_terms(column).tolist() == [len(lx.terms(t)) for t in texts]
    assert lx.count_terms(column.slice(2, 3)).tolist() == [1, 2, 2] and lx.count_terms(column.slice(0, 1)).tolist() == [0]


def test_long_arithmetic():
    assert lx.relative_length(np.array([10**7]), 10**11, 10**14).tolist() == [50 + 50 * 10**7 * 10**11 // 10**14]


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_empty(spark, docs, items):
    d, q = frames(spark, docs, items, 1)
    assert lx.lexical_query(d, q).count() == 0


def test_query_equals_sql(spark, sf):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({entry.oracle_sql()['op12_lexical']})").fetchall()
    got = entry.queries()["op12_lexical"](spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(want) == sorted(map(tuple, got))

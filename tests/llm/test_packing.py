import random
from itertools import count

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from polyad.llm import packing as pk
from polyad.llm.tokens import default_tokenizer


@settings(deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([(64,), (16, 64), (8, 16, 32, 64)]))
def test_every_item_once_in_a_bin_that_fits(sizes, lengths):
    bins = pk.pack(sizes, lengths, 4)
    assert sorted(i for _, b in bins for i in b) == list(range(len(sizes)))
    for capacity, members in bins:
        used = sum(sizes[i] for i in members)
        assert capacity == min(c for c in lengths if c >= used)  # downsized


def best_cost(sizes, lengths, overhead):
    """Least cost over all partitions into bins, by subsets."""
    n = len(sizes)
    total = [sum(s for i, s in enumerate(sizes) if k >> i & 1) for k in range(1 << n)]
    cost = [0] + [10**9] * ((1 << n) - 1)
    for k in range(1, 1 << n):
        sub = k
        low = k & -k
        while sub:
            if sub & low and total[sub] <= max(lengths):
                cost[k] = min(cost[k], cost[k ^ sub] + pk.fit(total[sub], sorted(lengths)) + overhead)
            sub = (sub - 1) & k
    return cost[-1]


@pytest.mark.parametrize("seed", range(8))
def test_cost_is_near_the_optimum(seed):
    rng = random.Random(seed)
    sizes, lengths = [rng.randrange(1, 33) for _ in range(9)], (8, 16, 32)
    found = sum(c + 2 for c, _ in pk.pack(sizes, lengths, 2))
    assert found <= 1.3 * best_cost(sizes, lengths, 2)


def test_waste_is_small():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(6, 1, 5000).astype(int) + 1, 8192).tolist()
    bins = pk.pack(sizes)
    assert sum(c for c, _ in bins) < 1.02 * sum(sizes)


def test_cut():
    assert pk.cut(10, 4) == [4, 4, 2] and pk.cut(8, 4) == [4, 4] and pk.cut(1, 4) == [1]


@pytest.mark.parametrize("window", [5, 100_000])
def test_query_covers_all_tokens(spark, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    rows = [(i, "word " * (i * 3)) for i in range(40)] + [(100, None), (101, ""), (None, "no id"), (7, "again"), (7, "again"), (102, "many words " * 1500)]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, bin_id int, capacity int")
    got = pk.pack_documents(docs, lengths=(16, 64, 256), window=window).collect()
    bins = {}
    for r in got:
        bins.setdefault((r["bin_id"], r["capacity"]), []).append(r)
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), members in bins.items():
        used = sum(r["n_tokens"] for r in members)
        assert used <= capacity and capacity == min(c for c in (16, 64, 256) if c >= used)
        assert sorted(r["position"] for r in members) == list(range(len(members)))
    expected = sorted(((i, k, k * 256, n) for i, x in rows for k, n in zip(count(), pk.cut(len(t.encode(x or "", add_special_tokens=False).ids) + 1, 256))), key=str)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["n_tokens"]) for r in got), key=str) == expected
    assert pk.pack_documents(docs.limit(0)).count() == 0


def test_edges_of_scan_tasks_cost_little(spark):
    """Many small tasks: the second round fills what each of them left over."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "word " * int(rng.lognormvariate(4, 1))) for i in range(1500)], "doc_id long, text string").repartition(40)
    spent = {}
    for slack in (pk.SLACK, 1 << 20):  # with so much slack no bin is loose: one round only
        bins = {r["bin_id"]: (r["capacity"], r["used"]) for r in pk.pack_documents(docs, slack=slack).groupBy("bin_id").agg(F.first("capacity").alias("capacity"), F.sum("n_tokens").alias("used")).collect()}
        spent[slack] = sum(c + pk.OVERHEAD for c, _ in bins.values()) / sum(u for _, u in bins.values())
    assert spent[pk.SLACK] < 1.02 < spent[1 << 20]

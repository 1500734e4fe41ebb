import random
import re

import numpy as np
import pytest

from polyad.llm import decontam as dc


def distance(item, text):
    """Least edits of the whole item against any part of the text."""
    prev, at = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    data = np.frombuffer(text, np.uint8)
    for i, c in enumerate(item, 1):
        cur = np.empty_like(prev)
        cur[0] = i
        cur[1:] = np.minimum(prev[:-1] + (data != c), prev[1:] + 1)
        prev = np.minimum.accumulate(cur - at) + at
    return int(prev.min())


def words(rng, n):
    return " ".join("".join(rng.choices(["an", "er", "th", "on", "in", "re", "ed", "st", "é"], k=rng.randrange(1, 5))) for _ in range(n))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = rng.choice("abcxyz ")
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, rng.choice("abcxyz"))
    return "".join(out)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    out = [(i, words(rng, n)) for i, n in enumerate([3, 8, 20, 40, 60, 15, 25])] + [(7, "ab"), (8, ""), (9, None), (10, "Short item text"), (11, "repeat repeat repeat repeat repeat repeat repeat")]
    return [*out, (12, out[3][1]), (None, words(rng, 30))]


def alone(item, text):
    """Whether the item stands in the text and is no part of a longer word."""
    part = r"[0-9a-z\x80-\xff]"
    before = rf"(?<!{part})" if re.match(part.encode(), item) else ""
    after = rf"(?!{part})" if re.match(part.encode(), item[-1:]) else ""
    return re.search(before.encode() + re.escape(item) + after.encode(), text) is not None


def brute(item, text):
    """Edits of the item's best occurrence, None if there is none within a tenth of its length."""
    k = len(item) // 10
    if not k:
        return 0 if alone(item, text) else None
    d = distance(item, text)
    return d if d <= k else None


def test_every_length_is_found_at_its_whole_budget():
    """Items of 8 to 80 bytes with just as many edits as allowed, and one more."""
    rng = random.Random(11)
    for m in range(8, 81):
        item = "".join(rng.choices("abcdefghijklmnop", k=m)).encode()
        finder, texts = dc.Finder([(m, item)]), []
        for more in (0, 1):
            for _ in range(6):
                t = list(item)
                for at in rng.sample(range(m), m // 10 + more):  # substitutions far apart spoil the most q-grams
                    t[at] = ord("z")
                texts.append(b"qq zz " + bytes(t) + b" zz")
            spread = list(item)
            for j in range(m // 10 + more):
                spread[(2 * j + 1) * m // (2 * (m // 10 + more))] = ord("z")
            texts += [b"zq zz " + bytes(spread) + b" zz", b"zz" + bytes(spread) + b"zz"]
        got = {r: e for r, _, e, *_ in finder.find(texts)}
        assert got == {r: d for r, t in enumerate(texts) if (d := brute(item, t)) is not None}, m


@pytest.mark.parametrize("seed", range(4))
def test_finder_matches_brute_force(items, seed):
    rng = random.Random(seed)
    finder = dc.Finder([(i, (t or "").encode()) for i, t in items])
    texts = []
    for _ in range(120):
        _, t = rng.choice([x for x in items if x[1]])
        t = edited(rng, t, rng.randrange(0, max(1, len(t) // 7)))
        texts.append((words(rng, rng.choice([0, 0, 3, 60])) + rng.choice(["", " "]) + t.upper() + "  " + words(rng, rng.choice([0, 0, 3, 60]))).encode())
    texts += [b"", b"x", b" \n "]
    got = {}
    for row, item, edits, start, stop in finder.find(texts):
        got.setdefault(row, []).append((item, edits))
        assert 0 <= start <= stop <= len(dc.normal(texts[row]))
    for r, text in enumerate(texts):
        norm = dc.normal(text)
        expected = []
        for i, t in items:
            t = dc.normal((t or "").encode())
            if t and (d := brute(t, norm)) is not None:
                expected.append((i, d))
        assert sorted(got.get(r, []), key=str) == sorted(expected, key=str)


def test_long_text_is_searched_whole(items):
    rng = random.Random(1)
    filler = words(rng, 300_000)
    finder = dc.Finder([(i, t.encode()) for i, t in items if t])
    cut = dc.CHUNK - 60
    text = f"{filler[:cut]} {items[4][1]} {filler[cut : len(filler) - 5]} {items[3][1]}".encode()
    found = {h[1] for h in finder.find([b"nothing", text]) if h[0] == 1}
    assert {4, 3, 12} <= found


def test_queries_on_rows_of_every_kind(spark, items):
    rng = random.Random(6)
    leak = edited(rng, items[4][1], 5)
    rows = [(1, f"before {leak} after"), (2, words(rng, 80)), (3, None), (4, ""), (None, items[2][1]), (5, f"before {leak} after"), (5, f"before {leak} after")]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, item_id int, edits int")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.find_items(docs, bench).collect()), key=str)
    assert {(1, 4), (5, 4), (None, 2)} <= set(got) and got.count((5, 4)) == 2 and not [g for g in got if g[0] in (2, 3, 4)]
    for size in (dc.ITEM_BLOCK, 200):
        kept = dc.clean_of(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert sorted(((r["doc_id"], r["item_id"]) for r in dc.find_items(docs, bench, block_bytes=200).collect()), key=str) == got
    twice = dc.find_items(docs.where("doc_id = 1"), bench.union(bench)).collect()
    assert len(twice) == 2 * len([g for g in got if g[0] == 1])
    assert dc.clean_of(docs, bench.limit(0)).count() == len(rows) and dc.find_items(docs, bench.limit(0)).count() == 0
    assert dc.find_items(docs.limit(0), bench).count() == 0


def test_blocks_hold_all_items(spark, items):
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    blocks = [b.value for b in dc.Items(bench, block_bytes=200).blocks]
    assert len(blocks) > 2 and sorted((i for b in blocks for i, _, n in b for _ in range(n)), key=str) == sorted((i for i, t in items + items[:2] if t), key=str)


RULE = "-" * 80
REPETITIVE = {
    "item of one phrase": ("ab " * 500, "x " + "ab " * 20_000),
    "longer item and text of one phrase": ("abc de " * 430, "abc de " * 17_000),
    "rule in an item against dashes": (f"first line of words\n{RULE}\nsecond line of some other words", "-" * 100_000),
    "the item amid dashes": (f"first line of words\n{RULE}\nsecond line of some other words", "-" * 50_000 + f" first line of wirds {RULE[3:]} second line of some other words " + "-" * 50_000),
    "one letter": ("a" * 64, "a" * 30_000),
    "item of one phrase, text with a break": ("na " * 40, ("na " * 39 + "stop ") * 400),
    "no repeats in the item": ("the quick brown fox jumps over the lazy dog near the old mill", "the quick " * 5000),
}


@pytest.mark.parametrize("name", REPETITIVE)
def test_repetitive_texts_and_items(name):
    item, text = REPETITIVE[name]
    got = dc.Finder([(1, item.encode())]).find([text.encode()])
    want = brute(dc.normal(item.encode()), dc.normal(text.encode()))
    assert (got == []) == (want is None)
    if got:
        assert got[0][2] == want and distance(dc.normal(item.encode()), dc.normal(text.encode())[got[0][3] : got[0][4]]) == want


def test_memory_stays_bounded_on_repetitive_texts():
    import tracemalloc

    items = [(1, f"first line of words\n{RULE}\nsecond line of some other words".encode()), (2, b"ab " * 1000), (3, b"-" * 300)]
    finder = dc.Finder(items)
    for text, found in ((b"-" * (4 << 20), [3]), (b"ab " * 40_000, [2]), (b"=-" * (1 << 20), [])):
        tracemalloc.start()
        got = finder.find([text])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [g[1] for g in got] == found and peak < 500 << 20


def test_small_steps_give_the_same(monkeypatch, items):
    rng = random.Random(11)
    kept = [(i, (t or "").encode()) for i, t in items]
    texts = [(words(rng, 80) + " " + edited(rng, t, len(t) // 15) + " " + words(rng, 40)).encode() for _, t in items if t]
    want = dc.Finder(kept).find(texts)
    monkeypatch.setattr(dc, "PAIRS", 16)
    assert want and dc.Finder(kept).find(texts) == want

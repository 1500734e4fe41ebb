import random

import numpy as np
import pytest
import xxhash

from polyad.llm import simhash as sh


def brute_fp(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp); least id of each component."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(rows))]


def shingles(text, size=5):
    words = (text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


TEXTS = ["", None, "one", "One", "one two", "a b c", "A  B\n\tc", "a b c d", "É b c", "word " * 5000, "x " * 3 + "\x0b y", " lead and trail ", "ﬀ K z q"]


def test_fingerprint_is_as_defined():
    for t in TEXTS:
        assert sh.fingerprint((t or "").encode()) % 2**64 == brute_fp(t), t


def test_index_covers_every_pair_of_three_bits():
    assert len(sh.SETS) == 14
    for k in range(256):
        if k.bit_count() >= 5:
            assert any(all(k >> p & 1 for p in s) for s in sh.SETS)


@pytest.mark.parametrize(("seed", "most"), [(0, 1 << 16), (1, 1 << 16), (2, 4)])
def test_components_match_brute_force(spark, seed, most, monkeypatch):
    monkeypatch.setattr(sh, "LIST", most)  # at 4, most lists are cut into blocks
    monkeypatch.setattr(sh, "AT_ONCE", 0 if most == 4 else 1 << 20)
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(25)]
    for _ in range(120):  # chains and clusters at distances 0 to 5
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(6)):
            x ^= 1 << b
        fps.append(x)
    rows = list(enumerate(fps)) + [(None, fps[0]), (None, 0), (0, fps[3])]
    rng.shuffle(rows)
    signed = spark.createDataFrame([(d, int(np.uint64(f).astype(np.int64))) for d, f in rows], "doc_id long, fp long")
    named = {r["fp"] % 2**64: r["component_id"] for r in sh.classes(signed).collect()}
    assert [named[f] for _, f in rows] == brute_components(rows)


@pytest.mark.parametrize("at_once", [0, 1 << 20])
def test_long_chain_settles(spark, monkeypatch, at_once):
    monkeypatch.setattr(sh, "AT_ONCE", at_once)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in sh.components(edges).collect()}
    assert set(got) == {*range(41), 100, 101} and {got[i] for i in range(41)} == {0} and got[100] == got[101] == 100


@pytest.mark.parametrize("at_once", [0, 1 << 20])
def test_components_of_random_edges(spark, monkeypatch, at_once):
    monkeypatch.setattr(sh, "AT_ONCE", at_once)
    rng = random.Random(4)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(500, i) for i in range(501, 540)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in sh.components(frame).collect()} == root
    assert sh.components(frame.limit(0)).count() == 0


def test_query_on_rows_of_every_kind(spark):
    rng = random.Random(9)
    base = [rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(400)]
    near = [*base]
    near[7] = "other"
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(200, " ".join(base)), (201, " ".join(near)), (202, " ".join(base)), (202, " ".join(base)), (None, "one"), (50, "one")] + [(300 + i, "hot text of many rows") for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((tuple(r) for r in sh.simhash_query(docs).collect()), key=str)
    fps = [(d, brute_fp(t)) for d, t in rows]
    assert got == sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps), strict=True)), key=str)
    kept = sh.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == set(brute_components(fps)) - {201}


def test_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], brute_fp(r["text"])) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in sh.simhash_query(docs).collect()}
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows), strict=True)}


@pytest.mark.parametrize(("most", "most_bytes"), [(1 << 16, 1 << 25), (3, 1 << 25), (1 << 16, 3000)])
def test_sketches_link_near_copies_and_nothing_else(spark, most, most_bytes, monkeypatch):
    monkeypatch.setattr(sh, "LIST", most)
    monkeypatch.setattr(sh, "LIST_BYTES", most_bytes)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, source = [], {}
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.randrange(60, 400))
        for copy in range(5):
            text = list(words)
            for _ in range(max(1, len(words) // 60) if copy else 0):  # well above a similarity of 0.8
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((base * 5 + copy, " ".join(text)))
            source[base * 5 + copy] = base * 5
        half = [*words[: len(words) // 2], *rng.choices(vocabulary, k=len(words) // 2)]  # shares half of the text
        rows.append((1000 + base, " ".join(half)))
        source[1000 + base] = 1000 + base
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in sh.deduplicated(docs).collect()} == set(source.values())


def test_agreement_of_sketches_is_the_similarity():
    rng, found = random.Random(5), []
    for _ in range(60):
        words = [str(rng.randrange(10**6)) for _ in range(rng.choice([30, 300, 3000]))]
        other = list(words)
        for _ in range(len(words) * rng.randrange(0, 6) // 100):
            other[rng.randrange(len(other))] = "x"
        a, b = (np.frombuffer(sh.sketch(" ".join(t).encode()), np.uint8) for t in (words, other))
        found.append((a == b).mean() - jaccard(shingles(" ".join(words)), shingles(" ".join(other))))
    assert abs(np.mean(found)) < 0.02 and np.std(found) < 0.06
    assert sh.sketch(b" \n") is None and sh.sketch(b"one") == sh.sketch(b"ONE ")


def test_only_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r["component_id"] for r in sh.simhash_query(docs).collect()] == [None, None]
    assert sh.deduplicated(docs).count() == 1
    assert sh.simhash_query(docs.limit(0)).count() == 0


def clusters(docs, linked):
    """The least id of each chain of linked (doc_id, text)."""
    least, left = set(), dict(docs)
    while left:
        d = min(left)
        least.add(d)
        queue = [(d, left.pop(d))]
        while queue:
            x = queue.pop()
            for o in [o for o in left if linked(x[1], left[o])]:
                queue.append((o, left.pop(o)))
    return least


def test_links_are_exactly_the_pairs_of_the_similarity(spark):
    """Pairs spread around 0.8: at it and above they go, below they stay."""
    rng, rows = random.Random(21), []
    for k in range(150):
        words = [f"w{k}x{i}" for i in range(rng.choice([60, 200]))]
        other = list(words)
        for i in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.015, 0.05)))):
            other[i] = f"other{k}x{i}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sims = [jaccard(shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in range(0, 300, 2)]
    assert sum(0.7 < s < 0.8 for s in sims) > 20 and sum(0.8 <= s < 0.86 for s in sims) > 20
    def linked(a, b):
        return a[1] == b[1] or (a[0] ^ b[0]).bit_count() <= 3 or jaccard(a[2], b[2]) >= 0.8
    facts = [(d, (brute_fp(t), t, shingles(t))) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in sh.deduplicated(docs).collect()} == clusters(facts, linked)


def test_texts_of_one_fingerprint_keep_their_own_links(spark, monkeypatch):
    """Two texts of one fingerprint: each has near copies that the other hasn't."""
    rows = []
    for k in range(4):
        words = [f"w{k}x{i}" for i in range(100)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words[:50], "other", *words[51:]]))]
    # all four originals have one fingerprint, their copies have fingerprints far apart
    fps = {t.encode(): 0 if d % 10 == 0 else int(np.uint64(0xFFFF << (16 * (d // 10))).astype(np.int64)) for d, t in rows}
    marks = spark.createDataFrame([(d, t, fps[t.encode()], sh.sketch(t.encode()), d) for d, t in rows], "doc_id long, text string, fp long, sketch binary, node long")
    got = sh.classes(marks, sketch_col="sketch").collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 5


def test_lists_are_cut_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sh, "LIST_BYTES", 1000)
    rows = spark.createDataFrame([(i, 1, 1, "x" * 100) for i in range(60)] + [(100 + i, 1, 2, "x" * 900) for i in range(2)], "fp long, set int, key int, text string")
    lists = [[m["fp"] for m in r["m"]] for r in sh.postings(rows, F.struct("fp", "text"), size=F.length("text")).collect()]
    met = {frozenset((a, b)) for m in lists for a in m for b in m if a < b}
    assert met == {frozenset((a, b)) for a in range(60) for b in range(a)} | {frozenset((100, 101))} and max(map(len, lists)) <= 25

import math
import random
import re
from collections import Counter

import numpy as np

from polyad.llm import perplexity as px


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def brute_discounts(c):
    n = [sum(v == i for v in c.values()) for i in range(1, 5)]
    if not all(n):
        return [0, 0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0, *(min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95), strict=True))]


def pairs_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return list(zip(["", *words], words, strict=False))


def brute_nll(texts):
    """Mean negative log probability of each text's words, by a modified Kneser-Ney model of word pairs from dictionaries;
    each word is judged with one occurrence of its pair taken away, the discounts and the lowest level's sums being those of all."""
    c2 = Counter(p for t in texts for p in pairs_of(t))
    c1 = Counter(b for _, b in c2)
    d2, d1 = brute_discounts(c2), brute_discounts(c1)
    rest = sum(d1[min(v, 3)] for v in c1.values()) / len(c2) / len(c1)
    follow: dict = {}
    for (a, b), n in c2.items():
        follow.setdefault(a, Counter())[b] = n

    def p(a, b):
        own = follow[a]
        own[b] -= 1
        left, total = c1[b] - (not own[b]), sum(own.values())
        p1 = max(left - d1[min(left, 3)], 0) / len(c2) + rest
        out = p1
        if total:
            out = max(own[b] - d2[min(own[b], 3)], 0) / total + sum(d2[min(x, 3)] for x in own.values()) / total * p1
        own[b] += 1
        return out

    memo: dict = {}
    return [-sum(math.log(memo.get(g) or memo.setdefault(g, p(*g))) for g in pairs_of(t)) / len(pairs_of(t)) for t in texts]


def brute_kept(scored, labels=None):
    """doc_id: whether inside the band; scored: (doc_id, n_words, nll) of one language that pass the base rules."""
    good = [r for r in scored if labels is not None and r[0] in labels]
    fit = lambda x, y: np.polyfit(x, y, 1) if np.ptp(x) else (0.0, y.mean())

    def band(of, by_label):
        x, y = np.array([1 / r[1] for r in of]), np.array([r[2] for r in of])
        slope, value = fit(x, y)
        r = y - value - slope * x
        steep, flat = fit(x, r * r)
        if not (flat > 0 and steep >= 0):
            steep, flat = 0.0, (r * r).mean()
        q = np.quantile(r / np.sqrt(flat + steep * x), [px.TAIL, 0.25, 0.5, 0.75, 1 - px.TAIL])
        far, wide = px.ROBUST * (q[3] - q[1]) / 1.349, px.MARGIN * (q[4] - q[0])
        return np.array([value, slope, flat, steep, *((q[0] - wide, q[4] + wide) if by_label else (min(q[0], q[2] - far), max(q[4], q[2] + far)))])

    w = len(good) ** 2 / (len(good) ** 2 + px.HALF_GOOD**2)
    value, slope, flat, steep, low, high = (w * band(good, True) if good else 0) + (1 - w) * band(scored, False)
    z = lambda n, s: (s - value - slope / n) / np.sqrt(flat + steep / n)
    return {d: (bool(low <= z(n, s) <= high), min(abs(z(n, s) - low), abs(z(n, s) - high))) for d, n, s in scored}


def test_codec():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64), np.array([2**64 - 1], np.uint64)):
        assert (px.expand(px.squeeze(values)) == values).all() and len(px.expand(px.squeeze(values))) == len(values)
        assert (px.expand_sorted(px.squeeze_sorted(np.sort(values))) == np.sort(values)).all()


def test_chunk_files(tmp_path):
    texts = ["a b a c", "c", "a b b b b a ü"]
    chunks = px.Chunks(f"file:{tmp_path}/new")
    assert [chunks.add("x", t.encode().split())[1] for t in texts] == [0, 1, 2]
    name = chunks.open["x"][0]
    chunks.write()
    chunk = px.read_chunk(*px.open_fs(f"file:{tmp_path}/new"), name)
    assert chunk.lengths.tolist() == [4, 1, 7] and len(chunk.hashes) == 5
    word = {h: i for i, h in enumerate(chunk.hashes.tolist())}
    from xxhash import xxh64_intdigest

    number = lambda w: word[xxh64_intdigest(w) >> 16 if w else 0]
    expected = [(number(a.encode()), number(b.encode())) for t in texts for a, b in pairs_of(t)]
    assert [(int(chunk.first[i]), int(chunk.second[i])) for i in chunk.of] == expected
    cut = px._cut("s", "c", 48, 7, chunk.word_keys(48)[0], [np.arange(5)])
    assert np.concatenate([px.expand_sorted(r[5]) for r in cut]).tolist() == sorted(chunk.hashes.tolist())


def test_repeated_words_of_large_vocabularies():
    rng = random.Random(0)
    for size in (3, 5000):
        words = [f"w{rng.randrange(size)}" for _ in range(9000)]
        words[5000:5040] = words[100:140]
        assert px.repeated_words([w.encode() for w in words]) == brute_stats(" ".join(words))[4]


def rows():
    rng = random.Random(8)
    out = [None, "", "one two", "a b c d e f g h i j", "line one\nline one\n\n\n \n \nx", "# * $ % & | < > | x", "\x0b\x0c  \t", "é ü " * 20, "word " * 30_000]
    for _ in range(80):
        out.append(" ".join(rng.choice(["the", "of", "and", "to", "in", "that", "model", "text", "words", "plain"]) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 200))))
    out += ["".join(chr(rng.randrange(0x4E00, 0x9000)) + " " for _ in range(300)), " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=20)) for _ in range(150)), " ".join("a" * k for k in range(12, 120))]
    return out


def test_query_base_columns_and_bands(spark):
    all_rows = [(i, t, "en", 1, True) for i, t in enumerate(rows())] + [(None, "null id " * 6, None, 1, True), (3, "a b c d e f g h i j", "en", 1, True), (500, "only text of its language, which has more than ten words in it", "xx", 1, True)]
    docs = spark.createDataFrame(all_rows, "doc_id long, text string, lang string, nll int, kept boolean")
    got = px.quality_query(docs).collect()
    key = lambda r: (str(r[0]), r[1:6])
    expected = sorted(((i, *brute_stats(t)) for i, t, *_ in all_rows), key=lambda r: (str(r[0]), r[1:6]))
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=key) == expected
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    by_id = {r["doc_id"]: r for r in got}
    n = len(rows())
    clean = [by_id[i] for i in range(9, n - 3) if not by_id[i]["base_failed"]]
    assert clean and all(r["kept"] for r in clean)
    assert by_id[500]["kept"]
    kept = px.passing(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def corpus(seed=12, good=900):
    rng = random.Random(seed)
    stock = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(stock, k=rng.randrange(20, 400))), "en") for i in range(good)]
    bad = [(1000 + i, " ".join(rng.choice(stock) if rng.random() < 0.7 else "".join(rng.choices("abcdefghij", k=5)) for _ in range(rng.randrange(20, 400))), "en") for i in range(40)]
    return rows, bad


def test_scores_and_bands_match_brute_force(spark, monkeypatch):
    """Several chunks and groups, three languages, the null one among them, rows that fail the base rules, and columns that clash."""
    monkeypatch.setattr(px, "KEY_BITS", 40)
    good, bad = corpus(good=300)
    rng = random.Random(3)
    other = [(3000 + i, " ".join(rng.choice("αβγδεζ") * rng.randrange(1, 4) for _ in range(rng.randrange(10, 30))), rng.choice(["el", None])) for i in range(60)]
    all_rows = [(*r, True, 1, "x") for r in [*good, *bad, *other, (5000, "too few words", "en"), (5001, None, "en"), (5002, "same " * 40, "en"), good[0]]]
    docs = spark.createDataFrame(all_rows, "doc_id long, text string, lang string, kept boolean, row int, mark string").repartition(5)
    labels = spark.createDataFrame([(d, 1) for d, *_ in good] + [(good[0][0], 1), (None, 1)] + [(d, 0) for d, *_ in bad], "doc_id long, quality int")
    banded = {r[0] for r in labels.where(px.of_band()).collect() if r[0] is not None and r[0] < 1000}
    for given in (None, labels):
        got = px.judge(docs, labels=given).select("row.doc_id", "row.lang", "mark.n_words", "base_failed", "nll", "kept").collect()
        assert len(got) == len(all_rows)
        for lang in ("en", "el", None):
            own = [r for r in got if r["lang"] == lang and not r["base_failed"]]
            texts = {r[0]: r[1] for r in all_rows}
            expected = dict(zip([r["doc_id"] for r in own], brute_nll([texts[r["doc_id"]] for r in own]), strict=True))
            assert all(abs(r["nll"] - expected[r["doc_id"]]) < 1e-6 for r in own)
            verdict = brute_kept([(r["doc_id"], r["n_words"], r["nll"]) for r in own], banded if given is not None else None)
            assert all(r["kept"] == verdict[r["doc_id"]][0] for r in own if verdict[r["doc_id"]][1] > 0.02)
        assert all(r["nll"] is None and not r["kept"] for r in got if r["base_failed"]) and sum(r["base_failed"] for r in got) >= 3
    kept = px.passing(docs, labels=labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_hashes_may_meet(spark, monkeypatch):
    """With hardly more bits than pairs many hashes meet: scores suffer, but stay finite, and every row is judged."""
    monkeypatch.setattr(px, "KEY_BITS", -2)
    monkeypatch.setattr(px, "LEAST_BITS", 1)
    good, bad = corpus(good=40)
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string").repartition(3)
    got = px.judge(docs).collect()
    assert len(got) == 80 and all(r["base_failed"] or math.isfinite(r["nll"]) for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert px.quality_query(docs).count() == 0 and px.passing(docs).columns == docs.columns


def test_bands_reject_noise_and_keep_the_rest(spark):
    """Stock words mixed with random ones lie outside the labelled documents' range."""
    good, bad = corpus()
    docs = spark.createDataFrame(good + bad + [(2000, "one text of another language with more than ten words in it", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in good] + [(d, 0) for d, *_ in bad], "doc_id long, quality int")
    kept = {r["doc_id"] for r in px.quality_query(docs, labels).where("kept").collect()}
    failed = {r["doc_id"] for r in px.quality_query(docs).where("base_failed").collect()}
    assert len({d for d, *_ in bad} & kept) <= 2
    assert len({d for d, *_ in good} - failed - kept) <= 20 and 2000 in kept


def test_every_language_has_its_own_model(spark, monkeypatch):
    """Thirty languages that share their words but not their order: a document scores by its own language only."""
    monkeypatch.setattr(px, "KEY_BITS", 40)
    rng = random.Random(3)
    words, rows_ = [f"w{i}" for i in range(80)], []
    for k in range(30):
        after = {w: rng.sample(words, 12) for w in words}
        for i in range(6):
            text = [rng.choice(words)]
            while len(text) < 60:
                text.append(rng.choice(after[text[-1]]))
            rows_.append((100 * k + i, " ".join(text), f"l{k}"))
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    got = {r[0]: r for r in px.judge(docs).select("row.doc_id", "mark.slot", "nll", "base_failed").collect()}
    assert {r["slot"] for r in got.values()} == {f"lang l{k}" for k in range(30)}
    for lang in ("l0", "l1", "l29"):
        of = [r for r in rows_ if r[2] == lang and not got[r[0]]["base_failed"]]
        for (d, *_), expected in zip(of, brute_nll([t for _, t, _ in of]), strict=True):
            assert abs(got[d]["nll"] - expected) < 1e-6


def test_the_stored_model_scores_other_documents(spark, tmp_path):
    good, bad = corpus(good=120)
    rng = random.Random(5)
    other = [(3000 + i, " ".join(rng.choice("αβγδεζ") * rng.randrange(1, 4) for _ in range(30)), "el") for i in range(20)]
    docs = spark.createDataFrame([*good, *other, (9, "too few", "en")], "doc_id long, text string, lang string").repartition(3)
    px.fit(docs).save(f"file://{tmp_path}/model")
    model = px.Model.load(spark, f"file://{tmp_path}/model")
    assert model.pairs.where("keys IS NULL").count() == 0 and model.words.count() > 0
    new = [*bad[:10], (1, good[0][1] + " never seen words at the end", "en"), (2, other[0][1], "el"), (3, "a language without a model " * 2 + "one two three", "xx"), (4, None, "en"), (5, "few", "el")]
    got = {r["doc_id"]: r["nll"] for r in model.score(spark.createDataFrame([(*r, 1.0) for r in new], "doc_id long, text string, lang string, nll double")).select("row.doc_id", "nll").collect()}
    for lang, texts in (("en", [t for _, t, _ in good]), ("el", [t for _, t, _ in other])):
        texts = [t for t in texts if not brute_stats(t)[4] * 100 > 20 * brute_stats(t)[0] and brute_stats(t)[0] >= 10]
        c2 = Counter(p for t in texts for p in pairs_of(t))
        c1 = Counter(b for _, b in c2)
        d2, d1 = brute_discounts(c2), brute_discounts(c1)
        rest = sum(d1[min(v, 3)] for v in c1.values()) / len(c2) / len(c1)
        follow: dict = {}
        for (a, b), n in c2.items():
            follow.setdefault(a, []).append(n)
        for d, text, own in new:
            if own != lang or d in (4, 5):
                continue
            total = 0.0
            for a, b in pairs_of(text):
                p = (c1[b] - d1[min(c1[b], 3)]) / len(c2) + rest
                if a in follow:
                    n = c2[a, b]
                    p = (n - d2[min(n, 3)]) / sum(follow[a]) + sum(d2[min(x, 3)] for x in follow[a]) / sum(follow[a]) * p
                total -= math.log(p)
            assert abs(got[d] - total / len(pairs_of(text))) < 1e-6
    assert got[3] is None and got[4] is None and got[5] is None

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyad.llm import cotrain as ct

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


def rows(n=600, seed=1):
    """Good and bad texts; the source tells the class four times out of five."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.8
        word = lambda: "".join(rng.choices("aeiourstnl", k=rng.randrange(2, 8)))
        text = " ".join(word() if good else word().upper() + "!!" for _ in range(rng.randrange(15, 60)))
        source = f"s{int(good) if rng.random() < 0.8 else rng.randrange(2)}"
        out.append((i, text, rng.choice(["en", "de", None]), source, len(text), 0.0, False, int(good)))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([r[:7] for r in data], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[7]) for r in data if r[0] % 3 == 0], "doc_id long, quality int")
    model = ct.fit(docs, labels)
    got = {r["doc_id"]: r for r in ct.quality_query(docs, labels).collect()}
    held = [r for r in data if r[0] % 3]
    assert np.mean([got[r[0]]["kept"] == bool(r[7]) for r in held]) > 0.97
    # calibrated: mean probability near the rate of good documents
    assert abs(np.mean([got[r[0]]["score"] for r in held]) - np.mean([r[7] for r in held])) < 0.05
    assert any(t["meta"] for t in model.taught)  # the text view taught the metadata view


def test_a_view_without_confidence_teaches_nothing():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.7).astype(float)
    x, m = y[:, None] + rng.normal(0, 0.1, (400, 1)), rng.normal(0, 1, (400, 2))
    views = {"text": ct.View.fit(x[::2], y[::2]).calibrate(x[1::2], y[1::2]), "meta": ct.View.fit(m[::2], y[::2]).calibrate(m[1::2], y[1::2])}
    given = ct.pseudo_labels(views, x, m)
    assert (given["text"] == -1).all() and (given["meta"] == y).mean() > 0.9


def brute_words(rows):
    """Buckets of the largest chi-squared, over labelled rows that train."""
    own = [(set(np.frombuffer(w, "<u2").tolist()), y) for w, y, h in zip(rows["w"].to_pylist(), rows["y"].to_pylist(), rows["held"].to_pylist(), strict=True) if y is not None and not h]
    bad, good, scored = sum(not y for _, y in own), sum(bool(y) for _, y in own), []
    for w in {b for s, _ in own for b in s}:
        g, b = sum(w in s and y for s, y in own), sum(w in s and not y for s, y in own)
        left = len(own) - g - b
        if g + b >= ct.LEAST_SEEN and left >= ct.LEAST_SEEN:
            scored.append((-((g * bad - b * good) ** 2) * len(own) / ((g + b) * left * bad * good), w))
    return [w for _, w in sorted(scored)[: ct.SELECTED]]


def brute(spark, docs, labels, rounds):
    """Co-training on plain arrays: all rows at once, no samples."""
    found = ct.featured(docs, labels).withColumn("held", ct.held_out()).orderBy("rank", "id").toArrow()
    words = np.array(sorted(brute_words(found)), np.int64)
    x, m = ct.matrices(found, words)
    y = np.array([np.nan if v is None else v for v in found["y"].to_pylist()])
    known, held = ~np.isnan(y), np.array(found["held"].to_pylist())
    train, calibrate, both = known & ~held, known & held, {"text": x, "meta": m}
    extra = {v: (np.zeros(0, int), np.zeros(0)) for v in both}
    taught = []
    for r in range(rounds + 1):
        views = {v: ct.View.fit(np.vstack([f[train], f[extra[v][0]]]), np.concatenate([y[train], extra[v][1]])).calibrate(f[calibrate], y[calibrate]) for v, f in both.items()}
        if r < rounds:
            p = {v: 1 / (1 + np.exp(-views[v].logit(f))) for v, f in both.items()}
            for teacher, pupil in (("text", "meta"), ("meta", "text")):
                sure = {c: np.flatnonzero(~known & ((p[teacher] >= ct.CONFIDENT) if c else (p[teacher] <= 1 - ct.CONFIDENT))) for c in (1, 0)}
                extra[pupil] = np.concatenate([sure[1], sure[0]]), np.concatenate([np.ones(len(sure[1])), np.zeros(len(sure[0]))])
            taught.append({v: len(extra[v][0]) for v in both})
    logits = np.stack([views["text"].logit(x[calibrate]), views["meta"].logit(m[calibrate])], 1)
    return ct.CoTrained(views["text"], views["meta"], ct.logistic(logits, y[calibrate], 1e-3), 0.5, taught, words), x, m


def test_rounds_match_brute_force(spark):
    data = rows(500)
    docs = spark.createDataFrame([r[:7] for r in data], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(r[0], r[7]) for r in data if r[0] % 4 == 0], "doc_id long, quality int")
    for rounds in (1, 2):
        model = ct.fit(docs, labels, rounds=rounds)
        expected, x, m = brute(spark, docs, labels, rounds)
        assert model.taught == expected.taught and any(t["meta"] for t in model.taught)
        assert model.words.tolist() == expected.words.tolist() and np.allclose(model.scores(x, m), expected.scores(x, m), atol=1e-6)


def test_defined_cases(spark):
    odd = [(900, None, None, None, None, None, None), (901, "", "en", "s1", 0, None, None), (None, "some words here", "en", "s1", 15, None, None), (902, "x" * 200_000, "en", "s1", 200_000, None, None), (902, "x" * 200_000, "en", "s1", 200_000, None, None)]
    data = rows(300)
    docs = spark.createDataFrame([r[:7] for r in data] + odd, SCHEMA)
    labels = spark.createDataFrame([(r[0], r[7]) for r in data] + [(1, None), (None, 1), (2, data[2][7]), (5000, 1)], "doc_id long, quality int")
    got = ct.quality_query(docs, labels).collect()
    assert len(got) == 305 and all(0 <= r["score"] <= 1 for r in got)
    pair = [r for r in got if r["doc_id"] == 902]
    assert pair[0] == pair[1]
    for given in (labels.limit(0), labels.where("quality = 1")):
        neutral = ct.quality_query(docs, given).collect()
        assert all(r["score"] == 0.5 and r["kept"] for r in neutral)
    assert ct.quality_query(docs.limit(0), labels).count() == 0


def test_training_is_repeatable_and_bounded(spark):
    data = rows(300)
    docs = spark.createDataFrame([r[:7] for r in data], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[7]) for r in data], "doc_id long, quality int")
    a, b = (ct.fit(d, labels.where("doc_id % 2 = 0"), most_labels=100, most_taught=20) for d in (docs, docs.repartition(7), ))
    assert np.allclose(a.text.weights, b.text.weights) and np.allclose(a.combine, b.combine)


@pytest.mark.parametrize("args", [(None, None, None), ("en", "src", 10**18), ("", "", 0)])
def test_metadata_features(args):
    assert ct.meta_features(*args).sum() == 3


def test_a_repeated_id_does_not_reach_the_driver_whole(spark):
    """One labelled id with 3,000 rows, equal or different, is one training row."""
    data = rows(200)
    for same in (True, False):
        hot = [(7, f"some words of text {0 if same else i}", "en", "s1", 20, 0.0, True) for i in range(3000)]
        docs = spark.createDataFrame([r[:7] for r in data] + hot, SCHEMA)
        labels = spark.createDataFrame([(r[0], r[7]) for r in data], "doc_id long, quality int")
        features = ct.featured(docs, labels)
        known = ct.first_of_id(features.where("y IS NOT NULL"))
        assert features.count() == 3200 and known.count() == 200
        hot = features.where("id = 7")
        assert len(ct.least_ranked(hot, 2.0, "x", "w")) == (2 if same else hot.select("x", "w").distinct().count())
        assert len(ct.least_ranked(features, 100 / 3200, "x", "w")) < 200
        assert ct.fit(docs, labels, most_labels=100, most_taught=20).text is not None


def test_text_features():
    f = lambda t: ct.text_features(t)[0]
    assert f(b"").sum() == 0 and f("ü b c".encode()).dtype == np.uint8 and len(f(b" ")) == ct.N_TEXT
    words = [f"w{i}".encode() for i in range(300)]
    assert (f(b" ".join(words)) != f(b" ".join(sorted(words, reverse=True))))[256 : 256 + ct.GRAMS].any()  # 2-grams see the order
    buckets = ct.text_features(b"one two two three")[1]
    assert len(buckets) == 3 and buckets.tolist() == sorted(buckets.tolist()) and not len(ct.text_features(b" ")[1])
    x = ct.with_words(np.zeros((2, 3)), [buckets, np.empty(0, np.uint16)], np.array([int(buckets[1]), 65536]))
    assert x.tolist() == [[0, 0, 0, 255, 0], [0] * 5]


def test_words_tell_where_the_rest_does_not(spark):
    """Classes that differ in a few words among many, of the same letters and lengths."""
    rng = random.Random(4)
    stock = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    data = []
    for i in range(1200):
        good = rng.random() < 0.6
        text = rng.choices(stock[40:], k=60) + rng.choices(stock[:20] if good else stock[20:40], k=3)
        rng.shuffle(text)
        data.append((i, " ".join(text), "en", "s", 300, 0.0, False, int(good)))
    docs = spark.createDataFrame([r[:7] for r in data], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[7]) for r in data if r[0] % 2], "doc_id long, quality int")
    right = {}
    for selected in (0, ct.SELECTED):
        model = ct.fit(docs, labels, selected=selected)
        kept = {r["doc_id"]: r["kept"] for r in docs.select("doc_id", model.column().alias("m")).select("doc_id", "m.kept").collect()}
        right[selected] = np.mean([kept[r[0]] == bool(r[7]) for r in data if r[0] % 2 == 0])
    assert right[ct.SELECTED] > 0.9 > right[0]

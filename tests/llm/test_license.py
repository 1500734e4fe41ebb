import random
import re

import duckdb
import pytest

from polyad.llm import license as lic

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def brute(doc_id, text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for label, phrase in lic.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 0.0
    for label, t in lic.TEMPLATES:
        block = 64
        while block < 2 * len(t.split()):
            block *= 2
        t = set(t.split())
        for i in range(0, max(len(words), 1), block // 2):
            held = t & set(words[i : i + block])
            if len(held) >= lic.THRESHOLD * len(t):
                labels.add(label)
                score = max(score, len(held) / len(t))
    return (doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def texts():
    rng = random.Random(2)
    out = [None, "", "...", "Under the MIT License", "under-the_mit.license!", "underthe mit license", "xunder the mit license", "under the mit licenses under the MIT\nlicense", "Apache License, Version 2.0 and CC BY-NC, cc by nc", "CC-BY-NC" * 3, "Licensed under CC BY-NC 4.0.", "licensed under the apacKe license", "é" * 50, "cc by ncé", "a " * 50_000 + "under the mit license", "GNU General Public License version 3, licensed under the"]
    filler = "the of and some other words to fill a text with license in it".split()
    for _ in range(60):
        w = [rng.choice(filler) for _ in range(rng.randrange(150))]
        t = rng.choice(lic.TEMPLATES)[1].split()
        t = [x for x in t if rng.random() > rng.choice([0, 0.1, 0.3])]
        rng.shuffle(t)
        at = rng.randrange(len(w) + 1)
        out.append(" ".join([*w[:at], *(x.title() for x in t), *w[at:]]))
    return out


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (None, "under the mit license"), (3, "Under the MIT License"), (3, "else")]


def test_matches_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, labels string, score int")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in lic.scan_licenses(docs).collect()), key=str)
    assert got == sorted((brute(*r) for r in rows), key=str)


def test_whole_licences_are_found_wherever_they_stand(spark):
    """Each template verbatim at any offset scores 1; with a tenth of its words replaced it is found; a longer template than any known too."""
    rng = random.Random(5)
    long = ("own", " ".join(f"clause{i}" for i in range(700)))
    rows = []
    for k, (_, t) in enumerate([*lic.TEMPLATES, long]):
        for j, at in enumerate((0, 20, 45, 333)):
            w = t.split()
            if j == 3 and len(w) > 20:  # a tenth of the different words, all their places
                gone = set(rng.sample(sorted(set(w)), len(set(w)) // 10))
                w = [f"x{i}" if x in gone else x for i, x in enumerate(w)]
            rows.append((10 * k + j, " ".join([*(f"before{i}" for i in range(at)), *w, *(f"after{i}" for i in range(50))])))
    templates = (*lic.TEMPLATES, long)
    got = {r["doc_id"]: r for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    for k, (label, _) in enumerate(templates):
        assert all(label in got[10 * k + j]["labels"].split(",") for j in range(4)), label
        assert all(got[10 * k + j]["score"] == 1 for j in range(3)), label


def test_runs_no_python(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = lic.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert lic.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("table", ["cases", "data"])
def test_sql(spark, sf, table, rows):
    con = duckdb.connect()
    if table == "cases":
        docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows) if len(t or "") < 10_000], "doc_id long, text string")
        frame = docs.toPandas()  # noqa: F841
        con.execute("CREATE TABLE documents AS SELECT doc_id, text FROM frame")
    else:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in lic.scan_licenses(docs).collect()), key=str)
    assert got == sorted(con.execute(lic.SQL).fetchall(), key=str)

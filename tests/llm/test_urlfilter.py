import re
import time

import duckdb
import pytest

from polyad.llm import urlfilter as uf

CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("example.com/en/", "", "", None, "allow"),
    ("http://EXAMPLE.com/en/x?y#z", "example.com", "/en/x", "example.com/en/", "block"),
    ("http://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?x=/en/", "example.com", "", None, "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://casino.com/", "casino.com", "/", "com/", "allow"),
    ("http://casino.org/", "casino.org", "/", None, "block"),
    ("http://casinos.org/", "casinos.org", "/", None, "allow"),
    ("http://my-casino-1.org/", "my-casino-1.org", "/", None, "block"),
    ("http://free.org/", "free.org", "/", None, "allow"),
    ("http://free.org/free/FREE", "free.org", "/free/FREE", None, "allow"),
    ("http://free.org/a?q=Pills", "free.org", "/a", None, "block"),
    ("http://x.org/écasino", "x.org", "/écasino", None, "block"),
    ("http://HÉ.org/#a://b", "hÉ.org", "/", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("x://" + "a" * 200_000 + ".org/", "a" * 200_000 + ".org", "/", None, "allow"),
]


def test_cases(spark):
    rows = [(i, c[0], "clash", "clash") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "again", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.url_query(pages).collect()}
    for i, c in enumerate(CASES):
        assert got[i] == c[1:], c[0] and c[0][:80]
    assert uf.url_query(pages.limit(0)).count() == 0


def test_terms_match_a_pattern_search():
    f = uf.UrlFilter()
    a, hosts = f.automaton(), f.by_host()
    for url in (c[0] for c in CASES if c[0] and "://" in c[0]):
        text = url.partition("://")[2].translate(uf.ASCII_LOWER)
        hits = lambda terms: sum(bool(re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text)) for t in terms)  # noqa: B023, E731
        assert f.judge(url, a, hosts)[4:6] == (hits(f.strict), hits(f.soft))


@pytest.mark.parametrize("table", ["cases", "data"])
def test_sql(spark, sf, table):
    con = duckdb.connect()
    if table == "cases":
        pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string")
        frame = pages.toPandas()  # noqa: F841
        con.execute("CREATE TABLE pages AS SELECT * FROM frame")
    else:
        pages = spark.read.parquet(f"{sf}/pages.parquet")
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted((tuple(r) for r in uf.url_query(pages).collect()), key=str)
    assert got == sorted(con.execute(uf.SQL).fetchall(), key=str)


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", None), ("bad", 1.0), ("one", 1.0), ("two", 1.5), ("two", 0.5), (None, 1.0), ("", None)], "term string, weight double")
    f = uf.UrlFilter.from_table(terms)
    assert f.strict == ("bad",) and f.soft == {"one": 1.0, "two": 1.5}
    with pytest.raises(ValueError, match="over 2"):
        uf.UrlFilter.from_table(terms, most=2)
    urls = spark.createDataFrame([("http://x.org/bad",), ("http://x.org/one-two",), ("http://x.org/one-one",), ("http://x.org/badly",)], "url string")
    assert [r["v"]["verdict"] for r in urls.select(f.column("url").alias("v")).collect()] == ["block", "block", "allow", "allow"]


def test_hosts_of_very_many_labels():
    f = uf.UrlFilter((*uf.RULES, ("b.a.a.a.a.org/", "block")))
    a, hosts = f.automaton(), f.by_host()
    many = "a." * 10**6
    began = time.perf_counter()
    assert f.judge(f"http://{many}www.example.com/en/", a, hosts)[2:4] == ("www.example.com/en/", "allow")
    assert f.judge(f"http://{many}b.a.a.a.a.org/", a, hosts)[2:4] == ("b.a.a.a.a.org/", "block")
    assert f.judge(f"http://{many}/", a, hosts)[2:4] == (None, "allow") and f.judge("http://./com/", a, hosts)[2:4] == (None, "allow")
    assert time.perf_counter() - began < 20  # a walk over all labels takes minutes

import gzip
import hashlib

import duckdb
import pytest

from polyad.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string"
BIG = "é" * 600


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        top = max(same, default=None)
        revisit = len(data) >= 1000 and top is not None and i != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, "short"), (4, "x", "short"), (5, "n", None), (6, "e", ""), (7, "u\r\nInjected: 1", "a" * 999), (8, "u", "a" * 999), (9, "u", "a" * 1000), (9, "u", "a" * 1000), (10, "u", "a" * 1000), (None, "u", "a" * 1000), (11, "crlf", "x\r\n\r\ny\r\n\r\n"), (12, "long", "z" * 300_000)]


ENDS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029", "%0A"]
FORGED = ["WARC-Refers-To: <urn:page:5>", "Content-Length: 5", "WARC-Payload-Digest: sha1:0", "WARC-Type: revisit"]
ROWS += [(100 + 10 * e + f, f"http://a/{end}{field}{end}", ("f" * 1200 if e % 2 else "g") + str(f % 2)) for e, end in enumerate(ENDS) for f, field in enumerate(FORGED)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA)


def test_records_match_brute_force(spark, pages):
    got = [tuple(r) for r in warc.warc_query(spark, pages).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_payloads_are_stored_once_and_come_back(spark, pages, tmp_path):
    path = warc.write_archive(pages, f"{tmp_path}/a")
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})
    back = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read_archive(spark, path).collect()}
    assert back == {(r[0], r[2] or "") for r in ROWS}


def test_damage_is_found(spark, pages, tmp_path):
    """A changed payload, a changed header, or a payload that is gone: the records' reader notices each."""
    path = warc.write_archive(pages, f"{tmp_path}/a")
    payloads, headers = spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/headers")
    other = payloads.selectExpr("digest", "cast(concat(cast(payload AS string), '!') AS binary) AS payload", "n")
    swapped = headers.selectExpr("page_id", "digest", "share", "replace(header, 'Payload-Digest: sha1:', 'Payload-Digest: sha1:0') AS header")
    longer = headers.selectExpr("page_id", "digest", "share", "regexp_replace(header, 'Content-Length: (.)', 'Content-Length: 1$1') AS header")
    for k, (p, h) in enumerate([(other, headers), (payloads, swapped), (payloads, longer), (payloads.where("length(payload) <> 999"), headers)]):
        p.write.parquet(f"{tmp_path}/b{k}/payloads")
        h.write.parquet(f"{tmp_path}/b{k}/headers")
        with pytest.raises(Exception, match="record damaged"):
            warc.read_archive(spark, f"{tmp_path}/b{k}").select("page_id", "payload_bytes").collect()


def test_exported_files_are_warc(spark, pages, tmp_path):
    path = warc.write_archive(pages, f"{tmp_path}/a")
    warc.export_warc(spark, path, f"{tmp_path}/out")
    records = [r for f in (tmp_path / "out").glob("part-*.gz") for r in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    assert len(records) == len(ROWS)
    for fields, block in records:
        assert "Injected" not in fields
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
        else:
            assert block == b"" and fields["WARC-Refers-To"]


def test_hot_payloads_are_joined_whole(spark, monkeypatch):
    from polyad.llm import common

    monkeypatch.setattr(common, "HOT", 4)  # payloads of over a quarter of the rows
    monkeypatch.setattr(warc, "SHARE", 7)
    rows = [(i, f"u{i}", ["hot" * 500, "cold" * 400, None][0 if i % 3 else i % 2 + 1]) for i in range(60)]
    got = [tuple(r) for r in warc.warc_query(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark, pages):
    assert warc.warc_query(spark, pages.limit(0)).count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted((tuple(r) for r in warc.warc_query(spark, spark.read.parquet(f"{sf}/pages.parquet")).collect()), key=str)
    assert got == sorted(con.execute(warc.SQL).fetchall(), key=str)
